"""Notes, sections, links and bullets from Markdown-like text.

Lines are the unit: a document is exploded to numbered lines, and headings, parents and
bodies come from running values over them. The chunked scan keeps one long document from
sitting on one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions import rules, text as tx
from memlake.operators.journal import text_lines
from memlake.operators.scan import Running, first_per, number_chunk, running, within


def norm_label(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def parse_sections(notes: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """One row per heading: level, clean label, parent section, lede and body size.

    The parent of a heading is the nearest earlier heading of a lower level; levels are at
    most five, so it is the newest of five running values.
    """
    lines = text_lines(notes, key, text)
    level = F.length(F.regexp_extract("line", rules.HEADING, 1))
    marked = lines.withColumn("level", F.when(F.col("line").rlike(rules.HEADING), level))
    marked = marked.withColumn("heading_line", F.when(F.col("level").isNotNull(), F.col("line_no")))
    lasts = {f"h{k}": F.when(F.col("level") == k, F.col("line_no")) for k in range(1, 6)}
    r = running(marked, [key], ["line_no"], number_chunk(F.col("line_no"), 5000), Running(
        sums={"ordinal": F.col("level").isNotNull().cast("bigint")}, lasts={"prev_heading": F.col("heading_line"), **lasts}))
    heads = r.where(F.col("level").isNotNull())
    parent = F.greatest(*[F.when(F.col("level") > k, F.col(f"h{k}")) for k in range(1, 6)])
    label = F.trim(F.regexp_extract("line", rules.HEADING, 2))
    heads = heads.select(
        key, "line_no", (F.col("ordinal") - 1).alias("idx"), "level", label.alias("heading_raw"), tx.clean_heading(label).alias("heading_clean"),
        parent.alias("parent_line"))
    heads = heads.withColumns({
        "section_id": section_id(F.col(key), F.col("idx"), F.col("heading_clean")),
        "is_boilerplate": norm_label(F.col("heading_clean")).isin(*rules.BOILERPLATE_LABELS)})

    body = r.where(F.col("level").isNull() & F.col("prev_heading").isNotNull())
    words = F.filter(F.split("line", r"\s+"), lambda w: w != "")
    sized = body.select(key, F.col("prev_heading").alias("line_no"), F.col("line_no").alias("at"), words.alias("w"))
    # The lede needs the first 25 words only: words before a line decide whether it counts.
    counted = running(sized.select(F.struct(key, "line_no").alias("sec"), "at", F.slice("w", 1, rules.LEDE_WORDS).alias("w"), F.size("w").alias("n")),
                      ["sec"], ["at"], number_chunk(F.col("at"), 5000), Running(sums={"upto": F.col("n").cast("bigint")}))
    start = F.col("upto") - F.col("n")
    ledes = counted.groupBy("sec").agg(
        F.sum("n").alias("body_words"),
        F.array_sort(F.collect_list(F.when((start < rules.LEDE_WORDS) & (F.col("n") > 0), F.struct("at", "w")))).alias("first"))
    lede = F.array_join(F.slice(F.flatten(F.transform("first", lambda x: x["w"])), 1, rules.LEDE_WORDS), " ")
    ledes = ledes.select(F.col(f"sec.{key}").alias(key), F.col("sec.line_no").alias("line_no"), "body_words", lede.alias("lede"))
    parents = heads.select(key, F.col("line_no").alias("parent_line"), F.col("section_id").alias("parent_id"))
    return (heads.join(parents, [key, "parent_line"], "left").join(ledes, [key, "line_no"], "left")
            .withColumns({"body_words": F.coalesce("body_words", F.lit(0)).cast("bigint"), "lede": F.coalesce("lede", F.lit(""))})
            .drop("parent_line"))


def section_id(path: Column, idx: Column, label: Column) -> Column:
    raw = F.concat(path.cast("string"), F.lit("\x1f"), idx.cast("string"), F.lit("\x1f"), label)
    return F.left(F.sha1(raw), F.lit(16))


def stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return norm_label(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""))


def resolve_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """``links(from_path, target)`` with the note each target's stem names; null when none.
    Several notes with one stem: the first path wins."""
    index = notes.select("path", stem(F.col("path")).alias("stem")).groupBy("stem").agg(F.min("path").alias("resolved_path"))
    name = norm_label(F.element_at(F.split(F.regexp_replace("target", r"\|.*$", ""), "/"), -1))
    return links.withColumn("stem", name).join(index, "stem", "left").drop("stem")


def stub_notes(resolved: DataFrame, in_scope: DataFrame) -> DataFrame:
    """Notes that are linked to but lie outside the scanned scope."""
    return (resolved.where(F.col("resolved_path").isNotNull() & (F.col("resolved_path") != F.col("from_path")))
            .select(F.col("resolved_path").alias("path")).distinct().join(in_scope.select("path"), "path", "left_anti")
            .withColumn("area", F.when(F.col("path").contains("/"), F.element_at(F.split("path", "/"), 1)).otherwise("ROOT")))


def wikilinks(notes: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    return notes.select(F.col(key).alias("from_path"), F.explode(F.regexp_extract_all(text, F.lit(rules.WIKILINK), F.lit(1))).alias("target"))


def parse_bullets(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "export") -> DataFrame:
    """Atomic items of a Markdown list export.

    A bullet with deeper bullets below it is a summary: each of those children is an item,
    prefixed by the summary unless it repeats it. A non-blank line under a bullet continues it; elsewhere
    consecutive lines form a paragraph item. The rows keep document order in ``item_no``.
    A document's lines come from one cell, so they meet in one task and move once.
    """
    lines = text_lines(docs, key, text).withColumn("s", F.trim(F.regexp_replace("line", r"\s+$", "")))
    lines = lines.withColumns({
        "is_head": F.col("s").rlike(rules.BULLET_HEADING), "is_bullet": F.col("line").rlike(rules.BULLET), "blank": F.col("s") == ""})
    indent = F.length(F.regexp_extract("line", rules.BULLET, 1))
    lines = lines.withColumns({"is_bullet": F.col("is_bullet") & ~F.col("is_head"),
                               "indent": F.when(F.col("is_bullet") & ~F.col("is_head"), indent)})
    # Kind of the newest structural line before: decides whether plain text continues a bullet.
    kind = F.when(F.col("is_head"), "h").when(F.col("is_bullet"), "b")
    r = within(lines, [key], ["line_no"], Running(
        lasts={"open_kind": kind, "heading_before": F.when(F.col("is_head"), F.trim(F.regexp_extract("s", rules.BULLET_HEADING, 2))),
               "last_head": F.when(F.col("is_head"), F.col("line_no"))},
        lags={"prev_blank": F.col("blank"), "prev_head": F.col("is_head")}))
    plain = ~F.col("is_head") & ~F.col("is_bullet") & ~F.col("blank")
    continues = plain & (F.col("open_kind") == "b")
    para_start = plain & ~F.coalesce(continues, F.lit(False)) & F.coalesce(F.col("prev_blank") | F.col("prev_head"), F.lit(True))
    r = r.withColumn("starts", F.col("is_bullet") | para_start)
    r = within(r, [key], ["line_no"], Running(sums={"item_no": F.col("starts").cast("bigint")}))
    own = F.when(F.col("is_bullet"), F.trim(F.regexp_extract("line", rules.BULLET, 3))).otherwise(F.col("s"))
    by = F.struct("line_no", own.alias("t"))
    items = r.where(~F.col("blank") & ~F.col("is_head") & (F.col("item_no") > 0)).groupBy(key, "item_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(by)), lambda x: x["t"]), " ").alias("body"),
        F.min("line_no").alias("line_no"), F.min_by("indent", "line_no").alias("indent"),
        F.min_by("heading_before", "line_no").alias("heading"), F.min_by(F.coalesce("last_head", F.lit(0)), "line_no").alias("block"))
    # Top bullets of a block: an item whose indent is no deeper than the open top's.
    w_keys = [key, "block"]
    tops = _mark_tops(items, key)
    after = within(tops, [key], ["item_no"], Running(leads={"next_top": F.col("is_top")}))
    after = within(after.withColumn("__t", F.when(F.col("is_top"), F.col("body"))), [key], ["item_no"],
                   Running(lasts={"summary": F.col("__t")}))
    summary = F.regexp_replace("summary", r":+$", "")
    repeats = F.lower("body").startswith(F.lower(summary))
    text_ = F.when(F.col("is_top") | (summary == "") | repeats, F.col("body")).otherwise(F.concat(summary, F.lit(": "), F.col("body")))
    out = after.where(~(F.col("is_top") & (F.coalesce("next_top", F.lit(True)) == F.lit(False))))
    return out.select(key, "item_no", F.coalesce("heading", F.lit("")).alias("heading"), text_.alias("text"))


def _mark_tops(items: DataFrame, key: str) -> DataFrame:
    """A bullet is a child when an open top bullet with a smaller indent precedes it.

    The open top changes only at an item that is not deeper, so per block it follows the
    running minimum of indents; paragraphs (null indent) and headings close it.
    """
    r = within(items, [key], ["item_no"], Running(
        sums={"__para": F.col("indent").isNull().cast("bigint")}))
    r = within(r, [key, "block", "__para"], ["item_no"], Running(mins={"__low": F.col("indent")}))
    low = F.col("__low")
    return r.withColumn("is_top", F.col("indent").isNull() | low.isNull() | (F.col("indent") <= low)).drop("__para", "__low")


def note_dates(notes: DataFrame, history: DataFrame) -> DataFrame:
    """Created: front matter, else first commit, else disk; an earlier file-name date beats
    the last two. Updated: last commit, else front matter, else disk.

    ``history``: path, at - one row per commit touching the path.
    """
    span = history.groupBy("path").agg(F.min("at").alias("first_commit"), F.max("at").alias("last_commit"))
    n = notes.join(span, "path", "left")

    def stated(field: str) -> Column:
        return F.left(tx.front_matter_field(F.col("text"), field), F.lit(10)).try_cast("date").cast("timestamp_ntz")

    name = F.regexp_extract("path", r"([^/]+)$", 1)
    named = F.regexp_extract(name, r"(?:^|\D)(20\d{2}-\d{2}-\d{2})(?:\D|$)", 1).try_cast("date").cast("timestamp_ntz")
    n = n.withColumns({"fm_c": stated("created"), "fm_u": stated("updated"), "named": named})
    base = F.coalesce("first_commit", "disk_created")
    earlier = F.col("named").isNotNull() & (base.isNull() | (F.to_date("named") < F.to_date(base)))
    source = (F.when(F.col("fm_c").isNotNull(), "frontmatter").when(earlier, "filename")
              .when(F.col("first_commit").isNotNull(), "git").when(F.col("disk_created").isNotNull(), "disk"))
    updated_source = (F.when(F.col("last_commit").isNotNull(), "git").when(F.col("fm_u").isNotNull(), "frontmatter")
                      .when(F.col("disk_updated").isNotNull(), "disk"))
    return n.select(
        "path", F.coalesce(F.col("fm_c"), F.when(earlier, F.col("named")), base).alias("created_at"), source.alias("created_source"),
        F.coalesce("last_commit", "fm_u", "disk_updated").alias("updated_at"), updated_source.alias("updated_source"))


def canonical_folders(paths: DataFrame, existing: DataFrame) -> DataFrame:
    """``folder`` in the spelling of an existing folder with the same letters and digits;
    title case of the parts where none exists. Ties go to the first existing spelling."""
    known = existing.select("folder", tx.fold_letters(F.col("folder")).alias("k")).groupBy("k").agg(F.min("folder").alias("known"))
    titled = F.array_join(F.transform(F.split("folder", "-"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), "-")
    return paths.withColumn("k", tx.fold_letters(F.col("folder"))).join(known, "k", "left").withColumn(
        "canonical", F.coalesce("known", titled)).drop("k", "known")


def carry_forward(prior: Column, material: Column) -> Column:
    """Pending text joined with new material, losing neither: whichever contains the other
    stands alone, else the new part is appended after a blank line."""
    old, new = F.coalesce(prior, F.lit("")), F.coalesce(material, F.lit(""))
    return (F.when(F.trim(old) == "", new).when(old.contains(F.trim(new)), old).when(new.contains(F.trim(old)), new)
            .otherwise(F.concat(F.rtrim(old), F.lit("\n\n"), F.trim(new), F.lit("\n"))))
