"""Temporal knowledge graph as plain edge tables.

entities(entity_id, name, ...), episodes(episode_id, ...), mentions(episode_id, entity_id),
note_mentions(note_id, entity_id), facts(fact_id, source_id, target_id, fact, valid_at,
invalid_at) and fact_episodes(fact_id, episode_id). Provenance is a table, not an array on
the fact, so a fact cited by very many episodes stays spread out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from memlake.functions import rules, text as tx
from memlake.operators import similarity
from memlake.operators.notes import norm_label
from memlake.operators.scan import Running, first_per, running, time_chunk
from memlake.session import cut_lineage, settle


def active_facts(facts: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Facts without an end, or valid at a moment."""
    if as_of is None:
        return facts.where(F.col("invalid_at").isNull())
    return facts.where((F.col("valid_at") <= as_of) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > as_of)))


def superseded_facts(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("invalid_at").isNotNull())


def facts_of(facts: DataFrame, entity_ids: DataFrame) -> DataFrame:
    """Facts touching the entities, from either end."""
    out = facts.join(entity_ids.select(F.col("entity_id").alias("source_id")), "source_id", "left_semi")
    into = facts.join(entity_ids.select(F.col("entity_id").alias("target_id")), "target_id", "left_semi")
    return out.select(*facts.columns).union(into.select(*facts.columns)).dropDuplicates(["fact_id"])


def endpoints(facts: DataFrame) -> DataFrame:
    return facts.select(F.explode(F.array("source_id", "target_id")).alias("entity_id"))


def orphans(entities: DataFrame, mentions: DataFrame, facts: DataFrame) -> DataFrame:
    """Entities no episode mentions and no fact touches."""
    used = mentions.select("entity_id").union(endpoints(facts)).distinct()
    return entities.join(used, "entity_id", "left_anti")


def silent_episodes(episodes: DataFrame, mentions: DataFrame) -> DataFrame:
    return episodes.join(mentions.select("episode_id"), "episode_id", "left_anti")


def inventory(**tables: DataFrame) -> DataFrame:
    """Row count per named node or edge table."""
    out = None
    for label, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.union(one)
    return out


def mention_counts(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    c = mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("mentions"))
    return entities.select("entity_id").join(c, "entity_id", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))


def duplicate_keys(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Keys held by more than one row: count, and first and last id."""
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id")).where("n > 1")


def contradictions(facts: DataFrame) -> DataFrame:
    """Entity pairs with more than one active fact."""
    return active_facts(facts).groupBy("source_id", "target_id").agg(
        F.count(F.lit(1)).alias("active"), F.min("valid_at").alias("oldest"), F.max("valid_at").alias("newest")).where("active > 1")


def entity_projects(episodes: DataFrame, mentions: DataFrame) -> DataFrame:
    """Sorted distinct projects of the episodes mentioning each entity. Made distinct before
    they are gathered, so a hub entity gathers projects, not mentions."""
    p = mentions.join(episodes.where(F.col("project").isNotNull()).select("episode_id", "project"), "episode_id")
    return p.select("entity_id", "project").distinct().groupBy("entity_id").agg(F.sort_array(F.collect_list("project")).alias("projects"))


def cross_project(episodes: DataFrame, mentions: DataFrame, least: int = 2) -> DataFrame:
    p = entity_projects(episodes, mentions).where(F.size("projects") >= least)
    return p.withColumn("breadth", F.size("projects")).orderBy(F.desc("breadth"), "entity_id")


def shared_entities(episodes: DataFrame, mentions: DataFrame, a: str, b: str) -> DataFrame:
    def of(project: str) -> DataFrame:
        return mentions.join(episodes.where(F.col("project") == project).select("episode_id"), "episode_id", "left_semi").select("entity_id")

    return of(a).intersect(of(b))


def shared_groups(mentions: DataFrame) -> DataFrame:
    """Episodes joined by an entity, as stars: every episode of an entity with more than one,
    beside the entity's first episode and degree. Says which episodes share what in one row
    per mention; listing the pairs would square the hubs."""
    d = mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree"), F.min("episode_id").alias("hub_episode")).where("degree > 1")
    return mentions.join(d, "entity_id")


def related_episodes(seeds: DataFrame, mentions: DataFrame) -> DataFrame:
    """Episodes sharing entities with each seed episode, and how many. Seeds are a bounded
    set (a page of results), so rows grow with the degree of their entities only."""
    s = mentions.join(settle(seeds.select("episode_id")), "episode_id").select(F.col("episode_id").alias("seed_id"), "entity_id")
    return mentions.join(s, "entity_id").where("episode_id <> seed_id").groupBy("seed_id", "episode_id").agg(F.count(F.lit(1)).alias("shared"))


def neighbourhood(entities: DataFrame, facts: DataFrame, keyword: str) -> DataFrame:
    """Entities whose name holds the keyword, with every fact in either direction; roots
    without facts keep one row."""
    roots = entities.where(F.lower("name").contains(keyword.lower())).select(F.col("entity_id").alias("root_id"))
    out = facts.select(F.col("source_id").alias("root_id"), "fact_id", F.col("target_id").alias("other_id"), F.lit("out").alias("direction"))
    into = facts.select(F.col("target_id").alias("root_id"), "fact_id", F.col("source_id").alias("other_id"), F.lit("in").alias("direction"))
    return roots.join(out.union(into), "root_id", "left")


# --- canonical entities ---------------------------------------------------------------


def duplicate_groups(entities: DataFrame) -> DataFrame:
    """Each entity of a name held more than once with its canonical: a wiki-sourced one,
    else the earliest created."""
    k = entities.withColumn("norm", norm_label(F.col("name")))
    best = F.struct(F.when(F.col("origin") == "wiki", 0).otherwise(1), "created_at", "entity_id")
    g = k.groupBy("norm").agg(F.min_by("entity_id", best).alias("canonical_id"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return k.join(g, "norm").select("entity_id", "norm", "canonical_id", "size")


def canonical_pick(members: DataFrame) -> DataFrame:
    """Per group the member with facts first, then the best connected, then the least id."""
    by = F.struct(F.col("relates") > 0, F.col("episodes") + F.col("notes") + F.col("relates"), -F.col("entity_id"))
    return members.groupBy("group_id").agg(F.max_by("entity_id", by).alias("canonical_id"))


def merge_entities(mapping: DataFrame, mentions: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Endpoints rewritten to canonical ids. Mentions collapse; facts never drop, and those
    turned into self-loops are flagged."""
    m = mapping.select("entity_id", "canonical_id").where("entity_id <> canonical_id")
    new_mentions = mentions.join(m, "entity_id", "left").select("episode_id", F.coalesce("canonical_id", "entity_id").alias("entity_id")).distinct()
    f = facts.join(m.select(F.col("entity_id").alias("source_id"), F.col("canonical_id").alias("__s")), "source_id", "left").join(
        m.select(F.col("entity_id").alias("target_id"), F.col("canonical_id").alias("__t")), "target_id", "left")
    s, t = F.coalesce("__s", "source_id"), F.coalesce("__t", "target_id")
    f = f.withColumns({"source_id": s, "target_id": t}).withColumn(
        "self_loop", (F.col("source_id") == F.col("target_id")) & (F.col("__s").isNotNull() | F.col("__t").isNotNull()))
    return new_mentions, f.select(*facts.columns, "self_loop")


def merged_aliases(mapping: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct names folded into each canonical, other than its own."""
    own = entities.select(F.col("entity_id").alias("canonical_id"), F.col("name").alias("kept_name"))
    names = mapping.join(entities.select("entity_id", "name"), "entity_id").join(own, "canonical_id").where("name <> kept_name")
    return names.select("canonical_id", "kept_name", "name").distinct().groupBy("canonical_id", "kept_name").agg(F.sort_array(F.collect_list("name")).alias("aliases"))


def connected_components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component = least id) over undirected pairs (a, b).

    Alternates large-star and small-star steps: each node points its neighbours at the least
    id it sees, so depth shrinks fast and edges never square. Every round ends in a reliable
    checkpoint, and the loop stops when no edge is new; it raises if it must stop before.
    """
    edges = cut_lineage(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        j = both.join(least, "u")
        kept = j.select(F.col("v").alias("x"), "m") if small else j.where("v > u").select(F.col("v").alias("x"), "m")
        if small:
            kept = kept.union(least.select(F.col("u").alias("x"), "m"))
        return kept.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()

    for _ in range(max_rounds):
        before, edges = edges, cut_lineage(star(star(edges, small=False), small=True))
        # Edges are distinct: as many as before and none of them new means the same set.
        if edges.join(before, ["u", "v"], "left_anti").isEmpty() and before.join(edges, ["u", "v"], "left_anti").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = edges.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(root, F.col("id") == F.col("u"), "left").select("id", F.coalesce("component", "id").alias("component"))


# --- episodes ------------------------------------------------------------------------------


def fold_episodes(mapping: DataFrame, mentions: DataFrame, fact_episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Duplicate episodes replaced by the kept one in mentions and provenance, once each."""
    m = mapping.select(F.col("duplicate_id").alias("episode_id"), "keep_id")

    def swap(df: DataFrame, other: str) -> DataFrame:
        return df.join(m, "episode_id", "left").select(F.coalesce("keep_id", "episode_id").alias("episode_id"), other).distinct()

    return swap(mentions, "entity_id"), swap(fact_episodes, "fact_id")


def retract(removed: DataFrame, mentions: DataFrame, facts: DataFrame, fact_episodes: DataFrame, note_mentions: DataFrame | None = None) -> dict[str, DataFrame]:
    """Effect of removing episodes: facts only they cite go, shared facts lose the citation,
    and entities they mentioned that nothing else holds become orphans."""
    gone = removed.select("episode_id").distinct()
    left = fact_episodes.join(gone, "episode_id", "left_anti")
    touched = fact_episodes.join(gone, "episode_id", "left_semi").select("fact_id").distinct()
    deleted = touched.join(left.select("fact_id"), "fact_id", "left_anti")
    detached = touched.join(left.select("fact_id"), "fact_id", "left_semi")
    kept_facts = facts.join(deleted, "fact_id", "left_anti")
    kept_mentions = mentions.join(gone, "episode_id", "left_anti")
    lost = mentions.join(gone, "episode_id", "left_semi").select("entity_id").distinct()
    held = kept_mentions.select("entity_id").union(endpoints(kept_facts))
    if note_mentions is not None:
        held = held.union(note_mentions.select("entity_id"))
    return {"facts": kept_facts, "fact_episodes": left, "mentions": kept_mentions, "deleted_facts": deleted, "detached_facts": detached,
            "orphaned_entities": lost.join(held, "entity_id", "left_anti")}


def newest_at(moments: DataFrame, timeline: DataFrame, keys: list[str], at: str, value: str, hours: int = 24 * 7) -> DataFrame:
    """As-of join: for each moment the newest timeline value not after it; of equal times the
    greatest value, of whatever type.

    Both sides go into one running scan ordered by time, timeline rows first on ties, with
    the value carried across time chunks: no pair of rows is ever formed.
    """
    left = moments.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*moments.columns).alias("__row"), F.lit(None).cast(dict(timeline.dtypes)[value]).alias("__v"),
                          F.lit(None).cast(dict(timeline.dtypes)[value]).alias("__tie"))
    right = timeline.select(*keys, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"),
                            F.col(value).alias("__tie"))
    r = running(left.union(right), keys, ["__at", "__side", "__tie"], time_chunk(F.col("__at"), hours), Running(lasts={"__seen": F.col("__v")}))
    return r.where("__side = 1").select("__row.*", F.col("__seen").alias(value))


def availability(episodes: DataFrame, promotions: DataFrame, lineage: list[str] | None = None) -> DataFrame:
    """When each episode became retrievable: first success of its memory, in a graph of the
    ``lineage`` where one is given, else its creation."""
    done = promotions.where("status = 'succeeded'")
    done = done if lineage is None else done.where(F.col("graph_name").isin(lineage))
    first = done.groupBy("memory_id").agg(F.min("promoted_at").alias("__p"))
    e = episodes.withColumn("memory_id", tx.memory_id_of(F.col("source_description")))
    return e.join(first, "memory_id", "left").withColumn("available_at", F.coalesce("__p", "created_at")).drop("__p")


def prune_notes(notes: DataFrame, note_mentions: DataFrame, mentions: DataFrame, facts: DataFrame, as_of: Column, paths: DataFrame | None = None) -> dict[str, DataFrame]:
    """Notes that were not there at ``as_of``, by the exported ``paths`` of that time where they
    are given, else by their creation; and the entities that only those notes held."""
    if paths is None:
        stale = notes.where(F.col("created_at") > as_of)
    else:
        stale = notes.join(paths.select("path").distinct(), "path", "left_anti")
    stale = cut_lineage(stale.select("note_id"))
    kept = note_mentions.join(stale, "note_id", "left_anti")
    held = mentions.select("entity_id").union(kept.select("entity_id")).union(endpoints(facts)).distinct()
    lost = note_mentions.join(stale, "note_id", "left_semi").select("entity_id").distinct().join(held, "entity_id", "left_anti")
    return {"notes": notes.join(stale, "note_id", "left_anti"), "note_mentions": kept, "removed_notes": stale, "removed_entities": lost}


def snapshot(episodes: DataFrame, mentions: DataFrame, facts: DataFrame, fact_episodes: DataFrame, as_of: Column, notes: DataFrame | None = None, note_mentions: DataFrame | None = None,
             paths: DataFrame | None = None) -> dict[str, DataFrame]:
    """The graph as it looked at ``as_of``: later episodes retracted, the invalidations a later
    episode caused undone, and later notes pruned with the entities only they held, where
    ``notes`` are given. ``episodes`` carries ``available_at`` and ``created_at``."""
    later = cut_lineage(episodes.where(F.coalesce(F.col("available_at") > as_of, F.lit(True))).select("episode_id"))
    r = retract(later, mentions, facts, fact_episodes, note_mentions)
    ended = r["facts"].where(F.col("invalid_at").isNotNull()).select(F.lit(1).alias("k"), F.col("invalid_at").alias("at"), "fact_id")
    line = episodes.select(F.lit(1).alias("k"), F.col("created_at").alias("at"), "episode_id")
    cause = newest_at(ended, line, ["k"], "at", "episode_id")
    undone = cause.join(later, "episode_id", "left_semi").select("fact_id").withColumn("__undo", F.lit(True))
    facts_then = r["facts"].join(undone, "fact_id", "left").withColumn(
        "invalid_at", F.when(F.col("__undo").isNull(), F.col("invalid_at"))).withColumn("restored", F.col("__undo").isNotNull()).drop("__undo")
    pruned = {} if notes is None else prune_notes(notes, note_mentions, r["mentions"], r["facts"], as_of, paths)
    return {**r, "facts": facts_then, "episodes": episodes.join(later, "episode_id", "left_anti"), **pruned}


# --- vouching, noise, quality ------------------------------------------------------------------


def document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct documents per normalised word."""
    words = F.array_distinct(F.split(norm_label(F.col(text)), " "))
    return docs.select(F.explode(F.filter(words, lambda w: w != "")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def phrase_idf(names: DataFrame, key: str, name: str, df: DataFrame, n_docs: DataFrame) -> DataFrame:
    """ln((N+1)/(df+1)) with the df of a phrase bounded by its rarest word; names are made
    distinct first. ``n_docs`` is one row (n)."""
    k = names.select(norm_label(F.col(name)).alias("norm")).distinct()
    w = k.select("norm", F.explode(F.split("norm", " ")).alias("word")).join(df, "word", "left")
    low = w.groupBy("norm").agg(F.min(F.when(F.col("word") == "", None).otherwise(F.coalesce("df", F.lit(0)))).alias("df"))
    n = n_docs.scalar()
    low = low.select("norm", F.log((n + 1) / (F.coalesce(F.col("df"), n) + 1)).alias("idf"))
    return names.withColumn("norm", norm_label(F.col(name))).join(low, "norm").select(key, "idf")


def retention_sweep(entities: DataFrame, mentions: DataFrame, idf: DataFrame) -> DataFrame:
    """Recurring (two episodes), vouched for by a rare name, or a candidate for removal."""
    m = mention_counts(entities, mentions).join(idf, "entity_id")
    status = (F.when(F.col("mentions") >= rules.RECURRING_EPISODES, "recurring").when(F.col("idf") > rules.IDF_VOUCHED, "vouched").otherwise("candidate"))
    return m.select("entity_id", "mentions", status.alias("status"))


def degrees(entities: DataFrame, mentions: DataFrame, note_mentions: DataFrame, facts: DataFrame) -> DataFrame:
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("entity_id").agg(F.count(F.lit(1)).alias(name))

    out = entities
    for df, name in ((mentions, "episodes"), (note_mentions, "notes"), (endpoints(facts), "relates")):
        out = out.join(count(df, name), "entity_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("episodes", "notes", "relates")})


def noise_rows(with_degrees: DataFrame, merging: DataFrame) -> DataFrame:
    """Debris-shaped entities with the side they come from and what may happen to them."""
    d = with_degrees.withColumn("noise", tx.noise_category(F.col("name"))).where(F.col("noise").isNotNull())
    d = d.join(merging.select("entity_id").withColumn("__m", F.lit(True)), "entity_id", "left")
    side = F.when(F.col("episodes") > 0, "episode").when(F.col("notes") > 0, "wiki-only").otherwise("unmentioned")
    disposition = F.when(F.col("__m"), "in-merge").when(F.col("relates") > 0, "has-facts").otherwise("drop-candidate")
    return d.withColumns({"side": side, "disposition": disposition}).drop("__m")


def noise_report(rows: DataFrame) -> DataFrame:
    """Counts and facts at risk by disposition, category, side, and in total."""
    from memlake.operators.journal import grouped_counts

    risk = F.sum(F.when(F.col("disposition") == "has-facts", F.col("relates")).otherwise(0)).alias("facts_at_risk")
    # A grouping column is null inside other grouping sets, so the risk is fixed beforehand.
    r = rows.withColumn("risk", F.when(F.col("disposition") == "has-facts", F.col("relates")).otherwise(0)).select("disposition", "noise", "side", "risk")
    return grouped_counts(r, ["disposition", "noise", "side"], F.sum("risk").alias("facts_at_risk"))


def prune_debris(entities: DataFrame, mentions: DataFrame, note_mentions: DataFrame, episode_ids: DataFrame) -> DataFrame:
    """Debris-shaped entities of the given episodes that nothing else mentions. Package-like
    names typed as software stay, unless the shape is a call or camel case."""
    n = F.trim("name")
    package = (F.col("noise") == "code_identifier") & F.col("entity_type").isin(*rules.TRUSTED_TYPES) & ~(
        tx.matches(n, rules.CALL_NAME) | (~n.contains(" ") & n.rlike(rules.CAMEL_NAME)))
    # The shape is found once and written: as part of a filter it would be worked out again and again.
    shaped = cut_lineage(entities.withColumn("noise", tx.noise_category(F.col("name"))))
    d = shaped.where(F.col("noise").isNotNull() & ~package)
    mine = mentions.join(episode_ids.select("episode_id"), "episode_id", "left_semi").select("entity_id").distinct()
    other = mentions.join(episode_ids.select("episode_id"), "episode_id", "left_anti").select("entity_id").union(note_mentions.select("entity_id"))
    return d.join(mine, "entity_id", "left_semi").join(other, "entity_id", "left_anti")


def entity_quality(episodes: DataFrame, mentions: DataFrame, entities: DataFrame, fact_episodes: DataFrame, gold: DataFrame, bucket: str) -> DataFrame:
    """Per bucket of episodes: empty-extraction rate, entities and facts per episode,
    single-mention and noise share, gold names found."""
    total = mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("graph_mentions"))
    e = episodes.select("episode_id", F.col(bucket).alias("bucket"))
    info = entities.select("entity_id", norm_label(F.col("name")).alias("norm"), tx.noise_category(F.col("name")).isNotNull().alias("noisy")).join(
        total, "entity_id").join(gold.select("norm").distinct().withColumn("gold", F.lit(True)), "norm", "left")
    uses = mentions.join(e, "episode_id")
    per_entity = uses.groupBy("bucket", "entity_id").agg(F.count(F.lit(1)).alias("c")).join(info, "entity_id").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("entities"), F.sum("c").alias("uses"), F.count_if(F.col("graph_mentions") == 1).alias("single"),
        F.count_if("noisy").alias("noisy"), F.count_distinct(F.when(F.col("gold"), F.col("norm"))).alias("gold_found"))
    facts = fact_episodes.groupBy("episode_id").agg(F.count(F.lit(1)).alias("facts"))
    full = mentions.groupBy("episode_id").agg(F.count(F.lit(1)).alias("m"))
    per_ep = e.join(full, "episode_id", "left").join(facts, "episode_id", "left").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if(F.col("m").isNull()).alias("empty"), F.sum(F.coalesce("facts", F.lit(0))).alias("facts"))
    j = per_ep.join(per_entity, "bucket", "left")
    return j.select("bucket", "episodes", "entities", (F.col("empty") / F.col("episodes")).alias("empty_rate"), (F.col("uses") / F.col("episodes")).alias("entities_per_episode"),
                    (F.col("facts") / F.col("episodes")).alias("facts_per_episode"), (F.col("single") / F.col("entities")).alias("single_rate"),
                    (F.col("noisy") / F.col("entities")).alias("noise_share"), "gold_found")


# --- facts over time ------------------------------------------------------------------------------


def anchor_valid_at(facts: DataFrame, reference: Column) -> DataFrame:
    """A midnight start on the reference time's own day is raised to that time."""
    v = F.col("valid_at")
    raise_ = (v == F.date_trunc("DAY", v).cast("timestamp_ntz")) & (F.to_date(v) == F.to_date(reference)) & (v < reference)
    return facts.withColumn("valid_at", F.when(raise_, reference).otherwise(v))


def supersede_by_text(edits: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(closed facts, candidates): an edit whose text names one active fact closes it at the
    edit time; one that fits several lists them instead."""
    live = active_facts(facts).select("fact_id", F.lower(F.trim("fact")).alias("k"), "valid_at")
    hits = edits.withColumn("k", F.lower(F.trim("fact_text"))).join(live, "k")
    n = hits.groupBy("edit_id").agg(F.count(F.lit(1)).alias("n"))
    j = hits.join(n, "edit_id")
    one = j.where("n = 1")
    return one.select("edit_id", "fact_id", "valid_at", F.greatest("at", "valid_at").alias("invalid_at")), j.where("n > 1").select("edit_id", "fact_id", "n")


def resolve_endpoints(new_edges: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with ids, names to create): endpoints matched by case-folded name, the least id
    winning; a missing name is created once."""
    k = lambda c: F.lower(F.trim(c))
    known = entities.groupBy(k(F.col("name")).alias("key")).agg(F.min("entity_id").cast("string").alias("id"))
    ends = new_edges.select(F.explode(F.array("source_name", "target_name")).alias("name"))
    missing = ends.select(k(F.col("name")).alias("key"), "name").join(known, "key", "left_anti").groupBy("key").agg(F.min("name").alias("name"))
    ids = known.union(missing.select("key", F.concat(F.lit("new:"), F.sha1("key"))))
    e = new_edges.join(ids.select(F.col("key").alias("__s"), F.col("id").alias("source_id")), k(F.col("source_name")) == F.col("__s"))
    e = e.join(ids.select(F.col("key").alias("__t"), F.col("id").alias("target_id")), k(F.col("target_name")) == F.col("__t"))
    return e.select("edge_id", "source_id", "target_id"), missing


def repath(notes: DataFrame, files: DataFrame) -> DataFrame:
    """Notes whose file is gone: moved when exactly one file has the name and no note holds
    that path, else the reason it stays."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    missing = notes.join(files.select("path"), "path", "left_anti").withColumn("base", name)
    by_name = files.withColumn("base", name).groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("found"))
    taken = notes.select(F.col("path").alias("found"), F.lit(True).alias("taken"))
    j = missing.join(by_name, "base", "left").join(taken, "found", "left")
    why = (F.when(F.col("n").isNull(), "no file with that name").when(F.col("n") > 1, "ambiguous").when(F.col("taken"), "target already a note").otherwise("moved"))
    return j.select("path", why.alias("outcome"), F.when(why == "moved", F.col("found")).alias("new_path"))


def explain_memory(memories: DataFrame, promotions: DataFrame, episodes: DataFrame, mentions: DataFrame, fact_episodes: DataFrame) -> DataFrame:
    """Each memory's episode in the graph with its entity and fact counts; found or not."""
    ok = promotions.where("status = 'succeeded'").select("memory_id").distinct().withColumn("promoted", F.lit(True))
    e = episodes.withColumn("memory_id", tx.memory_id_of(F.col("source_description"))).select("memory_id", "episode_id", "name")
    n = mentions.groupBy("episode_id").agg(F.count(F.lit(1)).alias("entities"))
    f = fact_episodes.groupBy("episode_id").agg(F.count(F.lit(1)).alias("facts"))
    j = memories.select("memory_id").join(ok, "memory_id", "left").join(e, "memory_id", "left").join(n, "episode_id", "left").join(f, "episode_id", "left")
    return j.select("memory_id", F.coalesce("promoted", F.lit(False)).alias("promoted"), F.col("name").isNotNull().alias("found"), F.coalesce("name", F.lit("")).alias("episode"),
                    F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("facts", F.lit(0)).alias("facts"))


def rebuild_from_ledger(promotions: DataFrame, memories: DataFrame, projects: list[str] | None = None) -> DataFrame:
    """Episodes to re-create in promotion order with fresh names; rows whose memory is gone
    come out with ``missing``."""
    from memlake.operators.ledger import next_names

    p = promotions.where("status = 'succeeded'").select("memory_id", "promoted_at", "harness", "project")
    if projects is not None:
        p = p.where(F.col("project").isin(*projects))
    j = p.join(memories.select("memory_id", "statement", "event_date"), "memory_id", "left").withColumn("missing", F.col("statement").isNull())
    return next_names(j, j.limit(0).select(F.lit("").alias("name")), ["promoted_at", "memory_id"])


def seed_tables(sections: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """Node and edge tables from a section registry: notes and sections upserted by id,
    IN_NOTE, CONTAINS and REFERENCES edges once each, only between known nodes."""
    notes = sections.select(F.col("path").alias("note_path")).distinct()
    nodes = sections.dropDuplicates(["section_id"]).select("section_id", "path", "heading_clean", "level")
    contains = sections.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("src"), F.col("section_id").alias("dst")).distinct()
    refs = links.select(F.col("from_path").alias("src"), F.col("resolved_path").alias("dst")).where("dst IS NOT NULL AND src <> dst").distinct()
    refs = refs.join(notes.select(F.col("note_path").alias("src")), "src", "left_semi")
    return {"notes": notes, "sections": nodes, "in_note": nodes.select(F.col("section_id").alias("src"), F.col("path").alias("dst")), "contains": contains, "references": refs}


# --- duplicate pairs -------------------------------------------------------------------------------


def name_pairs(entities: DataFrame) -> DataFrame:
    """Candidate duplicate names by exact, normalised, acronym and containment rules.

    Works on distinct names. Equal and equal-when-normalised names are stars around the
    least name; acronyms meet names by their initials; a short name meets longer ones by its
    rarest word. No rule pairs the members of a block with each other.
    """
    n = entities.groupBy("name").agg(F.min("entity_id").alias("entity_id"), F.min("entity_type").alias("kind"))
    n = n.withColumns({"norm": tx.normalize_entity(F.col("name")), "words": F.array_distinct(tx.name_words(F.col("name"))), "acr": tx.initials(F.col("name"))})
    hub = n.groupBy("norm").agg(F.min("name").alias("a"))
    same = n.join(hub, "norm").where("name <> a").select("a", F.col("name").alias("b"), F.lit("normalized").alias("rule"))
    short = n.where(F.col("name").rlike(r"^[A-Z0-9]{2,}$")).select(F.col("name").alias("a"), F.lower("name").alias("acr"))
    acr = short.join(n.where(F.size("words") >= 2).select("acr", F.col("name").alias("b")), "acr").select("a", "b", F.lit("acronym").alias("rule"))
    tokens = n.select("name", "words", F.explode("words").alias("word"))
    df = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    stop = F.array(*[F.lit(w) for w in rules.BM25_STOPWORDS])
    rare = tokens.join(df, "word").where(F.size(F.array_except("words", stop)) > 0).groupBy("name", "words").agg(F.min_by("word", F.struct("df", "word")).alias("word"))
    longer = tokens.select("word", F.col("name").alias("b"), F.col("words").alias("wb"))
    held = rare.select("word", F.col("name").alias("a"), F.col("words").alias("wa")).join(longer, "word").where(
        (F.size("wa") < F.size("wb")) & (F.size(F.array_except("wa", "wb")) == 0)).select("a", "b", F.lit("containment").alias("rule"))
    return same.union(acr).union(held).groupBy("a", "b").agg(F.min_by("rule", F.when(F.col("rule") == "normalized", 0).when(F.col("rule") == "acronym", 1).otherwise(2)).alias("rule"))


def version_conflict(a: Column, b: Column) -> Column:
    """Same words but for the numbers, with different numbers: versions, never duplicates."""
    def digits(c: Column) -> Column:
        return F.array_join(F.regexp_extract_all(F.lower(c), F.lit(r"\d+[a-z]?"), F.lit(0)), ".")

    def frame(c: Column) -> Column:
        return tx.fold_letters(F.regexp_replace(F.lower(c), r"\d+[a-z]?", ""))

    return (frame(a) == frame(b)) & (digits(a) != digits(b)) & (digits(a) != "") & (digits(b) != "")


def with_vectors(pairs: DataFrame, vectors: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Pairs of the name rules with their similarity ``sim``, and those that only the embedding
    rule finds (a before b). ``vectors``: name, vector."""
    v = vectors.select(F.col("name").alias("id"), "vector")
    named = similarity.cosines(pairs.select("a", "b", "rule"), v)
    close = similarity.similar_pairs(v, threshold)
    either = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return named.unionByName(close.join(either, ["a", "b"], "left_anti").select("a", "b", F.lit("embedding").alias("rule"), "sim"))


def tier_pairs(pairs: DataFrame, gate: float = 0.80, threshold: float = 0.92, families: list[list[str]] = (), keep: list[str] = (), persons: list[str] = (),
               ambiguous: list[str] = (), generic: list[str] = rules.GENERIC_NAME_WORDS) -> DataFrame:
    """Tier per candidate pair (a, b, rule, ka, kb, sim): auto, review, weak or a never-tier;
    pairs no rule supports are dropped. ``sim`` is the vector similarity, null when unknown;
    ``da`` and ``db``, where given, say whether a name's shape is debris, ``na`` and ``nb`` are
    the normalised names.

    The lists are configuration. Names of one of the ``families`` are never duplicates, nor are
    two gold ``keep`` names by their vectors alone. A part of a person's name needs no
    similarity; ``ambiguous`` names and acronyms are weak. ``generic`` words make no name.
    """
    sim = F.coalesce(F.col("sim"), F.lit(0.0))
    na, nb = (F.col("na"), F.col("nb")) if "na" in pairs.columns else (tx.normalize_entity(F.col("a")), tx.normalize_entity(F.col("b")))
    norms = lambda c, names: reduce(lambda x, y: x | y, [c == tx.normalize_entity(F.lit(n)) for n in names], F.lit(False))
    related = reduce(lambda x, y: x | y, [norms(na, f) & norms(nb, f) for f in families], F.lit(False))
    typed = F.col("ka").isNotNull() & F.col("kb").isNotNull() & (F.col("ka") != F.col("kb"))
    debris = F.col("da") | F.col("db") if "da" in pairs.columns else tx.noise_category(F.col("a")).isNotNull() | tx.noise_category(F.col("b")).isNotNull()
    lone_case = (F.lower("a") != F.lower("b")) & ~F.col("a").contains(" ") & (F.left("a", F.lit(1)) != F.left("b", F.lit(1)))
    plain = F.array(*[F.lit(w) for w in generic]).cast("array<string>")
    wa, wb = tx.name_words(F.col("a")), tx.name_words(F.col("b"))
    person = norms(nb, persons) | (F.lower("kb") == "person") & (F.col("ka").isNull() | (F.lower("ka") == "person"))
    contained = (
        F.when(typed | (F.size(F.array_except(wa, plain)) == 0), F.lit(None))
        .when(F.coalesce(person, F.lit(False)), F.when(norms(na, ambiguous), "weak").otherwise("review"))
        .when(sim < gate, F.lit(None))
        .when(F.size(F.array_except(F.array_except(wb, wa), plain)) == 0, "weak").otherwise("review"))
    by_name = (
        F.when((F.col("rule") == "normalized") & (typed | debris | lone_case), "review").when(F.col("rule") == "normalized", "auto")
        .when(related, "never-family")
        .when((F.col("rule") == "acronym") & ((F.length("a") <= 2) | norms(na, ambiguous)), "weak").when(F.col("rule") == "acronym", "review")
        .when(F.col("rule") == "containment", contained))
    by_vector = F.when((sim >= threshold) & ~typed, F.when(norms(na, keep) & norms(nb, keep), "never-gold-keep").when(debris, "weak").otherwise("review"))
    tier = F.when(version_conflict(F.col("a"), F.col("b")), "never-version").otherwise(F.coalesce(by_name, by_vector))
    return pairs.withColumn("tier", tier).where(F.col("tier").isNotNull()).withColumn("rule", F.when(by_name.isNull() & ~F.col("tier").isin("never-version"), "embedding").otherwise(F.col("rule")))
