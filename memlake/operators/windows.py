"""Segmentation of conversations into topical windows.

Every strategy marks the rows that begin a new segment, caps the segment length, and folds
segments under the minimum into their predecessor. All of it is running sums over chunked
keys, so no conversation is ever held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from memlake.functions import rules, text as tx, vectors
from memlake.operators.scan import CHUNK, LAST_CHUNK, Running, join_null_safe, running, segment, time_chunk

KEY = "conversation_id"


def fixed_turn_windows(events: DataFrame, order: list[str], size: int = 8, minimum: int = 3) -> DataFrame:
    """``window_no`` by position; a last window under the minimum joins the one before."""
    rows = running(events, [KEY], order, time_chunk(F.col("observed_at")), Running(sums={"pos": F.lit(1).cast("bigint")}))
    totals = events.groupBy(KEY).agg(F.count(F.lit(1)).alias("__n"))
    no = F.floor((F.col("pos") - 1) / size)
    last = F.floor((F.col("__n") - 1) / size)
    runt = (no == last) & (last > 0) & (F.col("__n") - last * size < minimum)
    return join_null_safe(rows, totals, [KEY]).withColumn("window_no", F.when(runt, no - 1).otherwise(no)).drop("__n")


def merge_runts(segments: DataFrame, order: list[str], chunk: Column, minimum: int, why: Column | None = None) -> DataFrame:
    """Give each segment (with row count ``n``) its final ``window_no``, counted from 0.

    A segment under the minimum joins its predecessor; a leading one joins its successor.
    Adds ``is_tail`` / ``is_lead_in`` for the folded ones, ``total`` rows of the key, and
    ``next_why``, the label of the segment after.
    """
    inside = Window.partitionBy(KEY, CHUNK).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    top = segments.groupBy(KEY).agg(F.min(F.struct(*order)).alias("__top")) if not {"session", "block"} <= set(order) else None
    first = (F.col("session") == 0) & (F.col("block") == 0) if top is None else F.struct(*order) == F.col("__top")
    segs = segments if top is None else join_null_safe(segments, top, [KEY])
    segs = segs.withColumns({CHUNK: F.coalesce(chunk.cast("bigint"), F.lit(LAST_CHUNK)), "__why": why if why is not None else F.lit(None).cast("string")})
    segs = segs.withColumn("__is_head", first | (F.col("n") >= minimum))
    segs = segs.withColumns({"__lh": F.sum(F.col("__is_head").cast("bigint")).over(upto), "__lnext": F.lead("__why").over(inside),
                             "__last": F.lead(F.lit(1)).over(inside).isNull()})

    chunks = segs.groupBy(KEY, CHUNK).agg(
        F.sum(F.col("__is_head").cast("bigint")).alias("__h"), F.sum("n").alias("__cn"),
        F.sum(F.when(F.col("__lh") == 0, F.col("n")).otherwise(0)).alias("__pre1"),
        F.sum(F.when(F.col("__lh") <= 1, F.col("n")).otherwise(0)).alias("__pre2"),
        F.min_by("__why", F.struct(*order)).alias("__headwhy"))
    over_chunks = Window.partitionBy(KEY).orderBy(CHUNK)
    whole = Window.partitionBy(KEY)
    chunks = chunks.withColumns({
        "__h0": F.coalesce(F.sum("__h").over(over_chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "__nextwhy": F.lead("__headwhy").over(over_chunks)})
    lead = F.when(F.col("__h0") == 0, F.col("__pre2")).when(F.col("__h0") == 1, F.col("__pre1")).otherwise(0)
    chunks = chunks.select(KEY, CHUNK, "__h0", "__nextwhy", F.sum(lead).over(whole).alias("__lead_n"),
                           F.sum("__h").over(whole).alias("__groups"), F.sum("__cn").over(whole).alias("total"))

    grp = F.col("__h0") + F.col("__lh")
    folds = (F.col("__lead_n") < minimum) & (F.col("__groups") > 1)
    lead_in = folds & (grp == 1)
    out = join_null_safe(segs, chunks, [KEY, CHUNK]).withColumns({
        "window_no": F.when(folds, F.greatest(grp - 2, F.lit(0))).otherwise(grp - 1),
        "is_lead_in": lead_in, "is_tail": ~F.col("__is_head") & ~lead_in,
        "next_why": F.when(F.col("__last"), F.col("__nextwhy")).otherwise(F.col("__lnext"))})
    return out.select(*segments.columns, "window_no", "is_lead_in", "is_tail", "next_why", "total")


def _segment(rows: DataFrame, order: list[str], hours: int, cols: list[str], begins, why, cap: int, minimum: int,
             end_reason: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with window_no, windows with size, bounds and boundary reason)."""
    cut = segment(rows, [KEY], order, time_chunk(F.col("observed_at"), hours), cols, begins, why)
    cut = cut.withColumn("block", F.floor((F.col("pos") - F.col("start_pos")) / cap))
    segs = cut.groupBy(KEY, "session", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("observed_at").alias("start_at"), F.max("observed_at").alias("end_at"),
        F.min_by("begin_why", "pos").alias("__w"))
    label = F.when(F.col("block") > 0, F.lit("size cap")).otherwise(F.col("__w"))
    merged = merge_runts(segs, ["session", "block"], time_chunk(F.col("start_at"), hours), minimum, label)
    core = ~F.col("is_tail") & ~F.col("is_lead_in")
    windows = merged.groupBy(KEY, "window_no").agg(
        F.sum("n").alias("n_events"), F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"),
        F.when(F.max("total") < minimum, F.lit("short conversation")).otherwise(F.concat(
            F.max(F.when(core, F.coalesce(F.col("next_why"), end_reason))),
            F.when(F.bool_or("is_tail"), F.lit(" (+tail)")).otherwise(F.lit("")))).alias("reason"))
    placed = join_null_safe(cut, merged.select(KEY, "session", "block", "window_no"), [KEY, "session", "block"])
    return placed.select(*rows.columns, "window_no"), windows


def time_gap_windows(events: DataFrame, order: list[str], gap_seconds: int = 7200, cap: int = 20, minimum: int = 3,
                     hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """Split at pauses of at least the gap, and at the size cap."""

    def gap(prev: Column, cur: Column) -> Column:
        return F.timestamp_diff("MICROSECOND", prev["observed_at"], cur["observed_at"]) / 1e6

    return _segment(
        events, order, hours, ["observed_at"], lambda p, c: gap(p, c) >= gap_seconds,
        lambda p, c: F.concat(F.lit("time gap "), tx.format_gap(gap(p, c))), cap, minimum,
        F.when(F.col("n") >= cap, F.lit("size cap")).otherwise(F.lit("conversation end")))


def marker_cue_windows(events: DataFrame, order: list[str], cap: int = 20, minimum: int = 3, hours: int = 24):
    """Split where a user turn opens by announcing another subject. Only the cue flag and its
    words travel through the segmentation, not the text."""
    body = tx.strip(F.coalesce(F.col("text"), F.lit("")))
    said = F.left(F.regexp_extract(body, r"^([^.\n?!]*)", 1), F.lit(60))
    cue = (F.col("actor_type") == "user") & tx.matches(F.left(body, F.lit(120)), rules.TOPIC_CUE)
    rows = events.withColumn("cue", F.when(cue, said))
    return _segment(
        rows, order, hours, ["cue"], lambda p, c: p.isNotNull() & c["cue"].isNotNull(),
        lambda p, c: F.concat(F.lit("cue: '"), c["cue"], F.lit("'")), cap, minimum, F.lit("conversation end"))


def embedding_boundary_windows(turns: DataFrame, order: list[str], threshold: float = 0.72, cap: int = 20,
                               minimum: int = 3, hours: int = 24):
    """Split where the cosine to the previous turn's vector falls under the threshold."""

    def sim(p: Column, c: Column) -> Column:
        return vectors.cosine(p["vector"], c["vector"])

    return _segment(
        turns, order, hours, ["vector"], lambda p, c: sim(p, c) < threshold,
        lambda p, c: F.concat(F.lit("embedding shift (cos "), tx.fixed(sim(p, c), 2), F.lit(")")),
        cap, minimum, F.lit("conversation end"))


def preceding_assistant(events: DataFrame, order: list[str], reset: bool = False) -> DataFrame:
    """Newest assistant text before each row; with ``reset`` only when nothing but the
    assistant spoke since the last user turn. Empty turns are dropped first."""
    spoken = events.where(F.col("actor_type").isin("user", "assistant") & (tx.strip(F.coalesce("text", F.lit(""))) != ""))
    chunk = time_chunk(F.col("observed_at"))
    if not reset:
        said = F.when(F.col("actor_type") == "assistant", F.col("text"))
        return running(spoken, [KEY], order, chunk, Running(lasts={"preceding_text": said}))
    r = running(spoken, [KEY], order, chunk, Running(lags={"__role": F.col("actor_type"), "__text": F.col("text")}))
    return r.withColumn("preceding_text", F.when(F.col("__role") == "assistant", F.col("__text"))).drop("__role", "__text")


def failure_streaks(probes: DataFrame, key: str = "target") -> DataFrame:
    """Runs of consecutive failed probes (``at``, ``ok``, ``error``) per target."""
    r = running(probes, [key], ["at", "probe_id"], time_chunk(F.col("at")), Running(sums={"__island": F.col("ok").cast("bigint")}))
    return r.where(~F.col("ok")).groupBy(key, "__island").agg(
        F.min("at").alias("start_at"), F.max("at").alias("end_at"), F.count(F.lit(1)).alias("probes"),
        F.sort_array(F.collect_set("error")).alias("errors")).drop("__island")


def triage(turns: DataFrame, keys: list[str], min_events: int = rules.TRIAGE_MIN_EVENTS) -> DataFrame:
    """Verdict per window from the signals its user turns carry."""
    body = tx.strip(F.coalesce(F.col("text"), F.lit("")))
    user = (F.col("actor_type") == "user") & (body != "")

    def seen(pattern: str) -> Column:
        return F.bool_or(user & tx.matches(body, pattern))

    agg = turns.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(user).alias("n_user"), seen(r"\?").alias("q"),
        seen(rules.DELIBERATION).alias("d"), seen(rules.TECHNICAL_SHAPE).alias("t"),
        F.count_if(user & (F.length(body) >= rules.TRIAGE_MIN_CHARS)).alias("n_long"))
    found = F.array_compact(F.array(
        F.when(F.col("q"), "question"), F.when(F.col("d"), "deliberation-marker"), F.when(F.col("t"), "technical-shape")))
    big, spoke = F.col("n_events") >= min_events, F.col("n_user") > 0
    volume = F.col("n_long") >= rules.TRIAGE_MIN_SUBSTANTIVE
    signals = (F.when(~big | ~spoke, F.array().cast("array<string>")).when(F.size(found) > 0, found)
               .when(volume, F.array(F.lit("substantive-volume"))).otherwise(F.array().cast("array<string>")))
    reason = (F.when(~big, "below reasoning floor").when(~spoke, "no user turns in window")
              .when(F.size(found) > 0, F.concat(F.lit("reasoning signal: "), F.array_join(found, ", ")))
              .when(volume, "no marker but 3+ substantive user turns").otherwise("no signal"))
    return (agg.withColumn("send", big & spoke & ((F.size(found) > 0) | volume)).withColumn("signals", signals)
            .withColumn("reason", reason).select(*keys, "n_events", "n_user", "send", "reason", "signals"))


def anchor_turns(turns: DataFrame, order: list[str]) -> DataFrame:
    """First significant turn of a conversation anchors it; later refining or deciding turns,
    or further significant ones, attach to the anchor (``anchor_id``)."""
    mark = F.col("significant")
    first = turns.where(mark).groupBy(KEY).agg(
        F.min(F.struct(*order)).alias("__first"), F.min_by("event_id", F.struct(*order)).alias("__anchor"))
    after = F.struct(*order) > F.col("__first")
    attaches = after & (F.col("stage").isin("refining", "deciding") | mark)
    return turns.join(first, KEY, "left").withColumn(
        "anchor_id", F.when(F.coalesce(attaches, F.lit(False)), F.col("__anchor"))).drop("__first", "__anchor")


def pack_batch(ranked: DataFrame, order: list[Column], size: str, budget: int, most: int) -> DataFrame:
    """Leading rows whose sizes fit the budget, at least one and at most ``most``.

    The count limit comes first (a distributed top-k), so the running sum sees at most
    ``most`` rows.
    """
    head = ranked.orderBy(*order).limit(most)
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    total = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = head.withColumn("rn", F.row_number().over(w)).withColumn("running", total)
    before = F.col("running") - F.col(size)
    return kept.where((F.col("rn") == 1) | ((F.col("running") <= budget) & (before < budget)))


def turn_cap(turns: DataFrame, keys: list[str], room: Column, low: int = 200, high: int = 2000) -> DataFrame:
    """Largest per-turn cap with the summed cut lengths inside the room.

    Lengths are counted per (window, length) first: at most ``high`` rows per window reach
    the ordered step, however long the window is.
    """
    hist = turns.withColumn("len", F.least(F.length(tx.strip("text")), F.lit(high))).groupBy(*keys, "len").agg(
        F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys).orderBy("len")
    below = F.coalesce(F.sum(F.col("c") * F.col("len")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upward = F.sum("c").over(w.rowsBetween(0, Window.unboundedFollowing))
    shorter = F.coalesce(F.lag("len").over(w), F.lit(0))
    steps = hist.withColumns({"below": below, "upward": upward, "shorter": shorter})
    # In the segment (shorter, len] the cut total is below + upward * cap.
    fit = F.floor((room - F.col("below")) / F.col("upward"))
    reach = F.least(fit, F.col("len"))
    total_low = hist.groupBy(*keys).agg(
        F.sum(F.col("c") * F.least(F.col("len"), F.lit(low))).alias("at_low"),
        F.sum(F.col("c") * F.col("len")).alias("at_high"))
    best = steps.where(fit > F.col("shorter")).groupBy(*keys).agg(F.max(reach).alias("reach"))
    cap = (F.when(F.col("at_high") <= room, F.lit(high)).when(F.col("at_low") > room, F.lit(None))
           .otherwise(F.greatest(F.coalesce("reach", F.lit(0)), F.lit(low))))
    return total_low.join(best, keys, "left").select(*keys, cap.cast("bigint").alias("cap"), (F.col("at_low") > room).alias("too_long"))
