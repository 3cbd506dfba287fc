"""Review ledger: queues, states, supersession, promotion and thread rollups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions import rules, text as tx
from memlake.operators.scan import Running, number_rows, running, time_chunk, top_k
from memlake.session import broadcast_if_small, settle

EXCLUDED = ["rejected", "superseded_by_reasoning", "superseded_by_correction"]
_UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def tier(kind: Column) -> Column:
    return F.when(F.coalesce(kind, F.lit("")).isin(*rules.TIER1_KINDS), 1).otherwise(2)


def episode_priority(kind: Column, n_evidence: Column) -> Column:
    strong = F.coalesce(kind, F.lit("")).isin(*rules.STRONG_KINDS)
    return (F.when(strong & (n_evidence >= 3), "priority")
            .when((strong & (n_evidence == 2)) | (~strong & (n_evidence >= 5)), "maybe").otherwise("low"))


def cause_of(reason: Column) -> Column:
    """First matching cause tag of a rejection reason."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    out = F.when(F.lit(False), "")
    for tag, pattern in rules.CAUSES:
        out = out.when(tx.matches(low, pattern), tag)
    return out.otherwise("other")


def split_for(run_date: Column, final: Column, dev_start: str, test_start: str) -> Column:
    """Time split of labelled items; unlabelled ones before the test period stay apart."""
    return (F.when(run_date >= test_start, "test").when(~F.coalesce(final, F.lit("")).isin("approve", "reject", "flag"), "unlabeled")
            .when(run_date >= dev_start, "dev").otherwise("train"))


def parse_ids(memory_id: Column) -> Column:
    """Struct (conversation, windows): the first uuid, then the other uuids and the window
    index; windows are null when the id names none."""
    found = F.regexp_extract_all(memory_id, F.lit(_UUID), F.lit(0))
    conv = F.get(found, F.lit(0))
    others = F.filter(found, lambda u: u != conv)
    idx = F.nullif(F.regexp_extract(memory_id, r":(\d+)::", 1), F.lit(""))
    return F.struct(conv.alias("conversation"), F.when(F.size(others) > 0, F.array_compact(F.concat(others, F.array(idx)))).alias("windows"))


# --- joins -------------------------------------------------------------------------


def unpromoted_tier1(memories: DataFrame, promotions: DataFrame, graph: str) -> DataFrame:
    done = promotions.where((F.col("graph_name") == graph) & (F.col("status") == "succeeded")).select("memory_id")
    return memories.where((tier(F.col("reasoning_kind")) == 1) & ~F.col("approval_state").isin(*EXCLUDED)).join(done, "memory_id", "left_anti")


def resolve_evidence(evidence: DataFrame, events: DataFrame, max_chars: int = 1200) -> DataFrame:
    """Cited turns in citation order: missing flag, text cut at ``max_chars`` and a cut flag."""
    e = events.select("event_id", "actor_type", "harness", "observed_at", tx.strip("text").alias("__t"), F.lit(True).alias("__hit"))
    j = evidence.join(e, "event_id", "left")
    return j.select(
        "memory_id", "pos", "event_id", F.col("__hit").isNull().alias("missing"), "actor_type", "harness", "observed_at",
        F.left("__t", F.lit(max_chars)).alias("text"), F.coalesce(F.length("__t") > max_chars, F.lit(False)).alias("truncated"))


def mark_covered(queued: DataFrame, episode_evidence: DataFrame) -> DataFrame:
    """Queued rows whose event some episode cites, with the first such episode."""
    cover = episode_evidence.groupBy("event_id").agg(F.min("memory_id").alias("superseded_by"))
    return queued.join(cover, "event_id").withColumn("approval_state", F.lit("superseded_by_reasoning"))


def bucket_of(memories: DataFrame, overrides: DataFrame, bucket_rules: list[tuple[str, str]], default: str = "misc") -> DataFrame:
    """Project per row: exact thread override, else the first matching rule over the thread
    key (over the statement only where there is no key)."""
    text = F.replace(F.coalesce(F.nullif(F.trim("thread_key"), F.lit("")), F.col("statement"), F.lit("")), F.lit("_"), F.lit("-"))
    rule = F.when(F.lit(False), "")
    for bucket, pattern in bucket_rules:
        rule = rule.when(tx.matches(text, pattern), bucket)
    from memlake.session import broadcast_if_small

    o = broadcast_if_small(overrides.select("thread_key", F.col("bucket").alias("__o")))
    return memories.join(o, "thread_key", "left").withColumn("bucket", F.coalesce("__o", rule.otherwise(default))).drop("__o")


def backfill_projects(memories: DataFrame, overrides: DataFrame, bucket_rules) -> DataFrame:
    """Thread key from the reason and project from the rules, only where they are null."""
    key = F.coalesce("thread_key", tx.reason_field(F.col("reason"), "thread"))
    filled = bucket_of(memories.withColumn("thread_key", key), overrides, bucket_rules)
    return filled.withColumn("project", F.coalesce("project", "bucket")).drop("bucket")


def attach_valid_at(items: DataFrame, events: DataFrame) -> DataFrame:
    """Own event date, else the source event's time with precision ``conversation``."""
    e = events.select("event_id", F.col("observed_at").alias("__at"))
    j = items.join(e, "event_id", "left")
    fallback = F.col("event_date").isNull() & F.col("__at").isNotNull()
    return j.withColumns({"valid_at": F.coalesce("event_date", "__at"),
                          "valid_precision": F.when(fallback, "conversation").otherwise(F.col("date_precision"))}).drop("__at")


def expand_evidence(requests: DataFrame, memories: DataFrame, evidence: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejected requests): an id is good when it exists in the memory's own
    conversation, and a request with any bad id adds nothing."""
    anchor = memories.select("memory_id", "event_id").join(events.select("event_id", "conversation_id"), "event_id", "left")
    r = requests.join(anchor.select("memory_id", F.col("conversation_id").alias("__want")), "memory_id")
    r = r.join(events.select("event_id", F.col("conversation_id").alias("__have")), "event_id", "left")
    r = r.withColumn("bad", F.coalesce(F.col("__want") != F.col("__have"), F.lit(True)))
    bad = r.where("bad").select("memory_id", "event_id")
    good = r.where("not bad").select("memory_id", "event_id").join(bad.select("memory_id").distinct(), "memory_id", "left_anti")
    return good.join(evidence.select("memory_id", "event_id"), ["memory_id", "event_id"], "left_anti").distinct(), bad


# --- states and batches ---------------------------------------------------------------


def current_state(audit: DataFrame) -> DataFrame:
    """Newest audit row per item."""
    return audit.groupBy("memory_id").agg(F.max_by(F.struct("new_state", "batch_id", "actor", "at"), F.struct("at", "audit_id")).alias("s")).select("memory_id", "s.*")


def bulk_reject_plan(memories: DataFrame, state: str, category: str | None, before) -> DataFrame:
    """Rows a bulk reject would touch. A null date is never before the cutoff."""
    out = memories.where(F.col("approval_state") == state)
    if category is not None:
        out = out.where(F.col("category") == category)
    return out if before is None else out.where(F.col("event_date") < F.lit(before).cast("timestamp_ntz"))


def bulk_audit_rows(touched: DataFrame, action: str, new_state: str, batch_id: str) -> DataFrame:
    return touched.select("memory_id", F.lit(action).alias("action"), F.col("approval_state").alias("prior_state"),
                          F.lit(new_state).alias("new_state"), F.lit(batch_id).alias("batch_id"))


def revert_batch(memories: DataFrame, audit: DataFrame, batch_id: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the batch with ``restored_state``, refusal). A bulk action starts from one
    state, so a batch whose rows had several is refused: nothing is restored, and the refusal
    has (batch_id, prior_state, rows). A batch that isn't known gives neither."""
    rows = audit.where(F.col("batch_id") == batch_id)
    states = rows.groupBy("batch_id", "prior_state").agg(F.count(F.lit(1)).alias("rows"))
    spread = states.groupBy("batch_id").agg(F.count(F.lit(1)).alias("__n"), F.min("prior_state").alias("restored_state"))
    touched = rows.select("memory_id", "batch_id").distinct().join(broadcast_if_small(spread.where("__n = 1")), "batch_id").select("memory_id", "restored_state")
    return memories.join(touched, "memory_id"), states.join(spread.where("__n > 1").select("batch_id"), "batch_id")


def restore_rows(memories: DataFrame, audit: DataFrame, batch_id: str) -> DataFrame:
    """Memories that a batch touched with ``restored_state``, each its own state before the
    batch's first row of it. The audit keeps every row's prior state, so a batch that started
    from several states is undone row by row."""
    first = audit.where(F.col("batch_id") == batch_id).groupBy("memory_id").agg(F.min_by("prior_state", F.struct("at", "audit_id")).alias("restored_state"))
    return memories.join(first, "memory_id")


def correct(memories: DataFrame, corrections: DataFrame) -> DataFrame:
    """Whole table after corrections: old rows closed with a forward link, new rows queued
    with a back link. ``corrections``: memory_id, new_statement, reviewer, why."""
    j = memories.join(corrections, "memory_id", "left").withColumn("new_id", F.concat("memory_id", F.lit("::corrected")))
    hit = F.col("new_statement").isNotNull()
    versions = F.when(hit, F.array(F.lit("old"), F.lit("new"))).otherwise(F.array(F.lit("old")))
    r = j.withColumn("__v", F.explode(versions))
    new = F.col("__v") == "new"
    return r.select(
        F.when(new, F.col("new_id")).otherwise(F.col("memory_id")).alias("memory_id"), "event_id", "category",
        F.when(new, F.col("new_statement")).otherwise(F.col("statement")).alias("statement"),
        F.when(new, F.concat("reason", F.lit(" | corrected by "), "reviewer", F.lit(": "), "why")).otherwise(F.col("reason")).alias("reason"),
        F.when(new, "queued_for_review").when(hit, "superseded_by_correction").otherwise(F.col("approval_state")).alias("approval_state"),
        F.when(new, F.col("memory_id")).alias("supersedes"), F.when(~new & hit, F.col("new_id")).alias("superseded_by"))


def stale_versions(memories: DataFrame, state: str) -> DataFrame:
    """Rows in ``state`` whose policy version is not the newest of their event over all
    states; versions compare number by number."""
    v = F.transform(F.split("policy_version", r"\."), lambda x: x.cast("int"))
    newest = memories.groupBy("event_id").agg(F.max(v).alias("__newest"))
    return memories.where(F.col("approval_state") == state).join(newest, "event_id").where(v != F.col("__newest")).drop("__newest")


def supersedes_chain(memories: DataFrame) -> DataFrame:
    """Each derivation with the one before it on the same event."""
    return running(memories, ["event_id"], ["created_at", "memory_id"], time_chunk(F.col("created_at")), Running(lags={"supersedes": F.col("memory_id")}))


def next_names(new: DataFrame, used: DataFrame, order: list[str]) -> DataFrame:
    """Episode names ``<harness>-<project>-NNN`` going on from each prefix's highest number.

    ``used``: names already given. Numbering runs over time chunks, so one busy prefix is
    spread over tasks.
    """
    prefix = F.concat(tx.slug(F.col("harness"), default="misc"), F.lit("-"), tx.slug(F.col("project"), default="misc"))
    top = used.select(F.regexp_extract("name", r"^(.*)-(\d+)$", 1).alias("prefix"), F.regexp_extract("name", r"-(\d+)$", 1).try_cast("bigint").alias("n"))
    top = top.groupBy("prefix").agg(F.max("n").alias("__top"))
    n = number_rows(new.withColumn("prefix", prefix), ["prefix"], order, time_chunk(F.col(order[0])), "__rn")
    no = F.coalesce("__top", F.lit(0)) + F.col("__rn")
    digits = F.greatest(F.length(no.cast("string")), F.lit(3))
    return n.join(top, "prefix", "left").withColumn("name", F.concat("prefix", F.lit("-"), F.lpad(no.cast("string"), digits, F.lit("0")))).drop("__top", "__rn", "prefix")


def thread_rollup(episodes: DataFrame) -> DataFrame:
    """One row per thread: order-free aggregates only, so late rows and partial merges give
    the same result. Small sets come as ordered arrays (first appearance); conversations,
    which may be many, as a count with ``thread_members`` holding the rows.
    """
    by = F.struct("observed_at", "memory_id")
    main = episodes.groupBy("thread_key").agg(
        F.min("observed_at").alias("first_seen_at"), F.min_by("event_id", by).alias("first_event_id"),
        F.max("observed_at").alias("last_seen_at"), F.max_by("event_id", by).alias("last_event_id"),
        F.max_by("status", F.when(F.col("status").isNotNull(), by)).alias("status"),
        F.count(F.lit(1)).alias("episode_count"), F.count_distinct("conversation_id").alias("n_conversations"))
    sets = ordered_unions(episodes, "thread_key", {"harness": "harnesses", "reasoning_kind": "kinds", "project": "projects"}, by)
    return main.join(sets, "thread_key", "left")


def ordered_unions(df: DataFrame, key: str, columns: dict[str, str], by: Column) -> DataFrame:
    """Distinct values per key in order of first appearance, for several columns in one pass.
    Values are made distinct before they are gathered: each array is as long as the value
    set, not as the group."""
    pairs = F.array(*[F.struct(F.lit(n).alias("set"), F.col(c).cast("string").alias("value")) for c, n in columns.items()])
    long = df.select(key, by.alias("by"), F.explode(pairs).alias("p")).select(key, "by", "p.set", "p.value").where("value IS NOT NULL")
    firsts = long.groupBy(key, "set", "value").agg(F.min("by").alias("first"))
    gathered = [F.transform(F.array_sort(F.collect_list(F.when(F.col("set") == n, F.struct("first", "value")))), lambda x: x["value"]).alias(n) for n in columns.values()]
    return firsts.groupBy(key).agg(*gathered)


def thread_members(episodes: DataFrame) -> DataFrame:
    """(thread, conversation) rows with first and last sight and episode counts."""
    return episodes.groupBy("thread_key", "conversation_id").agg(
        F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"), F.count(F.lit(1)).alias("episodes"))


def scoped_threads(episodes: DataFrame, conversation, project: str | None, as_of, days: int = 14, limit: int = 20) -> DataFrame:
    """Threads that were candidates at ``as_of``: this conversation's first, else the same
    project's of the last days unless resolved. Nothing later than ``as_of`` is read."""
    at = F.lit(as_of).cast("timestamp_ntz")
    here = F.col("conversation_id") == conversation
    known = project is not None and project not in rules.UNKNOWN_PROJECTS
    near = (F.col("project") == project) & (F.col("event_date") >= at - F.make_dt_interval(days=F.lit(days))) if known else F.lit(False)
    by = F.struct("event_date", "memory_id")
    g = episodes.where((F.col("event_date") <= at) & F.col("thread_key").isNotNull()).groupBy("thread_key").agg(
        F.bool_or(here).alias("current"), F.max_by(F.struct("event_date", "status", "statement"), F.when(here, by)).alias("c"),
        F.max_by(F.struct("event_date", "status", "statement"), F.when(near, by)).alias("n"))
    g = g.withColumn("x", F.coalesce("c", "n")).where(F.col("x").isNotNull() & (F.col("current") | (F.col("x.status") != "resolved")))
    out = g.select("thread_key", "current", F.col("x.event_date").alias("last_seen_at"), F.col("x.statement").alias("latest_statement"), F.col("x.status").alias("status"))
    return out.orderBy(F.desc("current"), F.desc("last_seen_at"), F.desc("thread_key")).limit(limit)


# --- merging --------------------------------------------------------------------------------


def chunk_by_budget(df: DataFrame, keys: list[str], order: list[str], size: str, budget: int, block_rows: int = 4096, hours: int = 24) -> DataFrame:
    """``part`` (from 1): consecutive runs whose summed size stays inside the budget; an item
    over it gets a run of its own.

    Greedy runs depend on where the last one began, so each key is cut into blocks: a block
    reports what it does to every carried-in size that matters (a short list, since a run
    never carries more than the budget), the reports are chained per key, and each block is
    then numbered from its true carry. No task ever holds more than one block of rows.
    """
    types = dict(df.dtypes)
    key_ddl = ", ".join(f"`{k}` {types[k]}" for k in keys)
    total = df.groupBy(*keys).agg((F.sum(size) <= budget).alias("__fits"))
    rows = number_rows(df, keys, order, time_chunk(F.col(order[0]), hours), "__rn").join(total, keys)
    whole = rows.where("__fits").withColumn("part", F.lit(1).cast("bigint")).drop("__rn", "__fits")
    rows = rows.where("not __fits").drop("__fits").withColumn("__b", F.floor((F.col("__rn") - 1) / block_rows))
    slim = rows.select(*keys, "__b", "__rn", F.col(size).cast("bigint").alias("__sz"))

    def ordered(table: pa.Table, by: str) -> pa.Table:
        return table.take(pa.array(np.argsort(table[by].to_numpy(), kind="stable")))

    def jumps(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums, and for a run begun at each row the row where the next begins."""
        pre = np.concatenate(([0], np.cumsum(sizes)))
        nxt = np.maximum(np.searchsorted(pre, pre[:-1] + budget, side="right") - 1, np.arange(len(sizes)) + 1)
        return pre, nxt

    def report(table: pa.Table) -> pa.Table:
        table = ordered(table, "__rn")
        pre, nxt = jumps(table["__sz"].to_numpy())
        n = table.num_rows
        breaks, carry = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
        for a in range(n - 1, -1, -1):  # runs begun at a: how many follow, and what the last carries out
            b = nxt[a]
            breaks[a], carry[a] = (1, pre[n] - pre[a]) if b >= n else (breaks[b] + 1, carry[b])
        first = np.flatnonzero(pre[:-1] <= budget)  # a carried-in run breaks at one of these
        head = table.slice(0, 1).select([*keys, "__b"])
        for name, value in (("total", int(pre[n])), ("upto", pre[first + 1].tolist()), ("breaks", breaks[first].tolist()), ("carry", carry[first].tolist())):
            head = head.append_column(name, pa.array([value], pa.int64() if name == "total" else pa.list_(pa.int64())))
        return head

    reports = slim.groupBy(*keys, "__b").applyInArrow(report, f"{key_ddl}, `__b` bigint, total bigint, upto array<bigint>, breaks array<bigint>, carry array<bigint>")

    def chain(table: pa.Table) -> pa.Table:
        table = ordered(table, "__b")
        held, runs, out = 0, 0, []
        for total, upto, breaks, carry in zip(*(table[c].to_pylist() for c in ("total", "upto", "breaks", "carry"))):
            out.append((held, runs))
            at = 0 if runs == 0 else int(np.searchsorted(np.asarray(upto), budget - held, side="right"))
            if runs and at >= len(upto):
                held += total
            else:
                held, runs = int(carry[at]), runs + int(breaks[at])
        return table.select([*keys, "__b"]).append_column("held", pa.array([o[0] for o in out], pa.int64())).append_column("runs", pa.array([o[1] for o in out], pa.int64()))

    starts = reports.groupBy(*keys).applyInArrow(chain, f"{key_ddl}, `__b` bigint, held bigint, runs bigint")

    def number(table: pa.Table) -> pa.Table:
        table = ordered(table, "__rn")
        pre, nxt = jumps(table["__sz"].to_numpy())
        held, runs, n = table["held"][0].as_py(), table["runs"][0].as_py(), table.num_rows
        part = np.empty(n, dtype=np.int64)
        at = 0 if runs == 0 else int(np.searchsorted(pre[1:], budget - held, side="right"))
        part[:at] = runs
        while at < n:
            runs += 1
            part[at:nxt[at]] = runs
            at = nxt[at]
        return table.select([*keys, "__rn"]).append_column("part", pa.array(part))

    numbered = slim.join(starts, [*keys, "__b"]).groupBy(*keys, "__b").applyInArrow(number, f"{key_ddl}, `__rn` bigint, part bigint")
    return whole.unionByName(rows.join(numbered, [*keys, "__rn"]).drop("__rn", "__b"))


def merge_threads(episodes: DataFrame, evidence: DataFrame, budget: int = rules.THREAD_MERGE_CHAR_BUDGET) -> DataFrame:
    """Tier-1 episodes of one conversation and thread merged into one per part of at most the
    budget: numbered statements in date order, least confidence, kind by fixed priority.
    Parts of a single episode stay as they were. Part sizes are bounded by the budget.
    """
    keys = ["conversation_id", "thread_key"]
    t1 = episodes.where(tier(F.col("reasoning_kind")) == 1).withColumn("thread_key", tx.slug(F.col("thread_key")))
    t1 = t1.withColumn("__at", F.coalesce("event_date", F.lit("0001-01-01").cast("timestamp_ntz"))).withColumn("__size", F.length("statement"))
    parts = chunk_by_budget(t1, keys, ["__at", "memory_id"], "__size", budget)
    rank = F.array_position(F.array(*[F.lit(k) for k in rules.MERGE_KIND_ORDER]), F.col("reasoning_kind"))
    by = F.struct("__at", "memory_id")
    merged = parts.groupBy(*keys, "part").agg(
        F.count(F.lit(1)).alias("n_members"), F.array_sort(F.collect_list(F.struct("__at", "memory_id", "statement"))).alias("m"),
        F.min("confidence").alias("confidence"), F.min_by("reasoning_kind", F.struct(F.when(rank > 0, rank), by)).alias("reasoning_kind"),
        F.max_by("status", by).alias("status"), F.min_by("event_date", by).alias("event_date"))
    split = parts.groupBy(*keys).agg(F.max("part").alias("n_parts"))
    merged = merged.where(F.col("n_members") > 1).join(split, keys)
    numbered = F.array_join(F.transform("m", lambda x, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), x["statement"])), "; ")
    mid = F.concat(F.lit("reason:threadmerge:"), F.col("conversation_id").cast("string"), F.lit(":"), "thread_key",
                   F.when(F.col("n_parts") > 1, F.concat(F.lit("::part"), F.col("part").cast("string"))).otherwise(""))
    return merged.select(mid.alias("memory_id"), *keys, "part", "n_members", numbered.alias("statement"), "confidence", "reasoning_kind", "status",
                         "event_date", F.transform("m", lambda x: x["memory_id"]).alias("members"))


def retire_absorbed(children: DataFrame, merged: DataFrame, child_evidence: DataFrame, merged_evidence: DataFrame, reviewed: DataFrame, promoted: DataFrame) -> DataFrame:
    """Children a merge may retire: queued, unreviewed, unpromoted, statement contained in the
    merged one and no evidence outside it. ``children`` carries ``merged_id``."""
    c = children.where(F.col("approval_state") == "queued").join(reviewed.select("memory_id"), "memory_id", "left_anti").join(
        promoted.select("memory_id"), "memory_id", "left_anti")
    c = c.join(merged.select(F.col("memory_id").alias("merged_id"), F.col("statement").alias("__m")), "merged_id").where(F.col("__m").contains(F.col("statement")))
    loose = c.select("memory_id", "merged_id").join(child_evidence, "memory_id").join(
        merged_evidence.select(F.col("memory_id").alias("merged_id"), "event_id"), ["merged_id", "event_id"], "left_anti").select("memory_id").distinct()
    return c.join(loose, "memory_id", "left_anti").select("memory_id", F.col("merged_id").alias("superseded_by"))


def manual_merge(requests: DataFrame, memories: DataFrame, promotions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged rows, refused requests with the reason). ``requests``: merge_id, memory_id.

    A merge holds 2 to 20 queued, unpromoted items of one conversation and one project.
    """
    j = requests.join(memories, "memory_id", "left").join(promotions.select("memory_id").distinct().withColumn("__p", F.lit(True)), "memory_id", "left")
    by = F.struct("created_at", "memory_id")
    g = j.groupBy("merge_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("event_id").alias("known"), F.min("conversation_id").alias("conversation_id"), F.max("conversation_id").alias("__c2"),
        F.min(F.coalesce("project", F.lit(""))).alias("project"), F.max(F.coalesce("project", F.lit(""))).alias("__p2"),
        F.bool_or(F.col("approval_state") != "queued").alias("__busy"), F.bool_or(F.coalesce("__p", F.lit(False))).alias("__prom"),
        F.min("confidence").alias("confidence"), F.min("event_date").alias("__d1"), F.max("event_date").alias("__d2"), F.count("event_date").alias("__dn"),
        F.min_by("memory_id", by).alias("supersedes"), F.min("thread_key").alias("__t1"), F.max("thread_key").alias("__t2"))
    problem = (F.when(~F.col("n").between(2, 20), "size").when(F.col("known") < F.col("n"), "unknown item").when(F.col("conversation_id") != F.col("__c2"), "several conversations")
               .when(F.col("__busy"), "not pending").when(F.col("__prom"), "promoted").when(F.col("project") != F.col("__p2"), "several projects"))
    g = g.withColumn("problem", problem)
    same_date = (F.col("__dn") == F.col("n")) & (F.col("__d1") == F.col("__d2"))
    ok = g.where(F.col("problem").isNull()).select(
        "merge_id", "n", "conversation_id", "project", "confidence", F.when(same_date, F.col("__d1")).alias("event_date"), "supersedes",
        F.when(F.col("__t1") == F.col("__t2"), F.col("__t1")).alias("thread_key"))
    return ok, g.where(F.col("problem").isNotNull()).select("merge_id", "n", "problem")


# --- review reports ----------------------------------------------------------------------------


def review_conversations(episodes: DataFrame, docs: DataFrame, tier2_only: bool = False) -> DataFrame:
    """Pending items per conversation; harness and project are the first known ones."""
    e = episodes.select("conversation_id", "harness", "project", "ord", F.when(tier(F.col("reasoning_kind")) == 1, "t1").otherwise("t2").alias("kind"))
    both = e.unionByName(docs.select("conversation_id", "harness", "project", "ord", F.lit("doc").alias("kind"))).where(F.col("conversation_id").isNotNull())
    first = F.struct(F.when(F.col("kind") == "doc", 1).otherwise(0), "ord")
    g = both.groupBy("conversation_id").agg(
        F.min_by("harness", F.when(F.col("harness").isNotNull(), first)).alias("harness"),
        F.min_by("project", F.when(F.col("project").isNotNull(), first)).alias("project"),
        F.count_if(F.col("kind") == "t1").alias("tier1"), F.count_if(F.col("kind") == "t2").alias("tier2"), F.count_if(F.col("kind") == "doc").alias("docs"))
    g = g if tier2_only else g.where(F.col("tier1") + F.col("docs") > 0)
    return g.orderBy(F.coalesce("project", F.lit("~")), F.desc(F.col("tier1") + F.col("docs")), "conversation_id")


def queue_buckets(memories: DataFrame, states: DataFrame) -> DataFrame:
    """Per project: tier counts, reviewed tier-1 rows and rows still queued."""
    m = memories.where(~F.col("approval_state").isin(*EXCLUDED)).join(states.select("memory_id", "new_state"), "memory_id", "left")
    t1, seen = tier(F.col("reasoning_kind")) == 1, F.col("new_state").isNotNull()
    return m.groupBy(F.coalesce("project", F.lit("misc")).alias("project")).agg(
        F.count_if(t1).alias("tier1"), F.count_if(~t1).alias("tier2"), F.count_if(t1 & seen).alias("reviewed"), F.count_if(t1 & ~seen).alias("queued"))


def priority_order(memories: DataFrame, n_evidence: DataFrame) -> DataFrame:
    """Review report rows: conversations by their best label then priority count, items by label."""
    m = memories.join(n_evidence, "memory_id", "left").withColumn("label", episode_priority(F.col("reasoning_kind"), F.coalesce("n_evidence", F.lit(0))))
    rank = F.when(F.col("label") == "priority", 0).when(F.col("label") == "maybe", 1).otherwise(2)
    m = m.withColumn("label_rank", rank)
    c = m.groupBy("conversation_id").agg(F.min("label_rank").alias("best"), F.count_if(F.col("label") == "priority").alias("n_priority"))
    return m.join(c, "conversation_id").orderBy("best", F.desc("n_priority"), "conversation_id", "label_rank", "memory_id")


def nightly_batch(pending: DataFrame, seen: DataFrame, docs: DataFrame, cap: int = 50) -> DataFrame:
    """Oldest unseen items up to the cap, labelled ``EP1..`` and ``DOC1..``; documents get at
    least a fifth of the batch where there are that many."""
    from pyspark.sql import Window

    def oldest(df: DataFrame, at: str) -> DataFrame:
        return df.join(seen, "item_id", "left_anti").orderBy(at, "item_id").limit(cap).withColumn(
            "rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(at, "item_id")))

    eps, dcs = oldest(pending, "at"), oldest(docs, "at")
    ne, nd = (x.agg(F.count(F.lit(1))).scalar() for x in (eps, dcs))
    take_docs = F.least(nd, F.greatest(F.lit(cap // 5), F.lit(cap) - ne))
    both = eps.select("item_id", "rn", F.lit("EP").alias("kind")).union(dcs.select("item_id", "rn", F.lit("DOC").alias("kind")))
    return both.where(F.col("rn") <= F.when(F.col("kind") == "EP", F.lit(cap) - take_docs).otherwise(take_docs)).select(
        F.concat("kind", F.col("rn").cast("string")).alias("label"), "item_id", F.col("rn").alias("batch_no"))


def duplicate_hints(tonight: DataFrame, earlier: DataFrame, weak_limit: int = 6) -> DataFrame:
    """(label, hint, ref) rows: items with the same source windows, and up to ``weak_limit``
    items of the same thread in another conversation. Tonight's items also meet those before
    them. Tonight is one capped batch; the earlier side is never joined to itself.

    Both take item_id, conversation_id, thread_key, wins (array or null); ``tonight`` also
    label and batch_no, ``earlier`` also ref.
    """
    t = settle(tonight.select("label", "conversation_id", "thread_key", "wins", "batch_no"))  # read by both sides
    prior = earlier.select("ref", "conversation_id", "thread_key", "wins", F.lit(0).alias("batch_no")).unionByName(
        t.select(F.concat(F.lit("tonight "), "label").alias("ref"), "conversation_id", "thread_key", "wins", "batch_no"))
    p = prior.select("ref", F.col("conversation_id").alias("c2"), "thread_key", "wins", F.col("batch_no").alias("b2"))
    before = F.col("b2") < F.col("batch_no")
    strong = p.drop("thread_key").join(t.drop("thread_key"), "wins").where(before).select("label", "ref").distinct()
    weak = p.drop("wins").join(t.drop("wins"), "thread_key").where(before & ~F.col("c2").eqNullSafe(F.col("conversation_id"))).select("label", "ref").distinct()
    weak = top_k(weak.join(strong, ["label", "ref"], "left_anti"), ["label"], [F.col("ref")], weak_limit)
    return strong.select("label", F.lit("likely_duplicate_of").alias("hint"), "ref").union(weak.select("label", F.lit("same_thread_as").alias("hint"), "ref"))


# --- reconciliation --------------------------------------------------------------------------------


def reconcile(existing: DataFrame, incoming: DataFrame, rejected: DataFrame) -> DataFrame:
    """Plan of an upsert: match by candidate id, else by name; rejected names are discarded,
    nameless rows are errors, unchanged rows are kept."""
    i = incoming.join(rejected.select("name").distinct().withColumn("__r", F.lit(True)), "name", "left")
    by_id = existing.select("candidate_id", F.col("record_id").alias("r1"), F.col("body").alias("b1"))
    by_name = existing.groupBy("name").agg(F.min("record_id").alias("r2"), F.min_by("body", "record_id").alias("b2"))
    j = i.join(by_id, "candidate_id", "left").join(by_name, "name", "left")
    rec, old = F.coalesce("r1", "r2"), F.when(F.col("r1").isNotNull(), F.col("b1")).otherwise(F.col("b2"))
    action = (F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "error").when(F.col("__r"), "discarded").when(rec.isNull(), "created")
              .when(old == F.col("body"), "unchanged").otherwise("updated"))
    return j.select("candidate_id", "name", action.alias("action"), rec.alias("record_id"))


def redate(requests: DataFrame, memories: DataFrame, events: DataFrame, promotions: DataFrame) -> DataFrame:
    """Outcome per request (memory_id, new_date or null): refused when promoted, else the given
    date, else the source event's time."""
    j = requests.join(memories.select("memory_id", "event_id", F.col("event_date").alias("prior_date")), "memory_id").join(
        events.select("event_id", "observed_at"), "event_id", "left").join(
        promotions.select("memory_id").distinct().withColumn("__p", F.lit(True)), "memory_id", "left")
    at = F.coalesce("new_date", "observed_at")
    outcome = (F.when(F.col("__p"), "promoted").when(at.isNull(), "no date").when(at.eqNullSafe(F.col("prior_date")), "unchanged").otherwise("changed"))
    precision = F.when(F.col("new_date").isNull(), "exact").otherwise(F.when(F.col("new_date") == F.date_trunc("DAY", "new_date"), "day").otherwise("exact"))
    return j.select("memory_id", outcome.alias("outcome"), F.when(outcome == "changed", at).alias("event_date"), F.when(outcome == "changed", precision).alias("date_precision"))


def retag_pending(memories: DataFrame, overrides: DataFrame, bucket_rules, reviewed: DataFrame, promoted: DataFrame) -> DataFrame:
    """New project per unreviewed, unpromoted row, only where it changes."""
    open_ = memories.join(reviewed.select("memory_id"), "memory_id", "left_anti").join(promoted.select("memory_id"), "memory_id", "left_anti")
    b = bucket_of(open_, overrides, bucket_rules)
    return b.where(~F.col("project").eqNullSafe(F.col("bucket"))).select("memory_id", F.col("project").alias("old_project"), F.col("bucket").alias("new_project"))


def cascade_discard(memories: DataFrame, jobs: DataFrame, audit: DataFrame, promotions: DataFrame, doomed: Column) -> DataFrame:
    """What discarding a class of conversations does, one row per memory: ``blocked`` when a
    human reviewed it or it was promoted, else ``discard``; with the jobs that go too."""
    m = memories.where(doomed)
    human = audit.where(F.col("actor") == "human").select("memory_id").distinct().withColumn("__h", F.lit(True))
    prom = promotions.select("memory_id").distinct().withColumn("__p", F.lit(True))
    nj = jobs.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_jobs"))
    j = m.join(human, "memory_id", "left").join(prom, "memory_id", "left").join(nj, "event_id", "left")
    why = F.when(F.col("__p"), "promoted").when(F.col("__h"), "human-reviewed")
    return j.select("memory_id", "thread_key", F.when(why.isNull(), "discard").otherwise("blocked").alias("action"), F.coalesce(why, F.lit("")).alias("why"), F.coalesce("n_jobs", F.lit(0)).alias("n_jobs"))


def mirror_audit(ledger: DataFrame, mirrors: DataFrame) -> DataFrame:
    """Missing, stale and surplus mirror rows against the ledger (memory_id, state)."""
    j = ledger.select("memory_id", F.col("state").alias("want"), F.lit(True).alias("__l")).join(
        mirrors.select("memory_id", F.col("state").alias("have"), F.lit(True).alias("__m")), "memory_id", "full")
    problem = (F.when(F.col("__m").isNull(), "restore").when(F.col("__l").isNull(), "surplus").when(F.col("want") != F.col("have"), "synchronize"))
    return j.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("memory_id", "problem", F.coalesce("want", F.lit("")).alias("want"))


def drift(ledger_ids: DataFrame, graph_ids: DataFrame) -> DataFrame:
    """Promoted but not in the graph, and in the graph but never promoted."""
    a, b = ledger_ids.select("memory_id").distinct(), graph_ids.select("memory_id").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("missing_in_graph")).union(b.exceptAll(a).withColumn("side", F.lit("not_promoted")))
