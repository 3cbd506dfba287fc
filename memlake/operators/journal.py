"""Journal operators: filters, idempotent append, retention, status aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions import rules, text as tx
from memlake.operators.scan import first_per
from memlake.session import broadcast_if_small


def read_events(events: DataFrame, harness: str | None = None, conversation=None, since: str | None = None,
                until: str | None = None) -> DataFrame:
    """Inclusive filters, all of which reach the scan."""
    out = events
    if harness is not None:
        out = out.where(F.col("harness") == harness)
    if conversation is not None:
        out = out.where(F.col("conversation_id") == conversation)
    if since is not None:
        out = out.where(F.col("observed_at") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        out = out.where(F.col("observed_at") <= F.lit(until).cast("timestamp_ntz"))
    return out


def new_events(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to append: the first of each incoming id that the journal does not hold."""
    return incoming.dropDuplicates(["event_id"]).join(existing.select("event_id"), "event_id", "left_anti")


def append_counts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row: offered, inserted, deduplicated."""
    offered = incoming.agg(F.count(F.lit(1)).alias("offered"))
    inserted = new_events(existing, incoming.select("event_id")).agg(F.count(F.lit(1)).alias("inserted"))
    both = offered.withColumn("inserted", inserted.scalar())
    return both.select("offered", "inserted", (F.col("offered") - F.col("inserted")).alias("deduped"))


def as_json_lines(events: DataFrame, columns: list[str]) -> DataFrame:
    """One compact JSON text per row, fields sorted by name."""
    return events.select(*columns, F.to_json(F.struct(*sorted(columns))).alias("line"))


def apply_retention(events: DataFrame) -> DataFrame:
    """Excluded rows dropped; redacted and summarised content scrubbed; raw kept."""
    scrub = F.col("retention_class").isin("redacted", "summarized")
    return events.where(F.col("retention_class") != "excluded").withColumn(
        "content", F.when(scrub, tx.redact(F.col("content"))).otherwise(F.col("content")))


def capture_allow(calls: DataFrame, denied_tools: DataFrame, denied_clients: DataFrame) -> DataFrame:
    out = calls.join(broadcast_if_small(denied_tools), "tool", "left_anti")
    return out.join(broadcast_if_small(denied_clients), "harness", "left_anti")


def grouped_counts(df: DataFrame, dimensions: list[str], *extra: Column) -> DataFrame:
    """Counts by each dimension alone and in total, in one pass over the data."""
    df = df.select(*[F.col(d).cast("string").alias(d) for d in dimensions], *[c for c in df.columns if c not in dimensions])
    sets = df.groupingSets([[], *[[F.col(d)] for d in dimensions]], *[F.col(d) for d in dimensions]).agg(
        F.grouping_id(*[F.col(d) for d in dimensions]).alias("gid"), F.count(F.lit(1)).alias("n"), *extra)
    n = len(dimensions)
    full = 2**n - 1
    dim, value = F.lit("total"), F.lit("all")
    for i, d in enumerate(dimensions):
        mine = F.col("gid") == full - 2 ** (n - 1 - i)
        dim = F.when(mine, d).otherwise(dim)
        value = F.when(mine, F.coalesce(F.col(d), F.lit("none"))).otherwise(value)
    return sets.select(dim.alias("dimension"), value.alias("value"), *[c for c in sets.columns if c not in (*dimensions, "gid")])


def journal_stats(events: DataFrame) -> DataFrame:
    slim = events.select("harness", "event_type", "retention_class", "observed_at")
    return grouped_counts(slim, ["harness", "event_type", "retention_class"],
                          F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"))


def provenance_split(events: DataFrame) -> DataFrame:
    flag = F.coalesce(F.get_json_object("metadata", "$.provenance_reconstructed") == "true", F.lit(False))
    return events.groupBy("harness").agg(F.count_if(flag).alias("reconstructed"), F.count_if(~flag).alias("captured"))


def clients_seen(events: DataFrame, as_of: Column, call_type: str, hours: int = 24) -> DataFrame:
    """Per harness: newest call, calls and the version it announced last; connector calls left out."""
    since = as_of - F.make_dt_interval(hours=F.lit(hours))
    via = F.coalesce(F.get_json_object("metadata", "$.via"), F.lit(""))
    return events.where((F.col("event_type") == call_type) & (F.col("observed_at") >= since) & (F.col("observed_at") <= as_of) & (via != "connector")).groupBy(
        "harness").agg(F.max("observed_at").alias("last_seen"), F.count(F.lit(1)).alias("calls"),
                       F.max_by(F.get_json_object("metadata", "$.client_version"), F.struct("observed_at", "event_id")).alias("client_version"))


def connector_summary(events: DataFrame, as_of: Column, call_type: str, capture_type: str) -> DataFrame:
    """One row: calls, newest call and client names of the last day, captures of the last week."""
    day, week = as_of - F.make_dt_interval(days=F.lit(1)), as_of - F.make_dt_interval(days=F.lit(7))
    call = (F.col("event_type") == call_type) & (F.col("observed_at") >= day)
    cap = F.col("event_type") == capture_type
    via = F.get_json_object("metadata", "$.via") == "connector"
    return events.where((F.col("observed_at") >= week) & (F.col("observed_at") <= as_of) & via).agg(
        F.count_if(call).alias("calls"), F.max(F.when(call, F.col("observed_at"))).alias("last_seen"),
        F.sort_array(F.collect_set(F.when(call, F.col("harness")))).alias("names"),
        F.count_if(cap).alias("captures"), F.max(F.when(cap, F.col("observed_at"))).alias("last_capture"))


def live_captures(memories: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Captures per harness, which the id names in its second part."""
    since = as_of - F.make_dt_interval(days=F.lit(days))
    parts = F.split("memory_id", ":", 3)
    return memories.where((F.col("created_at") >= since) & (F.col("created_at") <= as_of) & (F.size(parts) == 3) & (parts[0] == "cowork_live")).groupBy(
        parts[1].alias("harness")).agg(F.count(F.lit(1)).alias("captures"), F.max("created_at").alias("last_at"))


def conversation_features(events: DataFrame) -> DataFrame:
    """Size and density per conversation: what decides whether extraction is worth it."""
    body = tx.strip(F.coalesce(F.col("text"), F.lit("")))
    typed = (F.col("actor_type") == "user") & (body != "")
    reply = (F.col("actor_type") == "assistant") & (body != "")
    return events.groupBy("conversation_id").agg(
        F.min("observed_at").alias("first_at"), F.count(F.lit(1)).alias("events"), F.count_if(typed).alias("typed_turns"),
        F.count_if(reply).alias("real_replies"),
        F.coalesce(F.sum(F.when(reply, F.length("text"))), F.lit(0)).alias("assistant_chars")).withColumns({
            "typed_per_event": F.col("typed_turns") / F.col("events"), "prose_per_event": F.col("assistant_chars") / F.col("events")})


def extraction_order(features: DataFrame, order: str = "yield", floor: int = 3, thin: int = 400) -> list[Column]:
    """Sort keys of pending conversations; the id breaks ties."""
    small = F.col("events") < floor
    few = (F.col("typed_turns") < 2) | (F.col("real_replies") < 2)
    tie = F.col("conversation_id")
    if order == "yield":
        return [small, (F.col("assistant_chars") < thin) | few, F.desc("prose_per_event"), F.desc("typed_per_event"), F.col("events"), tie]
    if order == "density":
        return [small, few, F.desc("typed_per_event"), F.col("events"), F.col("first_at"), tie]
    if order == "oldest":
        return [F.col("first_at"), tie]
    raise ValueError(order)


def availability(probes: DataFrame) -> DataFrame:
    """Probes, failures and availability per target and day."""
    failed = F.count_if(~F.col("ok"))
    return probes.groupBy("target", F.to_date("at").alias("day")).agg(
        F.count(F.lit(1)).alias("probes"), failed.alias("failures"),
        F.round(1 - failed / F.count(F.lit(1)), 4).alias("availability"))


def refused_clients(requests: DataFrame, as_of: Column) -> DataFrame:
    """Clients refused in the last day, with their newest accepted request."""
    day = as_of - F.make_dt_interval(days=F.lit(1))
    no, by = F.col("refused"), F.struct("at", "request_id")
    return requests.where(F.col("at") <= as_of).groupBy("client").agg(
        F.count_if(no).alias("refusals"), F.min(F.when(no, F.col("at"))).alias("first_at"), F.max(F.when(no, F.col("at"))).alias("last_at"),
        F.max_by("status", F.when(no, by)).alias("last_status"), F.max(F.when(~no, F.col("at"))).alias("last_ok_at")).where(F.col("last_at") >= day)


def retryable_writes(writes: DataFrame, started: Column) -> DataFrame:
    """Kept payloads whose write failed, or was still queued before the process start (lost)."""
    lost = (F.col("status") == "queued") & (F.col("queued_at") < started)
    state = F.when(lost, "lost").otherwise(F.col("status"))
    return writes.where(F.col("payload").isNotNull()).withColumn("status", state).where(F.col("status").isin("failed", "lost"))


def relabel(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Old source slugs replaced by new ones; ``relabelled`` marks changed rows."""
    out = df.join(broadcast_if_small(mapping.select(F.col("old").alias("harness"), "new")), "harness", "left")
    return out.withColumns({"relabelled": F.col("new").isNotNull(), "harness": F.coalesce("new", "harness")}).drop("new")


def relabel_provenance(events: DataFrame, mirrors: dict[str, DataFrame], old: str, entry_points: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Move the slug ``old`` to what each event's entry point says, across the journal and its
    mirrors (derivations, reviews, ...), and report it.

    ``events``: event_id, conversation_id, harness, entry_point; ``entry_points``: entry_point,
    new. An event without a known entry point keeps its slug. Mirrors carry a conversation_id:
    their rows of the old slug follow only where the conversation moves as a whole to one slug.
    The report has (source, harness, before, after) counts.
    """
    tables = {"events": events, **mirrors}
    known = broadcast_if_small(entry_points.select("entry_point", "new"))
    moved = events.join(known, "entry_point", "left").withColumn("label", F.when(F.col("harness") == old, F.coalesce("new", F.lit(old))).otherwise(F.col("harness")))
    whole = moved.where(F.col("harness") == old).groupBy(F.col("conversation_id").alias("__c")).agg(F.min("label").alias("__lo"), F.max("label").alias("__hi"))
    whole = whole.where((F.col("__lo") == F.col("__hi")) & (F.col("__lo") != old)).select("__c", F.col("__lo").alias("__new"))
    out = {"events": moved.withColumn("harness", F.col("label")).select(events.columns)}
    for name, df in mirrors.items():
        j = df.join(whole, (F.col("conversation_id") == F.col("__c")) & (F.col("harness") == old), "left")
        out[name] = j.withColumn("harness", F.coalesce("__new", "harness")).select(df.columns)
    count = lambda name, df, when: df.groupBy("harness").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), "harness", F.lit(when).alias("when"), "n")
    rows = reduce(DataFrame.union, [count(name, df, when) for which, when in ((tables, "before"), (out, "after")) for name, df in which.items()])
    n = lambda when: F.coalesce(F.sum(F.when(F.col("when") == when, F.col("n"))), F.lit(0)).alias(when)
    return out, rows.groupBy("source", "harness").agg(n("before"), n("after"))


def pending_conversations(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Conversations none of whose events has a job."""
    done = jobs.select("event_id").join(events.select("event_id", "conversation_id"), "event_id").select("conversation_id").distinct()
    return events.select("conversation_id").distinct().join(done, "conversation_id", "left_anti")


def private_mentions(lines: DataFrame, patterns: list[tuple[int, str]]) -> DataFrame:
    """Where each denied pattern occurs: place and rule number only, never the text.

    The deny list is part of the plan (one expression per rule), so there is no join.
    """
    hits = F.array_compact(F.array(*[F.when(tx.matches(F.col("line"), p), F.lit(n)) for n, p in patterns]))
    return lines.select("doc_id", "line_no", F.explode(hits).alias("rule_no"))


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line); line numbers count from 1."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_no"), "line")
