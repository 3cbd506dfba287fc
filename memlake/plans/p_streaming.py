"""Streaming queries: a stream over the events table run to its end, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from memlake.plans.p_ledger import _A24
from memlake.plans.p_windows import _W2
from memlake.plans.registry import Tables, query
from memlake.session import checkpoint_dir
from memlake.sources import exports
from memlake.streaming import ingest, sessions, state
from memlake.streaming.growing import tail_growing


def scratch(t: Tables, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(t.spark)}/stream-{name}-{uuid.uuid4().hex}"


def stream(t: Tables, table: str) -> DataFrame:
    """The given table's file as a stream."""
    return t.spark.readStream.schema(getattr(t, table).schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.sf_dir)


def finish(writer, checkpoint: str) -> None:
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def events(t: Tables) -> DataFrame:
    return stream(t, "events").select(
        "event_id", F.col("user_id").alias("conversation_id"), F.col("ts").alias("observed_at"), "event_type",
        F.expr("'src' || event_id % 4").alias("harness"), "props")


def repeated(df: DataFrame) -> DataFrame:
    """Every third event offered twice."""
    return df.withColumn("copy", F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy")


def tailed(t: Tables) -> DataFrame:
    """The journal after two runs over every turn of f_conv, the second with files that are new. The
    session reader trims texts and skips lines of type system."""
    out = scratch(t, "tail")
    said = F.to_json(F.array(F.struct(F.lit("text").alias("type"), "text")))
    msg = F.struct(F.when(F.col("actor_type") == "assistant", said).otherwise(F.col("text")).alias("content"))
    line = F.to_json(F.struct(F.col("actor_type").alias("type"), F.concat_ws("-", F.concat(F.lit("u"), "conversation_id"), "turn").alias("uuid"), F.col("observed_at").cast("string").alias("timestamp"), msg.alias("message")))
    for run in (0, 1):  # the second run finds new files, and reads nothing again
        t.f_conv.where(F.col("turn") % 2 == run).select(line.alias("value")).write.text(f"{out}/in/part{run}")
        ev = exports.parse_agent_lines(tail_growing(t.spark, f"{out}/in", "part-*.txt"), "session")
        ingest.run_append(ev, f"{out}/journal", f"{out}/ckpt").awaitTermination()
    return t.spark.read.parquet(f"{out}/journal")


@query("ST1_incremental_tail", """SELECT 'u' || conversation_id || '-' || turn AS turn_id, actor_type, md5(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS text_md5
    FROM f_conv WHERE actor_type <> 'system'""")
def _st1(t: Tables):
    return tailed(t).select("turn_id", "actor_type", F.md5("text").alias("text_md5"))


@query("ST2_idempotent_append", "SELECT event_id, observed_at FROM f_events")
def _st2(t: Tables):
    out = scratch(t, "append")
    ingest.run_append(repeated(events(t)), f"{out}/journal", f"{out}/ckpt1").awaitTermination()
    # A second stream offers everything again under later batch numbers and adds nothing.
    again = ingest.append_new(f"{out}/journal")
    finish(repeated(events(t)).writeStream.foreachBatch(lambda b, i: again(b, i + 1000)), f"{out}/ckpt2")
    return t.spark.read.parquet(f"{out}/journal").select("event_id", "observed_at")


_SESS = """WITH a AS (SELECT conversation_id, observed_at, coalesce(observed_at - lag(observed_at) OVER k >= INTERVAL 12 HOUR, true) AS b FROM f_events WINDOW k AS (PARTITION BY conversation_id ORDER BY observed_at, event_id)),
    c AS (SELECT *, sum(b::INT) OVER (PARTITION BY conversation_id ORDER BY observed_at) AS s FROM a)
    SELECT conversation_id, count(*) AS n_events, min(observed_at) AS start_at, max(observed_at) AS end_at FROM c GROUP BY conversation_id, s"""


@query("ST3_gap_sessions", _SESS)
def _st3(t: Tables):
    out = scratch(t, "sessions")
    s = sessions.gap_sessions(events(t), 12 * 3600)
    finish(s.writeStream.outputMode("complete").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/sessions")), f"{out}/ckpt")
    r = t.spark.read.parquet(f"{out}/sessions")
    return r.select("conversation_id", "n_events", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_at", "end_at")])


@query("ST3_capped_sessions", _W2 + " SELECT conversation_id, n_events, epoch_us(start_at) AS start_us, epoch_us(end_at) AS end_us FROM w")
def _st3b(t: Tables):
    out = scratch(t, "capped")
    s = sessions.capped_sessions(events(t), 12 * 3600, 6, 3)
    finish(s.writeStream.outputMode("append").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/w/batch={i}")), f"{out}/ckpt")
    return sessions.current_windows(t.spark.read.parquet(f"{out}/w"))


@query("ST4_thread_state", _A24)
def _st4(t: Tables):
    """Every memory in five files of mixed times, a file a batch."""
    out = scratch(t, "threads")
    t.f_memory.select("thread_key", "conversation_id", "memory_id", "event_id", "observed_at", "status", "harness", "reasoning_kind", "project").repartition(5, F.xxhash64("memory_id")).write.parquet(f"{out}/in")
    rows = t.spark.readStream.schema(t.spark.read.parquet(f"{out}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    finish(state.thread_states(rows).writeStream.outputMode("update").foreachBatch(state.write_states(f"{out}/states")), f"{out}/ckpt")
    r = state.newest_states(t.spark.read.parquet(f"{out}/states"))
    return r.withColumns({c: F.coalesce(F.array_join(c, ","), F.lit("")) for c in ("harnesses", "kinds", "projects")})


@query("ST5_health_counters", f"""SELECT CASE WHEN event_id % 50 = 0 THEN 'error' WHEN event_type = 'click' THEN 'dropped_tool' ELSE 'captured' END AS outcome, count(*) AS calls, count(*) FILTER (WHERE event_id % 50 <> 0 AND event_id % 11 = 0) AS redacted FROM f_events GROUP BY 1""")
def _st5(t: Tables):
    """The counters come from the metrics that each batch of the stream reports."""
    out = scratch(t, "health")
    calls = events(t).withColumn("tool", F.col("event_type")).withColumn(
        "content", F.expr("CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'x sk-ABCDEFGHIJKLMNOPQRSTUVWX' ELSE props END"))
    kept = ingest.observed(ingest.with_outcome(calls, ["click"])).where("outcome = 'captured'").select("event_id", "observed_at")
    metrics = ingest.CaptureMetrics()
    t.spark.streams.addListener(metrics)
    try:
        q = kept.writeStream.format("parquet").option("path", f"{out}/captured").option("checkpointLocation", f"{out}/ckpt").trigger(availableNow=True).start()
        q.awaitTermination()
        metrics.wait(q)
    finally:
        t.spark.streams.removeListener(metrics)
    return t.spark.createDataFrame(metrics.counters(), "outcome string, calls long, redacted long")


@query("ST6_isolated_sources", "SELECT 'src' || event_id % 4 AS source, count(*) AS events FROM events WHERE event_id % 4 <> 3 GROUP BY 1")
def _st6(t: Tables):
    out = scratch(t, "isolated")
    e = events(t)
    sources = {f"src{i}": e.where(F.col("harness") == f"src{i}") for i in range(3)}
    broken = e.where(F.col("harness") == "src3")
    sources["src3"] = broken.withColumn("event_id", F.when(F.col("event_id") >= 0, F.raise_error(F.lit("source down")).cast("bigint")).otherwise(F.col("event_id")))
    running = ingest.start_isolated(sources, f"{out}/journal", f"{out}/ckpt")
    for q in running.values():
        try:
            q.awaitTermination()
        except Exception:  # the failing source ends alone
            pass
    parts = [t.spark.read.parquet(f"{out}/journal/src{i}").select(F.lit(f"src{i}").alias("source")) for i in range(3)]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("source").agg(F.count(F.lit(1)).alias("events"))


@query("ST7_freshness", """WITH w AS (SELECT harness, observed_at, unnest(range(0, 24)) AS k FROM f_events) SELECT harness, date_trunc('hour', observed_at) - k * INTERVAL 1 HOUR AS window_start, count(*) AS calls, max(observed_at) AS last_at FROM w GROUP BY ALL""")
def _st7(t: Tables):
    out = scratch(t, "fresh")
    # Windows that a batch changes are written; one past the watermark leaves the state.
    finish(sessions.freshness(events(t)).writeStream.outputMode("update").foreachBatch(state.write_states(f"{out}/f")), f"{out}/ckpt")
    r = t.spark.read.parquet(f"{out}/f").groupBy("harness", "window_start").agg(F.max_by("calls", "batch").alias("calls"), F.max_by("last_at", "batch").alias("last_at"))
    return r.select("harness", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "calls", F.col("last_at").cast("timestamp_ntz").alias("last_at"))


@query("ST8_incremental_derive", """SELECT event_id || '::heuristic@' || v AS memory_id, CASE WHEN event_id % 40 = 0 AND (v = '1.2' OR event_id % 80 = 0) THEN 'rejected' ELSE 'derived' END AS outcome,
    CASE WHEN event_id % 40 = 0 AND (v = '1.2' OR event_id % 80 = 0) THEN '' ELSE 'episodic' END AS category, CASE WHEN event_id % 40 = 0 AND (v = '1.2' OR event_id % 80 = 0) THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence
    FROM events, (VALUES ('1.2'), ('1.3')) x(v)""")
def _st8(t: Tables):
    """A run, the same run again (nothing new), a new version (all again), and a retry after
    half of the rejected events have got their text."""
    out = scratch(t, "derive")
    text = "CASE WHEN event_id % 40 <> 0 THEN 'We decided on ' || event_type || ' on 2024-03-05' END"
    e = events(t).select("event_id", "observed_at", F.lit("user").alias("actor_type"), F.lit(False).alias("reconstructed"), F.expr(text).alias("text"))
    for run, version in enumerate(("1.2", "1.2", "1.3")):
        write = state.derive_batch(f"{out}/{version}", "heuristic", version, 0.85)
        finish(e.writeStream.foreachBatch(lambda b, i, w=write, r=run: w(b, i + 1000 * r)), f"{out}/ckpt{run}")
    mended = t.events.selectExpr("event_id", "ts AS observed_at", "'user' AS actor_type", "false AS reconstructed", "CASE WHEN event_id % 80 <> 0 THEN 'We decided on ' || event_type || ' on 2024-03-05' END AS text")
    state.retry(f"{out}/1.3", mended, 9000, "heuristic", "1.3", 0.85)
    parts = []
    for version in ("1.2", "1.3"):
        d = t.spark.read.parquet(f"{out}/{version}/derived").select("memory_id", "event_id", F.lit("derived").alias("outcome"), "category", F.round("confidence", 6).alias("confidence"))
        r = state.pending_rejects(t.spark.read.parquet(f"{out}/{version}/rejected"), d)
        name = F.concat(F.col("event_id").cast("string"), F.lit(f"::heuristic@{version}"))
        parts.append(d.drop("event_id").union(r.select(name, F.lit("rejected"), F.lit(""), F.lit(0.0))))
    return parts[0].union(parts[1])
