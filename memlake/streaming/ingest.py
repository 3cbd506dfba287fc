"""Streaming capture: incremental tail, idempotent append, health counters, isolation."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from memlake.functions import rules
from memlake.operators.journal import new_events
from memlake.session import path_exists


#: Parts of the journal by the hash of an event's id.
BUCKETS = 64


def tail_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """Lines of files that appear under a folder. The checkpoint remembers files, so a file
    is read once, whole; lines added to a file already read are not seen."""
    lines = spark.readStream.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    return lines.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^.]+$", 1).alias("conversation_id"), F.col("value").alias("line"))


def dedup_in_watermark(events: DataFrame, delay: str) -> DataFrame:
    """Repeats of an event id dropped while both copies lie within the delay."""
    return events.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A written folder, or None before the first write. Any other failure is raised: a journal
    that cannot be read is not an empty one."""
    return spark.read.parquet(path) if path_exists(spark, path) else None


def bucket_of(event_id: str = "event_id") -> Column:
    return F.pmod(F.xxhash64(event_id), F.lit(BUCKETS)).cast("int").alias("bucket")


def held_ids(journal: DataFrame, batch: DataFrame) -> DataFrame:
    """Ids of the journal that the batch could repeat: from the buckets it touches, and there
    between its least and greatest id, which each file's statistics tell without reading it."""
    seen = batch.select("event_id", bucket_of()).agg(F.collect_set("bucket").alias("b"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).first()
    if not seen.b:
        return journal.select("event_id").where(F.lit(False))
    return journal.where(F.col("bucket").isin(sorted(seen.b)) & F.col("event_id").between(seen.lo, seen.hi)).select("event_id")


def append_new(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: only ids the journal lacks. The journal lies in buckets of the
    id's hash, sorted by id, and a batch reads only what could hold its ids. Each batch owns
    its folder and overwrites it, so a replayed batch leaves the same files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        held = _read(batch.sparkSession, path)
        fresh = batch.dropDuplicates(["event_id"]) if held is None else new_events(held_ids(held.where(F.col("batch") != batch_id), batch), batch)
        fresh = fresh.withColumn("bucket", bucket_of()).repartition("bucket").sortWithinPartitions("bucket", "event_id")
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    return write


def run_append(events: DataFrame, path: str, checkpoint: str, delay: str | None = None):
    """Append everything available now; late and repeated events change nothing. With a
    ``delay`` repeats within it are dropped before they reach the journal."""
    events = events if delay is None else dedup_in_watermark(events.withColumn("observed_at", F.col("observed_at").cast("timestamp")), delay)
    return events.writeStream.foreachBatch(append_new(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_outcome(calls: DataFrame, denied_tools: list[str] | None = None) -> DataFrame:
    """Why each captured call is kept or dropped, and whether its content is scrubbed."""
    from memlake.functions import text as tx

    denied = F.col("tool").isin(*(denied_tools or rules.DENIED_TOOLS))
    outcome = F.when(F.col("content").isNull(), "error").when(denied, "dropped_tool").otherwise("captured")
    return calls.withColumns({"outcome": outcome, "redacted": F.coalesce(tx.redact(F.col("content")) != F.col("content"), F.lit(False))})


OUTCOMES = ("captured", "dropped_tool", "error")


def health_counters(calls: DataFrame) -> DataFrame:
    """Captured, dropped by reason, redacted and failed calls."""
    return calls.groupBy("outcome").agg(F.count(F.lit(1)).alias("calls"), F.count_if("redacted").alias("redacted"))


def observed(calls: DataFrame, name: str = "capture") -> DataFrame:
    """The same rows with the counters of each outcome attached as observed metrics of each
    batch; nothing else is computed for them."""
    return calls.observe(name, *[F.count_if((F.col("outcome") == o) & c).alias(f"{o}_{k}") for o in OUTCOMES for k, c in (("calls", F.lit(True)), ("redacted", F.col("redacted")))])


class CaptureMetrics(StreamingQueryListener):
    """Collects the observed metrics of every batch of every query, a few numbers each."""

    def __init__(self, name: str = "capture"):
        self.name, self.batches, self.ended = name, {}, set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.batches[str(event.progress.runId), event.progress.batchId] = row.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def wait(self, query, seconds: float = 60) -> None:
        """Until the listener has been told that an ended query ended: its progress came before."""
        until = time.time() + seconds
        while str(query.runId) not in self.ended and time.time() < until:
            time.sleep(0.05)

    def counters(self) -> list[tuple[str, int, int]]:
        """(outcome, calls, redacted) over all batches; outcomes without calls are left out."""
        total = lambda k: sum(b[k] for b in self.batches.values())
        return [(o, total(f"{o}_calls"), total(f"{o}_redacted")) for o in OUTCOMES if total(f"{o}_calls")]


def start_isolated(sources: dict[str, DataFrame], out: str, checkpoints: str) -> dict[str, object]:
    """One query per source, each with its own checkpoint and folder: a source that fails
    ends its own query and no other. Returns queries, or the exception a start raised."""
    running: dict[str, object] = {}
    for name, df in sources.items():
        try:
            running[name] = run_append(df, f"{out}/{name}", f"{checkpoints}/{name}")
        except Exception as e:  # a source that cannot start must not stop the rest
            running[name] = e
    return running
