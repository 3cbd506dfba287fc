"""Streaming thread state and incremental derivation."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memlake.operators import derive
from memlake.streaming.ingest import _read
from memlake.streaming.sessions import use_rocksdb


SETS = {"harness": "harnesses", "reasoning_kind": "kinds", "project": "projects"}
#: Lists that a thread's conversations are held in.
BUCKETS = 256
MARK = "at_us BIGINT, memory_id STRING"
THREAD = "thread_key STRING, first_seen_us BIGINT, first_event_id BIGINT, last_seen_us BIGINT, last_event_id BIGINT, status STRING, episode_count BIGINT, n_conversations BIGINT, harnesses ARRAY<STRING>, kinds ARRAY<STRING>, projects ARRAY<STRING>"


def outermost(pdf: pd.DataFrame, columns: list[str], which: Callable) -> tuple:
    """``which`` (min or max) row by time, then by the other columns."""
    at = pdf["at_us"]
    rows = pdf[at == which(at)]
    return which(zip(*(rows[c].tolist() for c in columns)))


class ThreadState(StatefulProcessor):
    """What is known of one thread: first and last sight, newest known status, counts, the
    conversations seen, and each set's values with their first sight. Nothing depends on the
    order of rows, so late rows never move last sight backwards. State of a thread without new
    rows for ``ttl_ms`` expires, where that is given.

    A call of the state goes to the JVM and back, so rows are gathered over the batch first, and
    conversations are held in BUCKETS lists by their hash: a batch makes no more calls than that
    for a thread, however many its rows and conversations."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.main = handle.getValueState("main", "first STRUCT<at_us: BIGINT, memory_id: STRING, event_id: BIGINT>, last STRUCT<at_us: BIGINT, memory_id: STRING, event_id: BIGINT>, "
                                         "state STRUCT<at_us: BIGINT, memory_id: STRING, status: STRING>, episodes BIGINT, conversations BIGINT", self.ttl_ms)
        self.conversations = handle.getMapState("seen", "bucket INT", "ids ARRAY<STRING>", self.ttl_ms)
        self.values = handle.getMapState("values", "kind STRING, value STRING", MARK, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.main.get() if self.main.exists() else None
        first, last, state, episodes, n = (*(None if x is None else tuple(x) for x in held[:3]), *held[3:]) if held is not None else (None, None, None, 0, 0)
        seen: set[str] = set()
        marks: dict[tuple[str, str], tuple[int, str]] = {}
        for pdf in rows:
            sight = ["at_us", "memory_id", "event_id"]
            first, last = min(x for x in (first, outermost(pdf, sight, min)) if x), max(x for x in (last, outermost(pdf, sight, max)) if x)
            known = pdf[pdf["status"].notna()]
            if len(known):
                state = max(x for x in (state, outermost(known, ["at_us", "memory_id", "status"], max)) if x)
            episodes += len(pdf)
            seen.update(pdf["conversation_id"].dropna().unique())
            for column, name in SETS.items():
                some = pdf.loc[pdf[column].notna(), [column, "at_us", "memory_id"]]
                some = some[some["at_us"] == some.groupby(column)["at_us"].transform("min")]
                for value, at, memory in some.itertuples(index=False):
                    mark = (int(at), memory)
                    marks[name, value] = min(mark, marks.get((name, value), mark))
        buckets: dict[int, set[str]] = {}
        for conversation in seen:
            buckets.setdefault(zlib.crc32(conversation.encode("utf-8", "replace")) % BUCKETS, set()).add(conversation)
        for bucket, found in buckets.items():
            had = set(self.conversations.getValue((bucket,))[0]) if self.conversations.containsKey((bucket,)) else set()
            n += len(found - had)
            if self.ttl_ms is not None or not found <= had:
                self.conversations.updateValue((bucket,), (sorted(had | found),))
        for at, mark in marks.items():
            had = tuple(self.values.getValue(at)) if self.values.containsKey(at) else None
            if had is None or mark < had:
                self.values.updateValue(at, mark)
        self.main.update((first, last, state, episodes, n))
        sets: dict[str, list] = {name: [] for name in SETS.values()}
        for (name, value), mark in self.values.iterator():
            sets[name].append((*mark, value))
        row = {"thread_key": key[0], "first_seen_us": first[0], "first_event_id": first[2], "last_seen_us": last[0], "last_event_id": last[2], "status": state and state[2], "episode_count": episodes, "n_conversations": n}
        yield pd.DataFrame([row | {name: [x[2] for x in sorted(found)] for name, found in sets.items()}])

    def close(self) -> None:
        pass


def thread_states(episodes: DataFrame, ttl: str | None = None) -> DataFrame:
    """Streaming upserts: the whole row of each thread that a batch touches, to be taken over
    the one before (``newest_states``). ``episodes``: thread_key, conversation_id, memory_id,
    event_id, observed_at, status, harness, reasoning_kind, project."""
    use_rocksdb(episodes.sparkSession)
    ms = None if ttl is None else int(pd.Timedelta(ttl).total_seconds() * 1000)
    rows = episodes.select("thread_key", F.col("conversation_id").cast("string").alias("conversation_id"), "memory_id", "event_id", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("at_us"), "status", *SETS)
    return rows.groupBy("thread_key").transformWithStateInPandas(ThreadState(ms), THREAD, "Update", "None" if ms is None else "ProcessingTime")


def write_states(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of upserts; a replayed batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def newest_states(written: DataFrame) -> DataFrame:
    """The newest row of each thread, with times."""
    rest = F.struct(*[c for c in written.columns if c not in ("thread_key", "batch")])
    r = written.groupBy("thread_key").agg(F.max_by(rest, "batch").alias("r")).select("thread_key", "r.*")
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return r.withColumns({"first_seen_at": at("first_seen_us"), "last_seen_at": at("last_seen_us")}).drop("first_seen_us", "last_seen_us")


def derive_batch(path: str, policy: str, version: str, threshold: float) -> Callable[[DataFrame, int], None]:
    """Derive each batch's events that this policy and version has not done yet; a new version
    derives all of them again. What is derived grows with the journal and its files are small for
    their rows, so joins with it are merged, not broadcast from the driver. Rows that cannot be derived go to a reject table with the
    reason; ``pending_rejects`` lists those still open and ``retry`` offers them again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        why = F.when(F.col("text").isNull(), "no text").when(F.col("observed_at").isNull(), "no time")
        marked = batch.withColumn("error", why)
        bad = marked.where(F.col("error").isNotNull()).select("event_id", "error")
        name = F.concat(F.col("event_id").cast("string"), F.lit(f"::{policy}@{version}"))
        good = marked.where(F.col("error").isNull()).drop("error").dropDuplicates(["event_id"]).withColumn("memory_id", name)
        held = _read(spark, f"{path}/derived")
        if held is not None:
            good = good.join(held.where(F.col("batch") != batch_id).select("memory_id").hint("merge"), "memory_id", "left_anti")
        d = derive.heuristic_policy(good)
        d = d.withColumn("memory_id", name).withColumn(
            "approval_state", derive.approval_state(F.col("category"), F.col("confidence"), threshold))
        d.select("memory_id", "event_id", "category", "confidence", "approval_state").write.mode("overwrite").parquet(f"{path}/derived/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{path}/rejected/batch={batch_id}")

    return write


def retry(path: str, events: DataFrame, batch_id: int, policy: str, version: str, threshold: float) -> None:
    """Offer the open rejects again as their events now stand."""
    spark = events.sparkSession
    open_ids = pending_rejects(spark.read.parquet(f"{path}/rejected"), spark.read.parquet(f"{path}/derived")).select("event_id")
    derive_batch(path, policy, version, threshold)(events.join(open_ids.hint("merge"), "event_id", "left_semi"), batch_id)


def pending_rejects(rejected: DataFrame, derived: DataFrame) -> DataFrame:
    """Rejected events that no later run derived."""
    return rejected.select("event_id", "error").distinct().join(derived.select("event_id").hint("merge"), "event_id", "left_anti")
