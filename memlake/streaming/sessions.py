"""Streaming sessions and freshness windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memlake.operators.scan import join_null_safe


def gap_sessions(events: DataFrame, gap_seconds: int, delay: str = "1 day") -> DataFrame:
    """Sessions per conversation by pause. The batch rule splits at a pause of exactly the
    gap, where a session window would still merge, so the window is a microsecond shorter."""
    at = F.col("observed_at").cast("timestamp")
    keyed = events.select("conversation_id", at.alias("at"))
    if events.isStreaming:
        keyed = keyed.withWatermark("at", delay)
    gap = f"{gap_seconds - 1} seconds 999999 microseconds"
    return keyed.groupBy("conversation_id", F.session_window("at", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n_events"), F.min("at").alias("start_at"), F.max("at").alias("end_at")).drop("w")


OUTPUT = "conversation_id BIGINT, n_events BIGINT, start_us BIGINT, end_us BIGINT, final BOOLEAN"
#: Lists that conversations are held in, by hash; those without an id have one more.
BUCKETS = 1024
#: Rows of a piece of waiting rows: a megabyte.
PIECE = 65_536
#: Conversation, its open block (size, start, last time), the closed window before it, which is
#: held because a short block still joins it, and whether an earlier window was given out.
ID, OPEN_N, START, LAST, HELD_N, HELD_START, HELD_END, EMITTED = range(8)


def matrix(data: bytes | None, width: int) -> np.ndarray:
    return np.frombuffer(data or b"", np.int64).reshape(-1, width)


def _firsts(ids: np.ndarray) -> np.ndarray:
    """Where a run of equal ids begins."""
    return np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.empty(0, bool)


def fold(held: np.ndarray, rows: np.ndarray, gap_us: int, cap: int, minimum: int, close: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Windows (conversation, size, start, end) under the gap, cap and runt rules, and what is held
    then, of many conversations side by side.

    ``held`` has a row of eight numbers a conversation, however long it runs; ``rows``
    (conversation, time) are sorted. With ``close`` the open blocks and held windows end, too.
    """
    # What is held goes first in its conversation: as an item of several rows, then as a block.
    place = np.searchsorted(rows[:, 0], held[:, ID])
    put = lambda column, kept: np.insert(rows[:, column], place, held[:, kept])
    ids, begin, end = put(0, ID), put(1, START), put(1, LAST)
    n = np.insert(np.ones(len(rows), np.int64), place, held[:, OPEN_N])
    session = _firsts(ids)
    session[1:] |= begin[1:] - end[:-1] >= gap_us
    before = np.cumsum(n) - n
    opens = np.flatnonzero((before - before[session][np.cumsum(session) - 1]) % max(cap, 1) == 0)
    ids, begin, end = ids[opens], begin[opens], end[np.append(opens[1:], len(end)) - 1] if len(opens) else end
    n = np.add.reduceat(n, opens) if len(opens) else n

    still = np.append(_firsts(ids)[1:], True)[:len(ids)] & (not close)  # the last block stays open
    left = np.zeros((int(still.sum()), 8), np.int64)
    left[:, ID], left[:, OPEN_N], left[:, START], left[:, LAST] = ids[still], n[still], begin[still], end[still]

    old = held[held[:, HELD_N] > 0]
    place = np.searchsorted(ids[~still], old[:, ID])
    put = lambda column, kept: np.insert(column[~still], place, old[:, kept])
    ids, n, begin, end = put(ids, ID), put(n, HELD_N), put(begin, HELD_START), put(end, HELD_END)
    first = _firsts(ids)
    before = np.cumsum(n) - n
    before -= before[first][np.cumsum(first) - 1]
    emitted = np.isin(ids, held[held[:, EMITTED] > 0, ID])
    # A short block joins the held window; so does the successor of a short leading one.
    opens = np.flatnonzero(first | ((n >= minimum) & (emitted | (before >= minimum))))
    if not len(opens):
        return np.empty((0, 4), np.int64), left
    windows = np.stack([ids[opens], np.add.reduceat(n, opens), begin[opens], end[np.append(opens[1:], len(end)) - 1]], axis=1)
    last = np.append(_firsts(windows[:, 0])[1:], True) & (not close)
    at = np.searchsorted(left[:, ID], windows[last, 0])
    left[at, HELD_N:EMITTED] = windows[last, 1:]
    left[:, EMITTED] = np.isin(left[:, ID], np.append(windows[~last, 0], held[held[:, EMITTED] > 0, ID]))
    return windows[~last], left


class TimedWindows(StatefulProcessor):
    """Windows of the conversations of one bucket, each with its rows in event-time order.

    Rows wait in pieces. A timer stands at the end of the first slot of event time that holds one;
    when it goes off, the rows of the slots that the watermark has passed are sorted and folded,
    so late rows within the delay find their place. After each call the windows of the
    conversations that it touched are given as they stand, with the waiting rows, as not final. A
    conversation that has been idle is closed and leaves the state. A call reads and writes what
    its bucket holds as a few values, whatever number of conversations and slots that is.
    """

    def __init__(self, gap_us: int, cap: int, minimum: int, idle_ms: int, slot_ms: int):
        self.rule, self.idle_ms, self.slot_ms = (gap_us, cap, minimum), idle_ms, slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", "held BINARY")
        self.waiting = handle.getListState("waiting", "rows BINARY")
        self.timer = handle.getValueState("timer", "ms BIGINT")

    def _held(self) -> np.ndarray:
        return matrix((self.folded.get() or (None,))[0], 8)

    def _rows(self) -> np.ndarray:
        return np.concatenate([matrix(None, 2), *(matrix(p[0], 2) for p in self.waiting.get())])

    def _wait(self, rows: np.ndarray) -> None:
        for k in range(0, len(rows), PIECE):
            self.waiting.appendValue((rows[k:k + PIECE].tobytes(),))

    def _slot_end(self, us):
        return (us // (self.slot_ms * 1000) + 1) * self.slot_ms

    def _ring(self, at: int | None) -> None:
        """The one timer of the bucket, moved."""
        before = (self.timer.get() or (None,))[0]
        if before != at:
            if before is not None:
                self.handle.deleteTimer(before)
            if at is None:
                self.timer.clear()
            else:
                self.handle.registerTimer(int(at))
                self.timer.update((int(at),))

    def _out(self, key, final: np.ndarray, touched: np.ndarray, held: np.ndarray, rows: np.ndarray) -> Iterator[pd.DataFrame]:
        """Final windows, and those of the touched conversations that stand open once the waiting
        rows are counted."""
        rows = rows[np.isin(rows[:, 0], touched)]
        shown, _ = fold(held[np.isin(held[:, ID], touched)], rows[np.lexsort((rows[:, 1], rows[:, 0]))], *self.rule, close=True)
        both = np.concatenate([final, shown])
        if len(both):
            out = pd.DataFrame(both, columns=["conversation_id", "n_events", "start_us", "end_us"])
            if key[0] == BUCKETS:
                out["conversation_id"] = pd.array([None] * len(out), "Int64")
            yield out.assign(final=np.arange(len(both)) < len(final))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = np.concatenate([matrix(None, 2), *(pdf[["conversation_id", "us"]].to_numpy(np.int64) for pdf in rows)])
        if not len(new):
            return
        due, before = int(self._slot_end(new[:, 1].min())), (self.timer.get() or (None,))[0]
        if before is None or due < before:
            self._ring(due)
        waiting = self._rows()
        self._wait(new)
        yield from self._out(key, np.empty((0, 4), np.int64), np.unique(new[:, 0]), self._held(), np.concatenate([waiting, new]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        held, rows = self._held(), self._rows()
        due = self._slot_end(rows[:, 1]) <= now
        late, rows = rows[due], rows[~due]
        late = late[np.lexsort((late[:, 1], late[:, 0]))]
        touched = np.unique(late[:, 0])
        moved = np.isin(held[:, ID], touched)
        final, then = fold(held[moved], late, *self.rule)
        held = np.concatenate([held[~moved], then])
        idle_at = held[:, LAST] // 1000 + self.idle_ms
        busy = np.isin(held[:, ID], rows[:, 0])
        idle = (idle_at <= now) & ~busy
        if idle.any():
            ended = held[idle]
            final = np.concatenate([final, fold(ended[np.argsort(ended[:, ID])], rows[:0], *self.rule, close=True)[0]])
        if due.any():
            self.waiting.clear()
            self._wait(rows)
        held, coming = held[~idle], idle_at[~idle & ~busy]
        held = held[np.argsort(held[:, ID])]
        if due.any() or idle.any():
            self.folded.update((held.tobytes(),)) if len(held) else self.folded.clear()
        self.timer.clear()  # the one that went off
        times = [*([self._slot_end(rows[:, 1].min())] if len(rows) else []), *([coming.min()] if len(coming) else [])]
        self._ring(int(min(times)) if times else None)
        yield from self._out(key, final, touched, held, rows)

    def close(self) -> None:
        pass


def capped_sessions(events: DataFrame, gap_seconds: int = 7200, cap: int = 20, minimum: int = 3, delay: str = "1 day", idle: str = "1 day", slot: str = "1 hour") -> DataFrame:
    """Windows with cap and runt folding. A window is final when the one after it is settled or
    the conversation has been idle past the watermark; until then each batch also gives the
    windows as they stand, not final, which the conversation's next rows replace
    (``current_windows``). They equal the batch operator's whatever batches the rows came in,
    if none came later than the delay."""
    use_rocksdb(events.sparkSession)
    ms = lambda d: int(pd.Timedelta(d).total_seconds() * 1000)
    bucket = F.when(F.col("conversation_id").isNull(), BUCKETS).otherwise(F.pmod(F.xxhash64("conversation_id"), F.lit(BUCKETS))).cast("int")
    keyed = events.select(bucket.alias("bucket"), F.coalesce("conversation_id", F.lit(0)).alias("conversation_id"), F.col("observed_at").cast("timestamp").alias("at"))
    keyed = keyed.where("at IS NOT NULL").withWatermark("at", delay).withColumn("us", F.unix_micros("at"))
    return keyed.groupBy("bucket").transformWithStateInPandas(TimedWindows(gap_seconds * 1_000_000, cap, minimum, ms(idle), ms(slot)), OUTPUT, "Append", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """Typed state with timers needs the state store on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def current_windows(written: DataFrame) -> DataFrame:
    """Windows as of the last ``batch``: final ones, and those that stood open in each
    conversation's newest batch. A batch may show a window before it makes it final."""
    newest = written.groupBy("conversation_id").agg(F.max("batch").alias("__newest"))
    j = join_null_safe(written, newest, ["conversation_id"])
    return j.where(F.col("final") | (F.col("batch") == F.col("__newest"))).drop("batch", "final", "__newest").distinct()


def freshness(events: DataFrame, key: str = "harness", width: str = "24 hours", slide: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Calls and newest time per source over a sliding window."""
    at = events.select(key, F.col("observed_at").cast("timestamp").alias("at"))
    if events.isStreaming:
        at = at.withWatermark("at", delay)
    g = at.groupBy(key, F.window("at", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("calls"), F.max("at").alias("last_at"))
    return g.select(key, F.col("w.start").alias("window_start"), "calls", "last_at")
