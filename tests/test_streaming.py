"""Streams equal the batch result."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from memlake.operators import windows as w
from memlake.sources import exports as x
from memlake.streaming import ingest, sessions, state
from tests.conftest import SF

T0 = dt.datetime(2024, 1, 1)


def test_tail_reads_each_file_once(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()

    def put(name, ids):
        (src / name).write_text("".join(f'{{"type":"user","uuid":"u{i}","timestamp":"2024-01-01T00:00:0{i}","message":{{"content":"hello {i}"}}}}\n' for i in ids) + "{broken\n")

    def run():
        ev = x.parse_agent_lines(ingest.tail_lines(spark, str(src)), "session")
        ingest.run_append(ev, out, ck).awaitTermination()
        return {r.event_id for r in spark.read.parquet(out).collect()}

    put("a.jsonl", [1, 2])
    assert run() == {"session:a:u1", "session:a:u2"}
    put("b.jsonl", [3])
    assert run() == {"session:a:u1", "session:a:u2", "session:b:u3"}
    assert run() == {"session:a:u1", "session:a:u2", "session:b:u3"}


def test_growing_files_are_read_by_whole_lines(spark, tmp_path):
    """Appends, a torn last line, a file replaced by a shorter one, stretches cut inside lines."""
    from memlake.streaming.growing import tail_growing

    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    (src / "deep").mkdir(parents=True)

    def run(stretch=7):
        q = tail_growing(spark, str(src), stretch=stretch).writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"))
        q.option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.conversation_id, r.line) for r in spark.read.parquet(out).collect()) if (tmp_path / "out").exists() else []

    a, b = src / "a.jsonl", src / "deep" / "b.jsonl"
    a.write_bytes(b"one\ntwo two two two\ntor")
    (src / "ignored.txt").write_text("no\n")
    first = [("a", "one"), ("a", "two two two two")]
    assert run() == first
    with a.open("ab") as f:
        f.write("n wörd\r\n\n".encode())
    b.write_bytes(b"x\n" * 9)
    second = sorted([*first, ("a", "torn wörd"), ("a", ""), *[("b", "x")] * 9])
    assert run() == second
    assert run() == second
    a.write_bytes(b"new\n")  # shorter: another file under the name
    with b.open("ab") as f:
        f.write(b"no end")
    assert run(1_000) == sorted([*second, ("a", "new")])


def test_capped_sessions_with_late_rows_over_several_batches(spark, tmp_path):
    """Rows arrive out of order, up to the delay late, a file a batch; then the stream moves on
    and everything becomes final."""
    import random

    rng = random.Random(8)
    times = {c: sorted(rng.sample(range(0, 400_000, 7), 60)) for c in range(4)}
    late = [(c, T0 + dt.timedelta(seconds=s + rng.randrange(1)), s // 40_000 + (rng.random() < 0.3)) for c, ss in times.items() for s in ss]
    src = tmp_path / "in"
    for k in range(12):
        part = [(c, at) for c, at, b in late if b == k]
        rng.shuffle(part)
        if part:
            spark.createDataFrame(part, "conversation_id long, observed_at timestamp_ntz").coalesce(1).write.parquet(str(src / f"p{k:02d}"))

    def run(path, n):
        rows = spark.readStream.schema("conversation_id long, observed_at timestamp_ntz").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(path))
        w_ = sessions.capped_sessions(rows, 7200, 6, 3, delay="1 day", idle="2 days", slot="1 hour")
        q = w_.writeStream.outputMode("append").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/w/batch={i}")).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(f"{tmp_path}/w")

    everything = spark.createDataFrame([(c, at, i) for i, (c, at, _) in enumerate(late)], "conversation_id long, observed_at timestamp_ntz, event_id long")
    _, wins = w.time_gap_windows(everything, ["observed_at", "event_id"], 7200, 6, 3)
    want = {(r.conversation_id, r.n_events, r.start_at) for r in wins.collect()}
    as_set = lambda df: {(r.conversation_id, r.n_events, r.start_at) for r in df.select("conversation_id", "n_events", F.timestamp_micros("start_us").cast("timestamp_ntz").alias("start_at")).where("conversation_id < 99").collect()}
    written = run(src, 12)
    assert as_set(sessions.current_windows(written)) == want
    spark.createDataFrame([(99, T0 + dt.timedelta(days=30)), (99, T0 + dt.timedelta(days=30, hours=1))], "conversation_id long, observed_at timestamp_ntz").coalesce(1).write.parquet(str(src / "z"))
    spark.createDataFrame([(99, T0 + dt.timedelta(days=60))], "conversation_id long, observed_at timestamp_ntz").coalesce(1).write.parquet(str(src / "zz"))
    written = run(src, 14)
    assert as_set(written.where("final")) == want


def test_capped_sessions_equal_batch_windows(spark, tables):
    from memlake.plans.p_streaming import _st3b

    ev = tables.f_events.select("conversation_id", "observed_at", "event_id")
    _, wins = w.time_gap_windows(ev, ["observed_at", "event_id"], 12 * 3600, 6, 3)
    want = {(r.conversation_id, r.n_events, r.start_at) for r in wins.collect()}
    got = {(r.conversation_id, r.n_events, r.start_at) for r in
           _st3b(tables).select("conversation_id", "n_events", F.timestamp_micros("start_us").cast("timestamp_ntz").alias("start_at")).collect()}
    assert got == want and len(got) > 0


def test_gap_of_exactly_the_limit_splits(spark):
    rows = [(1, T0), (1, T0 + dt.timedelta(hours=2)), (1, T0 + dt.timedelta(hours=3, minutes=59, seconds=59))]
    df = spark.createDataFrame(rows, "conversation_id long, observed_at timestamp_ntz")
    assert sorted(r.n_events for r in sessions.gap_sessions(df, 7200).collect()) == [1, 2]


def test_tail_streams_every_turn_that_the_reader_keeps(spark, tables):
    from memlake.plans.p_streaming import tailed

    want = {(f"u{r.conversation_id}-{r.turn}", r.actor_type) for r in tables.f_conv.where("actor_type <> 'system'").collect()}
    got = [(r.turn_id, r.actor_type) for r in tailed(tables).collect()]
    assert set(got) == want and len(got) == len(want) and {a for _, a in got} == {"user", "assistant"}


def test_a_batch_reads_only_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "journal")
    write = ingest.append_new(path)
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("CAST(id AS STRING) AS event_id", "id AS n")
    write(rows(0, 500), 0)
    write(rows(490, 495).union(rows(700, 703)), 1)
    write(rows(490, 495).union(rows(700, 703)), 1)  # a replay
    journal = spark.read.parquet(path)
    assert journal.count() == 503 and journal.select("event_id").distinct().count() == 503
    plan = ingest.held_ids(journal, rows(7, 9))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(event_id,7)" in plan
    assert {r.event_id for r in ingest.held_ids(journal, rows(7, 9)).collect()} >= {"7", "8"}
    assert ingest.held_ids(journal, rows(7, 7)).count() == 0


def test_derived_rows_are_not_broadcast(spark, tmp_path):
    from memlake.streaming import state

    for name, rows in (("rejected", [(1, "no text"), (2, "no text")]), ("derived", [(2, "m2")])):
        spark.createDataFrame(rows, f"event_id long, {'error' if name == 'rejected' else 'memory_id'} string").write.parquet(str(tmp_path / name))
    left = state.pending_rejects(spark.read.parquet(str(tmp_path / "rejected")), spark.read.parquet(str(tmp_path / "derived")))
    assert [r.event_id for r in left.collect()] == [1]
    assert "Broadcast" not in left._jdf.queryExecution().executedPlan().toString()


def test_thread_state_calls_do_not_grow_with_conversations():
    """Batches of many chunks and conversations make a bounded number of state calls, and give what
    one pass over all rows gives."""
    class Map(dict):
        calls = 0
        def count(self):
            Map.calls += 1
            return self
        containsKey = lambda self, k: k in self.count()
        getValue = lambda self, k: self.count()[k]
        updateValue = lambda self, k, v: self.count().__setitem__(k, v)
        iterator = lambda self: iter(self.items())
    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held
        def update(self, v):
            self.held = v
    rng = np.random.default_rng(0)
    n = 30_000
    rows = pd.DataFrame({"conversation_id": [None if c < 3 else f"c{c}" for c in rng.integers(0, 9_000, n)], "memory_id": [f"m{k}" for k in range(n)], "event_id": range(n), "at_us": rng.integers(0, 5_000, n),
                         "status": rng.choice(["open", "stalled", None], n), "harness": rng.choice(["a", "b", None], n), "reasoning_kind": "k", "project": None})
    s = state.ThreadState()
    s.main, s.conversations, s.values = Value(), Map(), Map()
    for batch in np.array_split(np.arange(n), 3):
        got = list(s.handleInputRows(("t",), iter([rows.iloc[c] for c in np.array_split(batch, 10)]), None))[0].iloc[0]
    assert Map.calls <= 3 * 3 * (state.BUCKETS + 3)
    by = rows.sort_values(["at_us", "memory_id"])
    assert got["n_conversations"] == rows["conversation_id"].nunique() and got["episode_count"] == n
    assert (got["first_event_id"], got["last_event_id"], got["status"]) == (by["event_id"].iloc[0], by["event_id"].iloc[-1], by["status"].dropna().iloc[-1])
    assert got["harnesses"] == by["harness"].dropna().drop_duplicates().tolist() and got["kinds"] == ["k"] and got["projects"] == []


def test_capped_session_calls_do_not_grow_with_conversations():
    """Rows and timers of many conversations and slots make a bounded number of state calls, and give
    what the rules give row by row."""
    class State:
        calls, held = 0, None
        def did(self):
            State.calls += 1
            return self
        get = lambda self: self.did().held or ([] if self.many else None)
        def __init__(self, many):
            self.many = many
        def update(self, v):
            self.did().held = v
        def appendValue(self, v):
            self.did().held = [*(self.held or []), v]
        def clear(self):
            self.did().held = None
    class Handle:
        timers = set()
        getValueState = lambda self, *a: State(False)
        getListState = lambda self, *a: State(True)
        registerTimer = lambda self, at: State(0).did() and self.timers.add(at)
        deleteTimer = lambda self, at: State(0).did() and self.timers.discard(at)
    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms
    gap, cap, minimum, hour = 7_200_000_000, 4, 3, 3_600_000
    def by_row(times):
        blocks, wins = [], []
        for t in sorted(times):
            if blocks and t - blocks[-1][2] < gap and blocks[-1][0] < cap:
                blocks[-1] = [blocks[-1][0] + 1, blocks[-1][1], t]
            else:
                blocks.append([1, t, t])
        for n, a, b in blocks:
            if wins and (n < minimum or (len(wins) == 1 and wins[0][0] < minimum)):
                wins[-1] = [wins[-1][0] + n, wins[-1][1], b]
            else:
                wins.append([n, a, b])
        return [tuple(w) for w in wins]
    rng = np.random.default_rng(0)
    days, per = 8, 4_000
    us = np.concatenate([rng.integers(d * 86_400_000_000, (d + 1) * 86_400_000_000, per) for d in range(days)])
    ids = rng.integers(-300, 300, days * per) * 2**53 + 1
    s, out, seen = sessions.TimedWindows(gap, cap, minimum, 24 * hour, hour), [], []
    s.init(handle := Handle())
    for d in range(days):
        rows = pd.DataFrame({"conversation_id": ids, "us": us}).iloc[rng.permutation(np.arange(d * per, (d + 1) * per))]
        out += [x.assign(batch=d) for x in s.handleInputRows((5,), iter([rows.iloc[c] for c in np.array_split(np.arange(per), 4)]), At(0))]
        assert len(handle.timers) == 1
        for at in [t for t in handle.timers if t <= d * 24 * hour]:
            handle.timers.discard(at)
            out += [x.assign(batch=d) for x in s.handleExpiredTimer((5,), At(d * 24 * hour), At(at))]
        seen.append(State.calls)
    assert max(np.diff([0, *seen])) < 30
    wins = pd.concat(out)
    newest = wins.groupby("conversation_id")["batch"].transform("max")
    now = {tuple(map(int, r)) for r in wins[wins["final"] | (wins["batch"] == newest)][["conversation_id", "n_events", "start_us", "end_us"]].to_numpy()}
    assert now == {(int(c), *w) for c in np.unique(ids) for w in by_row(us[ids == c].tolist())}
    assert wins["final"].sum() > len(now) / 2 and not wins[wins["final"]].duplicated(["conversation_id", "start_us"]).any()
    at = (2 * days + 1) * 24 * hour  # everyone has been idle
    out += list(s.handleExpiredTimer((5,), At(at), At(at)))
    assert {tuple(map(int, r)) for r in pd.concat(out).query("final")[["conversation_id", "n_events", "start_us", "end_us"]].to_numpy()} == now
    assert s.folded.held is None and s.waiting.held is None
    nobody = pd.concat(s.handleInputRows((sessions.BUCKETS,), iter([pd.DataFrame({"conversation_id": [0, 0], "us": [5, 6]})]), At(0)))
    assert nobody["conversation_id"].isna().all() and nobody["n_events"].tolist() == [2]


def test_sessions_of_rows_without_a_conversation(spark, tmp_path):
    at = [T0 + dt.timedelta(minutes=m) for m in (0, 1, 2, 400, 401, 402)]
    rows = [(c, x) for c in (None, 0, 2**53 + 1) for x in at] + [(0, None), (7, None)]
    spark.createDataFrame(rows, "conversation_id long, observed_at timestamp_ntz").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conversation_id long, observed_at timestamp_ntz").parquet(str(tmp_path / "in"))
    q = sessions.capped_sessions(stream, 7200, 6, 3).writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/w/batch={i}"))
    q.option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = sessions.current_windows(spark.read.parquet(f"{tmp_path}/w")).select("conversation_id", "n_events").collect()
    assert sorted(map(str, got)) == sorted(f"Row(conversation_id={c}, n_events=3)" for c in (None, 0, 2**53 + 1) for _ in (0, 1))
