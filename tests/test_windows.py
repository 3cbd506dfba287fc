"""Windows against a plain sequential statement of the rules, on random conversations."""

import datetime as dt
import random

from pyspark.sql import functions as F

from memlake.operators import windows as w

ORD = ["observed_at", "event_id"]
T0 = dt.datetime(2024, 1, 1)


def sequential(times, gap, cap, minimum):
    """Windows as lists of indexes, built turn by turn."""
    if len(times) < minimum:
        return [list(range(len(times)))]
    out, cur = [], [0]
    for i in range(1, len(times)):
        if (times[i] - times[i - 1]).total_seconds() >= gap or len(cur) >= cap:
            out.append(cur)
            cur = [i]
        else:
            cur.append(i)
    out.append(cur)
    merged = []
    for win in out:
        if merged and len(win) < minimum:
            merged[-1] = merged[-1] + win
        else:
            merged.append(win)
    if len(merged) >= 2 and len(merged[0]) < minimum:
        merged[:2] = [merged[0] + merged[1]]
    return merged


def make(spark, seed, conversations=60):
    rng = random.Random(seed)
    rows, want, no = [], {}, 0
    for c in range(conversations):
        at, times, ids = T0, [], []
        for _ in range(rng.randint(1, 40)):
            at += dt.timedelta(minutes=rng.choice([1, 5, 30, 119, 120, 121, 600, 3000]))
            times.append(at)
            ids.append(no)
            rows.append((c, no, at))
            no += 1
        for k, win in enumerate(sequential(times, 7200, 5, 3)):
            for i in win:
                want[ids[i]] = k
    df = spark.createDataFrame(rows, "conversation_id long, event_id long, observed_at timestamp_ntz")
    return df, want


def test_time_gap_windows_equal_sequential_rules(spark):
    df, want = make(spark, 1)
    for hours in (1, 24, 24 * 365):  # chunk width must not change the result
        rows, _ = w.time_gap_windows(df.repartition(7), ORD, 7200, 5, 3, hours=hours)
        got = {r.event_id: r.window_no for r in rows.select("event_id", "window_no").collect()}
        assert got == want


def test_windows_are_total_and_conversation_scoped(spark):
    df, want = make(spark, 2)
    rows, wins = w.time_gap_windows(df, ORD, 7200, 5, 3)
    assert rows.count() == len(want) == wins.agg(F.sum("n_events")).first()[0]
    assert rows.groupBy("event_id").count().where("count > 1").isEmpty()


def test_one_conversation_holding_everything(spark):
    df = spark.range(3000).select(F.lit(1).cast("long").alias("conversation_id"), F.col("id").alias("event_id"),
                                  F.expr("timestampadd(MINUTE, CAST(id * 7 AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("observed_at"))
    _, wins = w.time_gap_windows(df, ORD, 7200, 20, 3)
    assert wins.count() == 150 and wins.agg(F.sum("n_events")).first()[0] == 3000


def test_preceding_assistant_ignores_chunk_borders(spark):
    rows = [(1, i, T0 + dt.timedelta(hours=9 * i), "assistant" if i % 4 == 0 else "user", f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "conversation_id long, event_id long, observed_at timestamp_ntz, actor_type string, text string")
    got = {r.event_id: r.preceding_text for r in w.preceding_assistant(df, ORD).collect()}
    assert got == {i: (f"t{(i - 1) // 4 * 4}" if i else None) for i in range(40)}


def test_turn_cap_matches_search(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for c in range(40):
        lens = [rng.randint(1, 3000) for _ in range(rng.randint(1, 12))]
        rows += [(c, "x" * n) for n in lens]
        fits = [cap for cap in range(200, 2001) if sum(min(n, cap) for n in lens) <= 4000]
        want[c] = max(fits) if fits else None
    df = spark.createDataFrame(rows, "conversation_id long, text string")
    got = {r.conversation_id: r.cap for r in w.turn_cap(df, ["conversation_id"], F.lit(4000)).collect()}
    assert got == want


def test_no_row_is_lost_to_nulls_or_a_burst(spark):
    """Null keys and times, and a day that holds a third of all rows."""
    from memlake.operators.scan import Running, running, time_chunk

    rows = [(1, k, T0 + dt.timedelta(seconds=k)) for k in range(200)] + [(1, 500 + k, T0 + dt.timedelta(days=k)) for k in range(2, 50)]
    rows += [(1, 900, None), (1, 901, None), (None, 902, T0), (None, 903, T0 + dt.timedelta(days=3)), (None, 904, None)]
    df = spark.createDataFrame(rows, "conversation_id long, event_id long, observed_at timestamp_ntz").repartition(5)
    for hours in (1, 24, 24 * 365):
        got = running(df, ["conversation_id"], ORD, time_chunk(F.col("observed_at"), hours), Running(sums={"pos": F.lit(1).cast("bigint")}, lags={"before": F.col("event_id")})).collect()
        assert len(got) == len(rows)
        for key in (1, None):
            own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2] is None, r[2] or T0, r[1]))
            place = {r.event_id: (r.pos, r.before) for r in got if r.conversation_id == key}
            assert [place[r[1]] for r in own] == [(i + 1, own[i - 1][1] if i else None) for i in range(len(own))]
        placed, wins = w.time_gap_windows(df, ORD, 7200, 20, 3, hours=hours)
        assert placed.count() == len(rows) and sum(r.n_events for r in wins.collect()) == len(rows)
        assert w.fixed_turn_windows(df, ORD).count() == len(rows)
