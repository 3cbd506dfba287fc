"""Ledger operators against sequential statements."""

import datetime as dt
import random

from memlake.operators import ledger as l

T0 = dt.datetime(2024, 1, 1)


def greedy(sizes, budget):
    part, acc, out = 1, None, []
    for s in sizes:
        if acc is not None and acc + s > budget:
            part, acc = part + 1, 0
        acc = (acc or 0) + s
        out.append(part)
    return out


def test_chunk_by_budget_equals_greedy_for_every_block_size(spark):
    rng = random.Random(3)
    rows, want, no = [], {}, 0
    for k in range(12):
        sizes = [rng.choice([1, 10, 40, 90, 250]) for _ in range(rng.randint(1, 90))]
        for i, (s, p) in enumerate(zip(sizes, greedy(sizes, 100))):
            rows.append((f"k{k}", no, T0 + dt.timedelta(minutes=i), s))
            want[no] = p
            no += 1
    df = spark.createDataFrame(rows, "k string, id long, at timestamp_ntz, size int")
    for block in (3, 7, 1000):
        got = {r.id: r.part for r in l.chunk_by_budget(df, ["k"], ["at", "id"], "size", 100, block_rows=block).collect()}
        assert got == want


def test_names_continue_after_the_highest(spark):
    new = spark.createDataFrame([("Chat GPT", "Art", i, T0 + dt.timedelta(days=i)) for i in range(5)], "harness string, project string, id int, at timestamp_ntz")
    used = spark.createDataFrame([("chat-gpt-art-007",), ("chat-gpt-art-3",), ("other-001",)], "name string")
    names = [r.name for r in l.next_names(new, used, ["at", "id"]).orderBy("id").collect()]
    assert names == [f"chat-gpt-art-{n:03d}" for n in range(8, 13)]


def test_versions_compare_by_number(spark):
    df = spark.createDataFrame([("a", 1, "1.9", "queued"), ("b", 1, "1.10", "approved"), ("c", 2, "2.0", "queued")], "memory_id string, event_id int, policy_version string, approval_state string")
    assert [r.memory_id for r in l.stale_versions(df, "queued").collect()] == ["a"]


def test_bulk_reject_leaves_undated_rows(spark):
    df = spark.createDataFrame([("a", "queued", "x", None), ("b", "queued", "x", T0)], "memory_id string, approval_state string, category string, event_date timestamp_ntz")
    assert [r.memory_id for r in l.bulk_reject_plan(df, "queued", "x", "2025-01-01").collect()] == ["b"]


def test_correction_is_two_linked_versions(spark):
    mem = spark.createDataFrame([("a", 1, "c", "old", "r", "queued")], "memory_id string, event_id int, category string, statement string, reason string, approval_state string")
    fix = spark.createDataFrame([("a", "new", "me", "typo")], "memory_id string, new_statement string, reviewer string, why string")
    rows = {r.memory_id: r for r in l.correct(mem, fix).collect()}
    assert rows["a"].superseded_by == "a::corrected" and rows["a::corrected"].supersedes == "a"
    assert rows["a::corrected"].approval_state == "queued_for_review"


def test_a_mixed_batch_is_refused(spark):
    from memlake.operators import ledger as l

    memories = spark.createDataFrame([("m1",), ("m2",), ("m3",)], "memory_id string")
    audit = spark.createDataFrame([(1, "m1", "queued", "a"), (2, "m2", "queued", "a"), (3, "m1", "approved", "b"), (4, "m3", "queued", "b")], "audit_id int, memory_id string, prior_state string, batch_id string")
    restored, refused = l.revert_batch(memories, audit, "a")
    assert {(r.memory_id, r.restored_state) for r in restored.collect()} == {("m1", "queued"), ("m2", "queued")} and refused.count() == 0
    restored, refused = l.revert_batch(memories, audit, "b")
    assert restored.count() == 0 and {(r.prior_state, r.rows) for r in refused.collect()} == {("approved", 1), ("queued", 1)}
    assert [df.count() for df in l.revert_batch(memories, audit, "none")] == [0, 0]


def test_a_mixed_batch_is_restored_row_by_row(spark):
    memories = spark.createDataFrame([("m1",), ("m2",), ("m3",)], "memory_id string")
    audit = spark.createDataFrame([(2, "m1", 5, "approved", "a"), (1, "m1", 5, "queued", "a"), (3, "m2", 4, "rejected", "a"), (4, "m3", 1, "queued", "b")], "audit_id int, memory_id string, at int, prior_state string, batch_id string")
    assert {(r.memory_id, r.restored_state) for r in l.restore_rows(memories, audit, "a").collect()} == {("m1", "queued"), ("m2", "rejected")}
