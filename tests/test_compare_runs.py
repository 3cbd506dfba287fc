import random

from memlake.operators import evaluate as e


def test_best_match_is_found_whatever_floor_it_is_over(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(14)] + ["memory", "about"] * 4
    make = lambda n: [(f"m{k}", k % 5, " ".join(rng.choices(vocabulary, k=rng.randint(1, 7)))) for k in range(n)]
    old, new = make(150), make(150)
    schema = "memory_id string, conversation_id long, statement string"
    got = {(r.new_id, r.old_id, r.similarity) for r in e.compare_runs(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()}
    want = set()
    for i, c, s in new:
        a = set(s.split())
        found = [(-round(2 * len(a & set(t.split())) / (len(a) + len(set(t.split()))), 6), j) for j, d, t in old if c == d]
        if (best := min(found, default=(0, "")))[0] <= -0.6:
            want.add((i, best[1], -best[0]))
    assert got == want and {s for _, _, s in want} & {0.666667, 0.75} and max(s for _, _, s in want) == 1.0


def test_a_sure_match_raises_no_candidates_of_a_lower_floor(spark, monkeypatch):
    """Statements of one kind are all alike, yet each has its own number."""
    seen = []
    real = e.cut_lineage
    monkeypatch.setattr(e, "cut_lineage", lambda df: seen.append(real(df)) or seen[-1])
    rows = [(str(k), 1, f"memory {k} about click") for k in range(60)]
    df = spark.createDataFrame(rows, "memory_id string, conversation_id long, statement string")
    assert {(r.new_id, r.old_id) for r in e.compare_runs(df, df).collect()} == {(str(k), str(k)) for k in range(60)}
    assert len(seen) == 4 and seen[-1].count() == 0  # sets of both, the sure matches, nobody left
