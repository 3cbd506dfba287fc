"""Vector pairs and neighbours against all pairs in numpy."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from memlake.operators import similarity as sim


def table(spark, m, name="id"):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)], f"{name} long, vector array<double>").repartition(5)


def clustered(n, groups, noise, seed=1, width=24):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((groups, width))
    return centres[r.integers(0, groups, n)] + noise * r.standard_normal((n, width))


def test_pairs_equal_all_pairs(spark, monkeypatch):
    m = clustered(600, 60, 0.28)
    m[7] = 0
    m[50:60] = m[49]
    u = sim.unit(m)
    s = np.round(u @ u.T, 9)
    rest = [k for k in range(600) if not 50 <= k < 60]
    want = {(a, b) for a in rest for b in rest if a < b and s[a, b] >= 0.92} | {(49, b) for b in range(50, 60)}
    pairs = lambda: {(r.a, r.b): r.sim for r in sim.similar_pairs(table(spark, m), 0.92).collect()}
    got = pairs()
    assert set(got) == want and all(abs(v - s[k]) < 1e-8 for k, v in got.items())
    monkeypatch.setattr(sim, "CELL", 3)  # nearly every cell is worked in blocks
    assert set(pairs()) == want
    assert sim.similar_pairs(table(spark, m).where(F.lit(False)), 0.92).count() == 0


def test_nearest_in_blocks(spark, monkeypatch):
    m = clustered(300, 20, 0.5)
    u = sim.unit(m)
    want = {(q, int(v)) for q in range(0, 300, 10) for v in np.lexsort((np.arange(300), -np.round(u @ u[q], 9)))[:6]}
    monkeypatch.setattr(sim, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(sim, "BLOCK_QUERIES", 7)
    asked = table(spark, m, "query_id").where("query_id % 10 = 0")
    got = sim.nearest(asked, table(spark, m, "vec_id"), 6)
    assert {(r.query_id, r.vec_id) for r in got.collect()} == want


def test_index_reaches_its_recall_and_is_exact_with_all_buckets(spark, tmp_path, monkeypatch):
    m = clustered(3_000, 40, 0.6)
    corpus, asked = table(spark, m, "vec_id"), table(spark, m, "query_id").where("query_id % 100 = 0")
    index = sim.VectorIndex.build(corpus, str(tmp_path / "index"), bucket=100)
    assert index.table().count() == 3_000 and len(index.centres) == 30
    recall = index.tune(table(spark, m, "query_id").where("query_id % 50 = 1"), 6)
    exact = {(r.query_id, r.vec_id) for r in sim.nearest(asked, corpus, 6).collect()}
    found = {(r.query_id, r.vec_id) for r in index.search(asked, 6).collect()}
    assert recall >= 0.9 and len(exact & found) >= 0.88 * len(exact) and index.probes < 30
    monkeypatch.setattr(sim, "BLOCK_VECTORS", 30)
    monkeypatch.setattr(sim, "BLOCK_QUERIES", 11)
    assert {(r.query_id, r.vec_id) for r in index.search(asked, 6, probes=30).collect()} == exact


def test_rows_meet_centres_in_pieces_of_bounded_size():
    pdf = pd.DataFrame({"id": range(10_000)})
    cut = list(sim.pieces(iter([pdf]), 20_000))
    assert max(len(p) for p in cut) * 20_000 <= sim.PIECE and [k for p in cut for k in p["id"]] == list(range(10_000))
