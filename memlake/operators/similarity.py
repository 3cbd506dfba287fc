"""Cosine similarity of many vectors with many: pairs above a threshold, exact neighbours in
blocks, and a bucketed index held as a table.

Vectors meet in tasks that Spark deals by key; nothing here passes through the driver but a
bounded sample for the index's centres. A vector without length is similar to none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.operators.scan import top_k
from memlake.session import cut_lineage, settle

#: Chance that a pair just at the threshold shares no band.
MISS = 1e-6
#: Members of a band's cell beyond which it is compared in square blocks of this side.
CELL = 256
#: Vectors and questions that one task of a search holds.
BLOCK_VECTORS, BLOCK_QUERIES = 8_192, 1_024
#: Numbers that a worker holds at once where rows meet all centres.
PIECE = 2_000_000
#: Vectors that the index's centres are fitted on, and about how many a bucket has.
CENTRE_SAMPLE, BUCKET = 20_000, 2_000


def unit(rows) -> np.ndarray:
    """Rows of unit length in double precision; zero rows stay."""
    m = np.stack([np.asarray(r, np.float64) for r in rows])
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def bands(n: int, threshold: float) -> tuple[int, int]:
    """(bands, bits of each): cells of a few members among ``n``, and a pair at the threshold
    shares a band but with a chance of MISS."""
    bits = max(4, min(24, round(math.log2(max(n, 16) / 4))))
    same = 1 - math.acos(threshold) / math.pi
    return math.ceil(math.log(MISS) / math.log1p(-same ** bits)), bits


def band_keys(points: DataFrame, n_bands: int, bits: int, seed: int = 5) -> DataFrame:
    """(id, cell) of every band of (id, vector): the sides of random hyperplanes."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 1_000):
                cut = pdf.iloc[i:i + 1_000]
                m = unit(cut["vector"])
                planes = np.random.default_rng(seed).standard_normal((m.shape[1], n_bands * bits))
                side = (m @ planes > 0).reshape(len(m), n_bands, bits)
                cell = (side @ (1 << np.arange(bits))) + (np.arange(n_bands, dtype=np.int64) << 32)
                yield pd.DataFrame({"id": np.repeat(cut["id"].to_numpy(), n_bands), "cell": cell.ravel()})

    return points.select("id", "vector").mapInPandas(work, f"id {points.schema['id'].dataType.simpleString()}, cell long")


def similar_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim) of rows (id, vector) with a cosine of ``threshold`` or more, a before b.

    Rows of one and the same vector are a star around their least id, and only that one meets
    others. Candidates share a band; each is compared exactly. Cells with many members are
    compared in blocks, so no task gathers one.
    """
    points = rows.select("id", "vector").where("vector IS NOT NULL AND exists(vector, x -> x <> 0)")
    least = cut_lineage(points.groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    twins = points.join(least.where("n > 1").withColumnRenamed("id", "a"), "vector").where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("sim"))
    reps = least.select("id", "vector")
    keys = cut_lineage(band_keys(reps, *bands(reps.count(), threshold)))
    crowded = keys.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
    crowded = settle(crowded.select(F.col("cell").alias("c_cell"), F.ceil(F.col("n") / CELL).cast("int").alias("sides")))
    marked = keys.join(crowded, F.col("cell") == F.col("c_cell"), "left")
    calm = marked.where("sides IS NULL").select("cell", "id")
    met = calm.select("cell", F.col("id").alias("a")).join(calm.select("cell", F.col("id").alias("b")), "cell").where("a < b").select("a", "b").distinct()
    of = lambda k: reps.select(F.col("id").alias(k), F.col("vector").alias(f"v_{k}"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"a {kind}, b {kind}, sim double"

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sim = np.round((unit(pdf["v_a"]) * unit(pdf["v_b"])).sum(axis=1), 9)
                yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "sim": sim})[sim >= threshold]

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["row"].iat[0] == pdf["col"].iat[0]:
            left = right = pdf
        else:
            own = pdf["side"] == pdf["row"]
            left, right = pdf[own], pdf[~own]
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "sim": []})
        sim = np.round(unit(left["vector"]) @ unit(right["vector"]).T, 9)
        i, j = np.nonzero(sim >= threshold)
        x, y = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        found = pd.DataFrame({"a": np.where(x < y, x, y), "b": np.where(x < y, y, x), "sim": sim[i, j]})
        return found[x != y].drop_duplicates()

    calm_pairs = met.join(of("a"), "a").join(of("b"), "b").mapInPandas(exact, schema)
    dealt = marked.where("sides IS NOT NULL").select("cell", "id", "sides", F.pmod(F.xxhash64("id", "cell"), F.col("sides")).cast("int").alias("side")).join(reps, "id")
    meets = F.transform(F.sequence(F.lit(0), F.col("sides") - 1), lambda o: F.struct(F.least(o, F.col("side")).alias("row"), F.greatest(o, F.col("side")).alias("col")))
    blocks = dealt.select("cell", "id", "vector", "side", F.explode(meets).alias("m")).select("cell", "id", "vector", "side", "m.row", "m.col")
    crowded_pairs = blocks.groupBy("cell", "row", "col").applyInPandas(block, schema)
    return calm_pairs.union(crowded_pairs).distinct().union(twins.select("a", "b", "sim"))


def cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with ``sim``, null where one has no vector."""
    of = lambda k: vectors.select(F.col("id").alias(k), F.col("vector").alias(f"v_{k}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    out = both.drop("v_a", "v_b").withColumn("sim", F.lit(None).cast("double"))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = (pdf["v_a"].notna() & pdf["v_b"].notna()).to_numpy()
            sim = np.full(len(pdf), np.nan)
            if known.any():
                sim[known] = np.round((unit(pdf["v_a"][known]) * unit(pdf["v_b"][known])).sum(axis=1), 9)
            yield pdf.drop(columns=["v_a", "v_b"]).assign(sim=pd.Series(sim, pdf.index).astype(object).where(known, None))

    return both.mapInPandas(exact, out.schema)


# --- neighbours -------------------------------------------------------------------------------


def best_of(queries: DataFrame, corpus: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(query_id, vec_id, similarity): each task's best ``k`` per query of the questions and
    vectors that share ``keys``."""

    def work(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []})
        v = v.sort_values("vec_id")
        sim = np.round(unit(q["vector"]) @ unit(v["vector"]).T, 9)
        order = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"query_id": np.repeat(q["query_id"].to_numpy(), order.shape[1]), "vec_id": v["vec_id"].to_numpy()[order].ravel(), "similarity": np.take_along_axis(sim, order, 1).ravel()})

    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {corpus.schema['vec_id'].dataType.simpleString()}, similarity double"
    return queries.groupBy(*keys).cogroup(corpus.groupBy(*keys)).applyInPandas(work, schema)


def nearest(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Exact nearest neighbours by cosine: (query_id, vec_id, similarity, rank).

    Questions are dealt into slices and vectors into blocks; each slice meets each block in a
    task of bounded size, and only its own best ``k`` of a query leave it.
    """
    n_v, n_q = (max(1, -(-df.count() // size)) for df, size in ((corpus, BLOCK_VECTORS), (queries, BLOCK_QUERIES)))
    n_v = max(n_v, min(corpus.sparkSession.sparkContext.defaultParallelism, n_v * 8)) if n_q == 1 else n_v
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int").alias("slice")).withColumn("block", each(n_v))
    v = corpus.select("vec_id", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(n_v)).cast("int").alias("block")).withColumn("slice", each(n_q))
    return top_k(best_of(q, v, ["slice", "block"], k), ["query_id"], [F.desc("similarity"), F.col("vec_id")], k)


def pieces(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Batches in pieces of so many rows that each holds about PIECE numbers, ``width`` a row."""
    n = max(1, PIECE // max(1, width))
    for pdf in batches:
        for i in range(0, len(pdf), n):
            yield pdf.iloc[i:i + n]


class VectorIndex:
    """Vectors in buckets around centres, as a table under ``path``.

    A question looks into the ``probes`` buckets whose centres are nearest. ``tune`` measures
    recall against ``nearest`` on a sample of questions and takes the fewest probes that reach
    a target; with all buckets probed the search is exact.
    """

    def __init__(self, spark: SparkSession, path: str, centres: np.ndarray, probes: int):
        self.spark, self.path, self.centres, self.probes = spark, path, centres, probes

    @classmethod
    def build(cls, corpus: DataFrame, path: str, bucket: int = BUCKET, sample: int = CENTRE_SAMPLE, rounds: int = 8, seed: int = 9) -> VectorIndex:
        """Centres by spherical k-means on at most ``sample`` vectors, least hash first; then
        every vector goes to its nearest centre."""
        n = corpus.count()
        drawn = corpus.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow()["vector"].to_pylist()
        m = unit(drawn) if drawn else np.zeros((0, 1))
        centres = m[np.random.default_rng(seed).permutation(len(m))[:max(1, min(len(m), -(-n // bucket)))]].copy()
        for _ in range(rounds if len(m) else 0):
            own = (m @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, m)
            some = np.linalg.norm(sums, axis=1) > 0
            centres[some] = unit(sums[some])
        index = cls(corpus.sparkSession, path, centres, len(centres))
        placed = index.placed(corpus.select(F.col("vec_id").alias("id"), "vector"), 1)
        placed.select(F.col("id").alias("vec_id"), "vector", "bucket").repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("bucket").write.mode("error").parquet(path)
        return index

    def table(self) -> DataFrame:
        """(vec_id, vector, bucket)."""
        return self.spark.read.parquet(self.path)

    def placed(self, rows: DataFrame, probes: int) -> DataFrame:
        """(id, vector, bucket): rows with their nearest ``probes`` buckets."""
        held = self.spark.sparkContext.broadcast(self.centres)
        kind = rows.schema["id"].dataType.simpleString()

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pieces(batches, max(held.value.shape[0], probes * held.value.shape[1])):
                if len(pdf):
                    near = np.argsort(-(unit(pdf["vector"]) @ held.value.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                    yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), near.shape[1]), "vector": pdf["vector"].repeat(near.shape[1]).to_numpy(), "bucket": near.ravel()})

        return rows.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInPandas(work, f"id {kind}, vector array<double>, bucket int")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, vec_id, similarity, rank) of each question's best in its buckets. A large
        bucket is met in blocks."""
        table = self.table()
        sizes = settle(table.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK_VECTORS).cast("int").alias("blocks")))
        v = table.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).select("vec_id", "vector", "bucket", "block", F.lit(0).alias("slice"))
        q = self.placed(queries.select(F.col("query_id").alias("id"), "vector"), probes or self.probes).withColumnRenamed("id", "query_id")
        q = q.join(sizes, "bucket").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        slices = max(1, -(-queries.count() // BLOCK_QUERIES))
        q = q.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int")).select("query_id", "vector", "bucket", "block", "slice")
        if slices > 1:
            v = v.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        return top_k(best_of(q, v, ["bucket", "block", "slice"], k), ["query_id"], [F.desc("similarity"), F.col("vec_id")], k)

    def tune(self, questions: DataFrame, k: int, target: float = 0.9) -> float:
        """Set the fewest probes with a recall of ``target`` on ``questions``, by doubling and
        halving; the recall found is returned."""
        want = cut_lineage(nearest(questions, self.table(), k).select("query_id", "vec_id"))
        n = max(1, want.count())
        recall = lambda p: want.join(self.search(questions, k, p), ["query_id", "vec_id"]).count() / n
        low, high, found = 0, 1, recall(1)
        while found < target and high < len(self.centres):
            low, high = high, min(2 * high, len(self.centres))
            found = recall(high)
        while high - low > max(1, high // 8):
            middle = (low + high) // 2
            got = recall(middle)
            low, high, found = (low, middle, got) if got >= target else (middle, high, found)
        self.probes = high
        return found
