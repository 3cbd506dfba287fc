"""Exact dedup by content-defined chunk recipes.

A document's normalised text is cut where its content says so, each chunk becomes a 64-bit
identifier, and documents are equal when their ordered identifier lists (recipes) are equal.
Identifiers are verified: chunks that share one but differ in SHA-256 get told apart by that
digest. Long documents never move; only recipes and digests are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memlake.llm.common import WHITE
from memlake.session import cut_lineage

#: A chunk ends at the first sentence end after 1,024 code points, or after 8,192.
CHUNK_PATTERN = r"(?s).{1024,8192}?[.!?。]|.{1,8192}"


def normalise(text: Column) -> Column:
    """Text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def recipes(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, n_points, text_sha256, parts) per row; parts holds (h, s) of each chunk in
    order. Held under the checkpoint folder, so uid stays the same in later reads."""
    norm = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_points"), normalise(F.col("text")).alias("norm"))
    chunks = F.regexp_extract_all("norm", F.lit(CHUNK_PATTERN), 0)
    parts = F.transform(chunks, lambda c: F.struct(F.xxhash64(c).alias("h"), F.unhex(F.sha2(c, 256)).alias("s")))
    return cut_lineage(norm.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "n_points", F.sha2("norm", 256).alias("text_sha256"), parts.alias("parts")))


def verified(rows: DataFrame) -> DataFrame:
    """Recipes as identifier lists: ``ids`` the 64-bit identifiers, ``ties`` the digests of the
    chunks whose identifier stands for more than one content (none, but for collisions)."""
    chunks = rows.select(F.explode("parts").alias("p")).select("p.h", "p.s")
    shared = cut_lineage(chunks.groupBy("h").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi").select("h"))
    ids = F.transform("parts", lambda p: p["h"]).alias("ids")
    if shared.isEmpty():
        return rows.select("uid", "doc_id", "n_points", "text_sha256", ids, F.lit(None).cast("array<binary>").alias("ties"))
    touched = rows.select("uid", F.posexplode("parts").alias("pos", "p")).select("uid", "pos", "p.h", "p.s").join(shared, "h", "left_semi")
    ties = touched.groupBy("uid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda t: t["s"]).alias("ties"))
    return rows.join(ties, "uid", "left").select("uid", "doc_id", "n_points", "text_sha256", ids, "ties")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points stays, then the smallest doc_id (a null
    id last), then one of the rows that repeat it. Null and empty texts are equal to each
    other and to white space alone. An empty table gives no rows.
    """
    rows = verified(recipes(docs))
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("low"), F.bitwise_not("uid").alias("first"), "doc_id", "uid"))
    # The groups are written before the join: both sides then arrive by a plain exchange, which
    # adaptive execution can split when one group holds a large share of the rows.
    groups = cut_lineage(rows.groupBy("ids", "ties").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")).where("group_size > 1"))
    g = groups.select(F.col("ids").alias("g_ids"), F.col("ties").alias("g_ties"), "group_size", F.col("best.doc_id").alias("best_id"), F.col("best.uid").alias("best_uid"))
    j = rows.join(g, (F.col("ids") == F.col("g_ids")) & F.col("ties").eqNullSafe(F.col("g_ties")), "left")
    grouped = F.col("group_size").isNotNull()
    return j.select(
        "doc_id", F.when(grouped, F.col("best_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.when(grouped, F.col("uid") == F.col("best_uid")).otherwise(F.lit(True)).alias("kept"), "text_sha256")
