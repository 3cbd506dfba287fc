"""Source divergence audit: how far the term shares of each source of a language lie apart.

Duplicate texts collapse first: texts that are the same in a language become one row with the
number of copies in each source, so a text is tokenized once however often it was copied. Its
weighted document frequencies and counts are added up before any two sources meet. Pairs of
sources are then compared on the counted terms only: terms are dealt into chunks and sources
into blocks, a task holds one chunk of two blocks, and only sums for two sources leave it.

All arithmetic is on integers; products that may pass 64 bits are decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from memlake.llm.common import ascii_lower
from memlake.llm.token_files import scratch
from memlake.session import cut_lineage, settle

#: Fixed values of the contract.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS, TOP, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
#: Terms of a chunk and sources of a block: a task holds at most chunk x two blocks numbers
#: of each pair of blocks. They change the work's shape, never the result.
CHUNK_TERMS, BLOCK_SOURCES = 4_000, 128
#: Copies of one text are listed by source, at most so many in a row.
LIST_SOURCES = 4_096


def collapsed(docs: DataFrame, lists: int) -> DataFrame:
    """(lang, text, copies): one row per distinct text of a language with the copies (source,
    n) of it; where a language has very many sources, ``lists`` rows share them."""
    keyed = docs.withColumn("h", F.unhex(F.sha2("text", 256)))
    by_source = keyed.groupBy("lang", "h", "source").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("source"), F.lit(lists)).alias("part")
    copies = by_source.groupBy("lang", "h", part).agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    texts = keyed.groupBy("lang", "h").agg(F.any_value("text").alias("text"))
    return texts.join(copies.drop("part"), ["lang", "h"]).select("lang", "text", "copies")


def tallies(texts: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents in each source."""
    words = texts.select("lang", "copies", F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), 0).alias("words"))
    both = F.array(F.struct("words", F.lit(False).alias("once")), F.struct(F.array_distinct("words").alias("words"), F.lit(True).alias("once")))
    dealt = words.select("lang", "copies", F.explode(both).alias("b")).select("lang", "b.words", "b.once", F.explode("copies").alias("c"))
    terms = dealt.select("lang", "c.source", F.when(F.col("once"), 0).otherwise(F.col("c.n")).alias("n"), F.when(F.col("once"), F.col("c.n")).otherwise(0).alias("docs"), F.explode("words").alias("term"))
    return terms.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)) of three columns, exact beyond 64 bits."""
    top = f"CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + {PRIOR} AS DECIMAL(20, 0))"
    return F.expr(f"1L + {top} div CAST({total} + {PRIOR} * {terms} AS DECIMAL(20, 0))")


def pair_sums(counted: DataFrame, groups: DataFrame, chunks: int, block: int) -> DataFrame:
    """(lang, a, b, value) of each two sources of a language, a before b: the sum of |p - q|
    over all kept terms. Terms that occur in neither block add the same difference each."""
    index = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    blocks = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) / block)
    placed = cut_lineage(groups.withColumn("i", index).withColumn("blocks", blocks))
    at = F.floor(F.col("i") / block)
    chunk = F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int")
    rows = counted.join(placed.select("lang", "source", "i", "blocks"), ["lang", "source"]).select("lang", chunk.alias("chunk"), "i", "blocks", "term", "p")
    bases = placed.select("lang", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "i", "blocks", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    dealt = rows.unionByName(bases).withColumn("at", at).withColumn("other", other).select(
        "lang", "chunk", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), "at", "i", "term", "p")
    schema = "lang string, a int, b int, value long, covered long"
    names = ["lang", "a", "b", "value", "covered"]

    def work(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, _, lo, hi = (k.as_py() for k in key)
        t = pa.Table.from_batches(list(batches))
        term, i, p, side = t["term"].combine_chunks(), t["i"].to_numpy(), t["p"].to_numpy(), t["at"].to_numpy()
        is_base = term.is_null().to_numpy(zero_copy_only=False)
        sources, column = np.unique(i, return_inverse=True)
        base = np.zeros(len(sources), np.int64)
        base[column[is_base]] = p[is_base]
        codes = term.dictionary_encode()
        matrix = np.tile(base, (len(codes.dictionary), 1))
        matrix[codes.indices.to_numpy(zero_copy_only=False)[~is_base].astype(np.int64), column[~is_base]] = p[~is_base]
        of = np.zeros(len(sources), np.int64)
        of[column] = side
        left, right = np.flatnonzero(of == lo), np.flatnonzero(of == hi)
        for x in left.tolist():
            ys = right[sources[right] > sources[x]]
            if len(ys):
                sums = np.abs(matrix[:, ys] - matrix[:, [x]]).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ys)), pa.array(np.full(len(ys), sources[x], np.int32)), pa.array(sources[ys].astype(np.int32)),
                                                  pa.array(sums), pa.array(np.full(len(ys), len(matrix), np.int64))], names=names)

    sums = dealt.groupBy("lang", "chunk", "lo", "hi").applyInArrow(work, schema).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("covered").alias("covered"))
    of = lambda k: placed.select("lang", F.col("i").alias(k), F.col("source").alias(f"source_{k}"), F.col("base").alias(f"base_{k}"), F.col("terms").alias(f"terms_{k}"))
    named = sums.join(of("a"), ["lang", "a"]).join(of("b"), ["lang", "b"])
    rest = (F.col("terms_a") - F.col("covered")) * F.abs(F.col("base_a") - F.col("base_b"))
    return named.select("lang", F.col("source_a").alias("a"), F.col("source_b").alias("b"), (F.col("value") + rest).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, chunk_terms: int = CHUNK_TERMS, block: int = BLOCK_SOURCES, list_sources: int = LIST_SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair`` ranks every other source of the language by its distance, part ``term`` the
    ``top`` terms that a source uses more than its language does. Null lang, source and text
    count as empty; repeated rows count each. A language without a kept term gives pairs of
    value 0; a source alone in its language gives no pair; an empty table no rows.
    """
    spark = docs.sparkSession
    d = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    names = cut_lineage(d.select("lang", "source").distinct())
    most = names.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    folder = scratch(spark, "divergence")
    tallies(collapsed(d, -(-most // list_sources))).write.parquet(f"{folder}/tallies")
    held = spark.read.parquet(f"{folder}/tallies")
    kept = settle(held.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term"), row_bytes=128)
    counts = cut_lineage(held.drop("docs").join(kept, ["lang", "term"]))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    stats = names.join(terms, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["terms", "total"])
    base = F.when(F.col("terms") > 0, share("0", "total", "terms")).otherwise(F.lit(0).cast("bigint"))
    groups = cut_lineage(stats.withColumn("base", base))
    own = cut_lineage(counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", share("n", "total", "terms").alias("p")))

    chunks = max(1, -(-kept.count() // chunk_terms))
    pairs = pair_sums(own, groups, chunks, block)
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(by))

    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    lang_total = totals.groupBy("lang").agg(F.sum("total").alias("total_lang"))
    q = whole.join(settle(lang_total.join(terms, "lang")), "lang").select("lang", "term", share("n_lang", "total_lang", "terms").alias("q"))
    above = own.join(q, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pair.unionByName(above.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top))
