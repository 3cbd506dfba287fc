"""Token-id files in Simple-8b words.

Documents are range-partitioned by id; each partition becomes a shard. A row of a shard holds
whole documents: their ids and token counts, the packed words, the word where each block of
ids starts, and the shard's tokens before it. Spark's own writer commits the shards, so a lost
executor's attempt leaves nothing behind. A document starts where its shard starts (a running
sum over one row per shard) plus the tokens before it in the shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from memlake.llm.common import digest_pair
from memlake.llm.simple8b import pack, unpack_blocks
from memlake.llm.subwords import parcels, subwords
from memlake.session import checkpoint_dir

SHARD = "shard int, doc_ids array<bigint>, counts array<bigint>, before bigint, n_ids bigint, words binary, firsts binary"
ROW = pa.schema([("shard", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("before", pa.int64()), ("n_ids", pa.int64()), ("words", pa.binary()), ("firsts", pa.binary())])


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def append_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts in a row with ``end_id`` after each, and the new counts."""
    return np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32), counts + 1


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Write ids of all texts (null: empty), each with ``end_id`` after it, in ascending doc_id
    order (null ids first, equal ids by text). An empty table writes no rows."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint"), text.alias("text"), digest_pair(text).alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        encoder = subwords(vocabulary)
        for b in batches:
            doc_ids, texts = b.column(0), b.column(1).to_pylist()
            for i, j in parcels(texts):
                ids, counts = append_end(*encoder.encode(texts[i:j]), end_id)
                words, firsts = pack(ids)
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard], pa.int32()), pa.array([doc_ids[i:j].to_pylist()], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                    pa.array([before]), pa.array([len(ids)]), pa.array([words.tobytes()], pa.binary()), pa.array([firsts.tobytes()], pa.binary())], schema=ROW)
                before += len(ids)

    rows.mapInArrow(work, SHARD).write.mode("error").parquet(path)


def read_tokens(spark: SparkSession, path: str, work, schema: str) -> DataFrame:
    """Apply ``work(doc_id, place in shard, ids)`` -> tuple to every document of a written
    folder; ``schema`` names the fields. ``shard_start`` is added for each row."""
    shards = spark.read.schema(SHARD).parquet(path)
    totals = shards.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row per shard
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    index = totals.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_start"))
    schema = "shard int, " + schema
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = unpack_blocks(np.frombuffer(r["words"], np.uint64), np.frombuffer(r["firsts"], np.uint32), r["n_ids"])
                at, rows = 0, []
                for doc_id, n in zip(r["doc_ids"], r["counts"]):
                    rows.append((r["shard"], *work(doc_id, r["before"] + at, ids[at:at + n])))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return shards.mapInArrow(decode, schema).join(F.broadcast(index), "shard")


def token_report(docs: DataFrame, vocabulary: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the files and read them back: doc_id, start, n_tokens, ids_crc32 per document."""
    spark = docs.sparkSession
    path = path or scratch(spark, "token-files")
    write_tokens(docs, path, vocabulary, end_id)
    own = lambda doc_id, place, ids: (doc_id, place, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
    back = read_tokens(spark, path, own, "doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint")
    return back.select("doc_id", (F.col("shard_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
