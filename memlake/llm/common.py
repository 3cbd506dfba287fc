"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space and A-Z, as the contracts state them.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def digest_pair(value: Column) -> Column:
    """128 bits of two chained 64-bit hashes, as a struct of longs."""
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit("second"), value).alias("b"))


def slim(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator reads, so others cannot clash with its own."""
    return docs.select(*columns)
