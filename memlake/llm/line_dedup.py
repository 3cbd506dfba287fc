"""Line dedup by site-relative frequency.

A line is boilerplate of its host when the pages of that host that hold it, divided by all
pages of the host, exceed a ratio. Copies of one page text count as one page, so a group of
copies doesn't turn its own content into boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memlake.llm.common import digest_pair
from memlake.session import settle

RATIO, MIN_PAGES = 0.05, 5


def line_key(line: Column) -> Column:
    """A line without spaces, tabs and carriage returns at its ends."""
    return F.trim(line, F.lit(" \t\r"))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate(docs: DataFrame, host: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, drop) with the digests of the host's boilerplate lines.

    A list holds at most 1/ratio times the host's mean number of lines. Rows are summed in the
    map tasks, so neither a hot host nor a hot line meets whole in one task.
    """
    keys = F.filter(F.transform(lines(F.col("text")), line_key), lambda x: x != "")
    own = F.array_distinct(F.transform(keys, digest_pair))
    pages = docs.select(F.coalesce(F.col(host), F.lit("")).alias("host"), digest_pair(F.coalesce("text", F.lit(""))).alias("page"), own.alias("own"))
    # The copies of a page meet per (host, page) after map-side combining.
    pages = pages.groupBy("host", "page").agg(F.first("own").alias("own"))
    held = pages.select("host", F.explode("own").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    total = docs.groupBy(F.coalesce(F.col(host), F.lit("")).alias("host")).agg(F.count_distinct(digest_pair(F.coalesce("text", F.lit("")))).alias("total"))
    return held.join(total, "host").where(F.col("n") > ratio * F.col("total")).groupBy("host").agg(F.collect_list("line").alias("drop"))


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with its text less the boilerplate lines, and __n_lines and __n_dropped.

    Lines end at a newline. Lines that are blank at both ends count for nothing and stay. A
    null text stays null with no lines; a null host counts as the empty one. Rows and other
    columns stay as they are. Lines compare by 128 bits of hash.
    """
    found = settle(boilerplate(docs, host, ratio, min_pages), row_bytes=4096).withColumnRenamed("host", "__host").withColumnRenamed("drop", "__drop")
    j = docs.join(found, F.coalesce(F.col(host), F.lit("")) == F.col("__host"), "left")
    all_lines = lines(F.col("text"))
    keep = F.filter(all_lines, lambda x: ~F.coalesce(F.array_contains(F.col("__drop"), digest_pair(line_key(x))), F.lit(False)))
    hit = F.col("__drop").isNotNull() & F.col("text").isNotNull()
    j = j.withColumn("__keep", F.when(hit, keep))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(all_lines))
    j = j.withColumn("__n_lines", n).withColumn("__n_dropped", F.when(hit, n - F.size("__keep")).otherwise(F.lit(0)))
    cleaned = F.when(F.col("__n_dropped") > 0, F.array_join("__keep", "\n")).otherwise(F.col("text"))
    return j.select(*[cleaned.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], "__n_lines", "__n_dropped")
