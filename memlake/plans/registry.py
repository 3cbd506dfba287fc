"""Query registration: one Spark function and, where SQL can state it, one oracle string."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memlake.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Attribute access to the given tables and the adaptor views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def values(self, columns: str, *rows: str) -> DataFrame:
        """A literal rule or mapping table; Catalyst knows its size."""
        return self.spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS v({columns})")

    def __getattr__(self, name: str) -> DataFrame:
        return fixtures.load(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name`` with its oracle."""

    def wrap(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return wrap


def oracle(body: str) -> str:
    """Prepend the adaptor views the body names."""
    ctes = fixtures.duckdb_ctes(body)
    body = body.strip()
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    own = body[m.end():] if m else None
    if not ctes:
        return f"WITH RECURSIVE {own}" if own else body
    return f"WITH RECURSIVE {ctes}" + (f",\n{own}" if own else f"\n{body}")
