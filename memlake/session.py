"""Session settings and the few run-time decisions that depend on the cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_LIMIT_BYTES = 16 * 1024 * 1024


def build_session(app: str = "memlake", cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """Local session for tests and benches. On a cluster the submitter's settings rule."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.local.dir", os.environ.get("SPARK_LOCAL_DIRS") or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


#: Scratch folders made here, by application.
_SCRATCH: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. A local master without one
    gets a scratch folder, the same for the whole application and removed when it ends; on a
    cluster that is an error, since executors do not share the driver's disk."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if sc.applicationId not in _SCRATCH:
            _SCRATCH[sc.applicationId] = folder = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = _SCRATCH[sc.applicationId]
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def plan_size(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan, in bytes; unbounded when unknown."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:  # a remote session exposes no plan
        return 1 << 62


def settle(df: DataFrame, row_bytes: int = 64, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Write a table read several times once, count it, and hint a broadcast when the count
    says it fits. For tables whose size Catalyst cannot estimate."""
    held = cut_lineage(df)
    return F.broadcast(held) if held.count() * row_bytes <= limit else held


def unsent(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast, which the driver would have to hold, also not by AQE
    on a size that it has measured."""
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only when the estimated size is under the limit; else leave the
    choice between sort-merge and shuffled hash to Catalyst and AQE."""
    return F.broadcast(df) if plan_size(df) <= limit else df
