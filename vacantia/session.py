"""A session with the settings the engine expects."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "vacantia", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, Arrow for Python operators.

    Shuffle partitions are left to the cluster's own setting: AQE coalesces them."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return b.config(map=settings | conf).getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or our own beside the warehouse if unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    home = spark.conf.get("spark.sql.warehouse.dir")
    if (home.startswith("file:") or "://" not in home) and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: the warehouse is on a local disk")
    return f"{home.rstrip('/')}/vacantia_work"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, so a lost
    executor costs no more than the tasks that read it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys to as many tasks as the session shuffles to, at least two a core: for rows that cost
    much more to compute than to read, since a small file of many rows is one task else."""
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df, marked for broadcast if a count shows that it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
