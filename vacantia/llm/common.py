"""Helpers that the operators share: work folders, tables, size checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder

#: A side is broadcast only if it has been counted and has no more rows.
BROADCAST_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path may be in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def refuse(columns: list[str], *names: str) -> None:
    """Raises if one of the columns has a name that a result is given."""
    clash = {c.lower() for c in columns} & set(names)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")


def tune_arrow(spark: SparkSession, most: int = 16 << 20) -> None:
    """Small Arrow batches (of `most` bytes), so that very long texts cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def stored(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost
    executor costs no more than the tasks that read it."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    (df if parts is None else df.coalesce(parts)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if a count shows that it has at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
