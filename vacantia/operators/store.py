"""Tables that grow by small batches: merges that rewrite only what they touch, runs that
pick up where they stopped, and batched backfills.

Rows lie in folders by a hash of their key. A version is a small table that says which
version of the data holds each bucket; it is written last, so readers see whole versions
only, and a merge that is run again overwrites its own version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lifecycle import upsert

BUCKETS = 64


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.hash(*key), F.lit(buckets)).cast("int")


def dealt(df: DataFrame, key: list[str], buckets: int = BUCKETS) -> DataFrame:
    """df dealt out by key to a multiple of `buckets` tasks, as many as the session shuffles to at least.

    A bucket is the same hash by which Spark deals rows out, so each task holds rows of one bucket: what is
    joined by key in this form is written with no other shuffle, in a few files a bucket."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(-(-n // buckets) * buckets, *key)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[int, int]:
    """Which version of the data holds each bucket (as many rows as buckets); the newest if none is named."""
    try:
        m = spark.read.parquet(f"{path}/manifest")
    except AnalysisException:  # nothing there yet
        return {}
    if version is None:
        version = m.agg(F.max("version")).first()[0]
    return {r["bucket"]: r["data"] for r in m.filter((F.col("version") == version) & (F.col("bucket") >= 0)).select("bucket", "data").collect()}


def newest(spark: SparkSession, path: str) -> int:
    """The number of the newest version, -1 if there is none."""
    try:
        return spark.read.parquet(f"{path}/manifest").agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0]
    except AnalysisException:
        return -1


def read(spark: SparkSession, path: str, version: int | None = None, only: list[int] | None = None) -> DataFrame | None:
    """The table as of a version; with `only`, of those buckets. None if nothing is there."""
    found = manifest(spark, path, version)
    paths = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(found.items()) if only is None or b in only]
    return spark.read.parquet(*paths) if paths else None


def _write(rows: DataFrame, path: str, key: list[str], version: int, buckets: int, before: dict[int, int]) -> None:
    """rows, dealt, as the next version."""
    spark = rows.sparkSession
    data = f"{path}/data/version={version}"
    rows.withColumn("bucket", _bucket(key, buckets)).write.mode("overwrite").partitionBy("bucket").parquet(data)
    # The schema is given, since a version without rows has no file to take it from.
    made = {r["bucket"] for r in spark.read.schema("bucket int").parquet(data).distinct().collect()}
    now = before | {b: version for b in made}
    # A version without buckets has one row that says so.
    spark.createDataFrame(sorted(now.items()) or [(-1, -1)], "bucket int, data int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")


def merge(spark: SparkSession, path: str, batch: DataFrame, key: list[str], version: int | None = None, buckets: int = BUCKETS, derive: dict[str, Column] | None = None, **options) -> set[int]:
    """Upsert batch (one row a key) into the table below path as its next version; the buckets it touched.

    Only those are read and written: the others keep their files. options are upsert's; derive
    has columns that every merged row gets anew, so that a predicate stays current. Version n is
    made from version n - 1 whatever else is there, so a batch may be run again."""
    version = newest(spark, path) + 1 if version is None else version
    before = manifest(spark, path, version - 1) if version else {}
    touched = {r[0] for r in batch.select(_bucket(key, buckets).alias("b")).distinct().collect()}
    old = read(spark, path, version - 1, sorted(touched)) if before else None
    batch = dealt(batch, key, buckets)
    out = batch if old is None else upsert(dealt(old, key, buckets), batch, key, **options)
    out = out.withColumns(derive) if derive else out
    _write(out, path, key, version, buckets, before)
    return touched


def delete(spark: SparkSession, path: str, keys: DataFrame, key: list[str], buckets: int = BUCKETS) -> set[int]:
    """The table without the rows of these keys, as its next version; the buckets it touched.

    Only buckets that may hold such a row are read and written; one that is left empty goes."""
    before = manifest(spark, path)
    touched = {r[0] for r in keys.select(_bucket(key, buckets).alias("b")).distinct().collect()} & set(before)
    if touched:
        left = dealt(read(spark, path, only=sorted(touched)), key, buckets).join(dealt(keys.select(*key), key, buckets), key, "left_anti")
        _write(left, path, key, newest(spark, path) + 1, buckets, {b: v for b, v in before.items() if b not in touched})
    return touched


def backfill(spark: SparkSession, path: str, key: str, column: str, value: Column, span: int, batches: int | None = None, buckets: int = BUCKETS) -> int:
    """Bring column up to value, by ranges of `span` keys behind a stored watermark; how many ranges were done.

    A range rewrites the buckets of those rows only that change. The watermark is written after
    the merge, so a range that was cut off is done again, and rewrites nothing if it was done."""
    done, whole = 0, read(spark, path)
    if whole is None:
        return 0
    ends = whole.agg(F.min(key), F.max(key)).first()
    try:
        at = spark.read.parquet(f"{path}/watermark").agg(F.max("upto")).first()[0]
    except AnalysisException:
        at = ends[0] - 1 if ends[0] is not None else None
    while at is not None and at < ends[1] and (batches is None or done < batches):
        rows = read(spark, path).filter((F.col(key) > at) & (F.col(key) <= at + span))
        changed = rows.withColumn("_now", value).filter(~F.col("_now").eqNullSafe(F.col(column))).drop("_now").withColumn(column, value)
        if not changed.isEmpty():
            merge(spark, path, changed, [key], buckets=buckets)
        at, done = at + span, done + 1
        spark.createDataFrame([(at,)], "upto long").coalesce(1).write.mode("append").parquet(f"{path}/watermark")
    return done


def run_units(units: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], at_once: int = 16, most: int | None = None) -> DataFrame:
    """The rows of compute for every unit, each made once however often the run stops.

    units has unit (a string that can name a folder, a stated list) and what compute needs; compute
    returns rows with unit. Units are done `at_once` at a time, in order of name: their folders are
    overwritten, then their names are logged. What is not in the log is done again, and rows of units
    that are not in it are not read. most stops the run after so many units."""
    spark = units.sparkSession
    try:
        log = spark.read.parquet(f"{path}/done").select("unit").distinct()
        left = units.join(log, "unit", "left_anti")
    except AnalysisException:
        left = units
    names = [r[0] for r in left.select("unit").orderBy("unit").collect()][:most]
    for i in range(0, len(names), at_once):
        now = names[i : i + at_once]
        rows = compute(units.filter(F.col("unit").isin(now)))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("unit").parquet(f"{path}/rows")
        spark.createDataFrame([(n,) for n in now], "unit string").coalesce(1).write.mode("append").parquet(f"{path}/done")
    return finished_units(spark, path)


def finished_units(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the units that the log calls done."""
    log = [r[0] for r in spark.read.parquet(f"{path}/done").select("unit").distinct().collect()]  # a stated list
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.withColumn("unit", F.col("unit").cast("string")).filter(F.col("unit").isin(log))
