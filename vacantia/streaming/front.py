"""A streaming front for postings: micro-batches are merged into a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import store


def latest(batch: DataFrame, key: list[str], at: str) -> DataFrame:
    """The last row of each key in a batch."""
    others = [c for c in batch.columns if c not in key]
    last = batch.groupBy(*key).agg(F.max_by(F.struct(*others), F.col(at)).alias("_r"))
    return last.select(*key, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*batch.columns)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: list[str], at: str, **options) -> StreamingQuery:
    """Merge every micro-batch into the bucketed table below path, as the version of its number.

    Only the buckets that a batch touches are rewritten; a batch that is run again makes the
    same version, and readers see whole versions only (store.read)."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        store.merge(spark, path, latest(batch, key, at), key, number, **options)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows of each kind per window of time; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
