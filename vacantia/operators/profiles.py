"""Stored features of texts: saved, loaded and deleted by key, and made again only where they are stale.

A profile is stale if the hash of its text, the version of what makes it or the name of
the encoder is not what it should be. The table is merged by bucket (operators.store), so
a refresh costs what has changed, not what is stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from . import store

#: What the store adds to a profile.
STAMPS = ("text_sha256", "profile_version", "model_name", "created_at", "updated_at")


def text_hash(text: Column) -> Column:
    """What tells a profile's text; null is like empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def is_current(sha: Column, version: str, model: str, prefix: str = "") -> Column:
    """Whether a stored profile was made of this text, by this version, with this encoder; never null.
    prefix: what the names of the stored columns begin with."""
    at = lambda c: F.col(prefix + c)
    same = at("text_sha256").eqNullSafe(sha) & at("profile_version").eqNullSafe(F.lit(version)) & at("model_name").eqNullSafe(F.lit(model))
    return F.coalesce(same, F.lit(False))


def save(spark: SparkSession, path: str, made: DataFrame, key: str, version: str, model: str, now: Column, buckets: int = store.BUCKETS) -> set[int]:
    """Profiles (with key and text_sha256, one row a key) into the table: new ones win, created_at stays."""
    stamped = made.withColumns({"profile_version": F.lit(version), "model_name": F.lit(model), "created_at": now, "updated_at": now})
    return store.merge(spark, path, stamped, [key], buckets=buckets, keep=["created_at"])


def load(spark: SparkSession, path: str, keys: DataFrame | None = None, key: str = "id") -> DataFrame | None:
    """The profiles of the keys (all if none are given); None if nothing was ever saved."""
    have = store.read(spark, path)
    return have if have is None or keys is None else have.join(keys.select(key).distinct(), key, "left_semi")


def delete(spark: SparkSession, path: str, keys: DataFrame, key: str, buckets: int = store.BUCKETS) -> set[int]:
    """Forget the profiles of these keys; the buckets that were rewritten."""
    return store.delete(spark, path, keys, [key], buckets=buckets)


def refreshed(
    spark: SparkSession,
    path: str,
    texts: DataFrame,
    key: str,
    text: str,
    make: Callable[[DataFrame], DataFrame],
    version: str,
    model: str,
    now: Column,
    buckets: int = store.BUCKETS,
) -> DataFrame:
    """The profiles of texts (key and text, one row a key), stale and missing ones made anew and saved.

    make is given the rows of those texts alone and returns one row a key. Profiles of other keys stay."""
    texts = texts.select(key, text)
    want = texts.select(key, text_hash(F.col(text)).alias("text_sha256"))
    have = load(spark, path)
    if have is None:
        stale, todo = want, texts
    else:
        # Hashes alone meet the stored ones; texts meet the keys that came out stale.
        was = have.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in STAMPS[:3]])
        current = is_current(F.col("text_sha256"), version, model, "_")
        stale = stored(want.join(was, F.col(key) == F.col("_key"), "left").filter(~current).select(*want.columns), "stale-profiles")
        todo = texts.join(stale.select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left_semi")
    if not stale.isEmpty():
        # Stored before the join, so that profiles are shuffled once, on their way to their buckets.
        made = stored(make(todo), "made-profiles")
        made = store.dealt(made, [key], buckets).join(store.dealt(stale, [key], buckets), key)
        save(spark, path, made, key, version, model, now, buckets)
    return load(spark, path, texts, key)
