"""Matching operators around models that are passed in: pair scorers, forests, screens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_windows
from .ordered import with_pool_shares

Scorer = Callable[[list[tuple[str, str]]], list[float]]


def overlap_scorer(pairs: list[tuple[str, str]]) -> list[float]:
    """A deterministic stand-in for a pair model: shared words over all words."""
    out = []
    for a, b in pairs:
        x, y = set(a.lower().split()), set(b.lower().split())
        out.append(len(x & y) / len(x | y) if x | y else 0.0)
    return out


def chunk_pairs(df: DataFrame, key: list[str], a: str, b: str, size: int, overlap: int) -> DataFrame:
    """Every pair of a row's own chunks: bounded by the two texts of that row."""
    left = df.select(*key, F.posexplode(word_windows(F.col(a), size, overlap)).alias("i", "chunk_a"), F.col(b).alias("_b"))
    return left.select(*key, "i", "chunk_a", F.posexplode(word_windows(F.col("_b"), size, overlap)).alias("j", "chunk_b"))


def pair_scores(pairs: DataFrame, scorer: Scorer = overlap_scorer, a: str = "chunk_a", b: str = "chunk_b") -> DataFrame:
    """pairs with score, one call of the model per Arrow batch."""
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series(scorer(list(zip(x, y, strict=True))), dtype="float64")

    return pairs.withColumn("score", run(F.col(a), F.col(b)))


def chunk_aggregate(scored: DataFrame, key: list[str], top: int = 2) -> DataFrame:
    """max, mean and mean of the best `top` scores of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc("score"), "i", "j")
    s = scored.withColumn("_k", F.row_number().over(w))
    return s.groupBy(*key).agg(F.max("score").alias("max_score"), F.avg("score").alias("mean_score"), F.avg(F.when(F.col("_k") <= top, F.col("score"))).alias("top_mean_score"), F.count("*").alias("pairs"))


def filled_scores(candidates: DataFrame, known: DataFrame, scorer: Scorer = overlap_scorer) -> DataFrame:
    """candidates (query_id, job_id, a, b) with known scores, and the model's for those without; ranked."""
    k = known.select("query_id", "job_id", F.col("score").alias("_s"))
    both = candidates.join(k, ["query_id", "job_id"], "left")
    missing = pair_scores(both.filter("_s IS NULL"), scorer, "a", "b").select("query_id", "job_id", "score")
    out = both.filter("_s IS NOT NULL").select("query_id", "job_id", F.col("_s").alias("score")).unionByName(missing)
    return out.withColumn("rank", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"))).cast("long"))


def coverage(distances: DataFrame, reference: Column, by: list[str], flag: float = 10.0, bad: float = 90.0) -> DataFrame:
    """Per key of by: phrases, flagged and bad shares, mean percentile and distance.

    distances: by, d and whether a row is of the reference pool. The percentile of a
    phrase is the share of the pool at its distance or nearer."""
    p = with_pool_shares(distances, "d", reference)
    share = lambda c: 100.0 * F.count_if(c) / F.count("*")
    return p.groupBy(*by).agg(F.count("*").alias("phrases"), share(F.col("pct") <= flag).alias("percent_flagged"), share(F.col("pct") >= bad).alias("bad_match_percent"), F.avg("pct").alias("mean_percentile"), F.avg("d").alias("mean_distance"))


def of_newest(rows: DataFrame, job: str, at: Column, n: int) -> DataFrame:
    """rows with in_pool: whether their job is among the n newest (no more than n ids are broadcast)."""
    newest = rows.select(F.col(job).alias("_job"), at.alias("_at")).groupBy("_job").agg(F.max("_at").alias("_at"))
    newest = newest.orderBy(F.desc_nulls_last("_at"), F.desc("_job")).limit(n)
    out = rows.join(F.broadcast(newest.select("_job", F.lit(True).alias("_in"))), F.col(job) == F.col("_job"), "left")
    return out.withColumn("in_pool", F.coalesce("_in", F.lit(False))).drop("_job", "_in")


def strongest(phrases: DataFrame, by: list[str], n: int = 5) -> DataFrame:
    """The n phrases of each key with the least percentile, then distance."""
    w = Window.partitionBy(*by).orderBy("pct", "d", "phrase_no")
    return phrases.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= n)


def pair_features(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the derived features of a pair classifier.

    columns: which column holds word_distance, phrase_distance, requirements_distance,
    seniority_abs_gap, technology_overlap, percent_flagged and bad_match_percent.
    NaN, infinite and null inputs are missing; a feature is null if what it needs is."""

    def value(name: str) -> Column:
        v = F.col(columns[name]).cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)

    word, phrase, needs, gap, tech, flagged, bad = (value(n) for n in ("word_distance", "phrase_distance", "requirements_distance", "seniority_abs_gap", "technology_overlap", "percent_flagged", "bad_match_percent"))
    there = lambda *v: F.array_compact(F.array(*v))
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))
    geomean = F.sqrt(F.greatest(word, F.lit(0.0)) * F.greatest(phrase, F.lit(0.0)))
    geomean = F.when(word.isNotNull() & phrase.isNotNull(), geomean)
    return df.withColumns(
        {
            "semantic_distance_geomean": geomean,
            "semantic_distance_ratio_log": F.when((word + 1e-9 > 0) & (phrase + 1e-9 > 0), F.log((word + 1e-9) / (phrase + 1e-9))),
            "semantic_requirements_mean": mean(there(word, phrase, needs)),
            "semantic_requirements_max": F.array_max(there(word, phrase, needs)),
            "seniority_fit_exp": F.when(gap.isNotNull(), F.exp(-F.greatest(gap, F.lit(0.0)))),
            "technology_x_semantic_similarity": tech * F.exp(-geomean),
            "requirements_x_seniority_badness": needs * (1.0 + gap),
            "coverage_badness_mean": mean(there(flagged, bad)),
        }
    )


def entropy(distribution: Column) -> Column:
    """Of an array of probabilities, in nats; null for an empty one."""
    return F.when(F.size(distribution) > 0, -F.aggregate(distribution, F.lit(0.0), lambda s, p: s + p * F.log(F.greatest(p, F.lit(1e-12)))))


def screened(df: DataFrame, probability: Column, threshold: float) -> DataFrame:
    """Rows whose probability of a bad match is below the threshold; unknown ones pass: the filter fails open."""
    return df.filter(F.coalesce(probability < threshold, F.lit(True)))


def contained(step: Callable[[DataFrame], DataFrame], df: DataFrame, operation: str) -> tuple[DataFrame, str]:
    """step(df) and 'ok'; or df as it was and 'failed', if the step's plan or its rows raise.

    Spark is lazy, so the step is run once to see."""
    try:
        out = step(df)
        out.write.format("noop").mode("overwrite").save()
    except Exception as e:  # noqa: BLE001 - any failure of one operation must not end the ranking
        return df, f"failed: {operation}: {type(e).__name__}"
    return out, "ok"
