"""The ranking algebra: long tables of (query_id, operation, job_id, rank), policies
that cut them down, and rank fusion. Everything is partitioned by query_id, so many
queries rank at once and no operator needs a global order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import small, stored
from .ordered import numbered, running

#: Operations that filter rather than rank take no part in fusion (fixed values).
FILTERS = ("llm_bad_match_filter", "mahalanobis_outlier", "multi_metric_bad_fit_filter", "pair_independent_bad_match_forest", "seniority_filter", "technology_mismatch_filter")
RRF_K = 60


def ranked(df: DataFrame, score: Column, by: list[str], ascending: bool = True) -> DataFrame:
    """df with its competition rank (1, 1, 3) by score."""
    w = Window.partitionBy(*by).orderBy(score.asc() if ascending else score.desc())
    return df.withColumn("rank", F.rank().over(w).cast("long"))


def dense_ranks(results: DataFrame, remaining: DataFrame) -> DataFrame:
    """Usable ranks of remaining jobs, made dense within each query and operation."""
    r = results.filter((F.col("status") == "ok") & ~F.col("operation").isin(*FILTERS) & F.col("rank").isNotNull() & ~F.isnan(F.col("rank").cast("double")) & (F.abs(F.col("rank").cast("double")) < F.lit(float("inf"))))
    r = r.join(remaining.select("query_id", "job_id").distinct(), ["query_id", "job_id"], "left_semi")
    w = Window.partitionBy("query_id", "operation").orderBy("rank")
    return r.withColumn("dense", F.dense_rank().over(w).cast("long"))


def fused(results: DataFrame, remaining: DataFrame, mode: str = "minimax") -> DataFrame:
    """remaining (query_id, job_id) with final_rank.

    minimax compares each job's ranks from worst to best; rrf sums 1 / (60 + rank)
    first. Jobs without ranks come last; ties go to the smaller id."""
    if mode not in ("minimax", "rrf"):
        raise ValueError(f"unknown mode {mode}")
    per = dense_ranks(results, remaining).groupBy("query_id", "job_id").agg(F.reverse(F.array_sort(F.collect_list("dense"))).alias("worst"), F.sum(1.0 / (RRF_K + F.col("dense"))).alias("rrf"))
    out = remaining.select("query_id", "job_id").distinct().join(per, ["query_id", "job_id"], "left")
    keys = [F.col("worst").isNull().asc(), F.col("worst").asc(), F.col("job_id").asc()]
    if mode == "rrf":
        keys.insert(1, F.round("rrf", 12).desc_nulls_last())
    return out.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*keys)).cast("long"))


@dataclass(frozen=True)
class Policy:
    """How far an operation cuts the list down; None leaves that way out."""

    top_n: int | None = None
    top_fraction: float | None = None
    keep_score: float | None = None
    least: int = 0


def kept_count(total: Column, policy: Policy) -> Column:
    """min(total, top_n, max(1, floor(total * fraction)))."""
    parts = [total]
    if policy.top_n is not None:
        parts.append(F.lit(policy.top_n).cast("long"))
    if policy.top_fraction is not None:
        parts.append(F.greatest(F.lit(1).cast("long"), F.floor(F.round(total * F.lit(policy.top_fraction), 9)).cast("long")))
    return F.least(*parts) if len(parts) > 1 else parts[0]


def reduced(df: DataFrame, order: list[Column], policy: Policy, score: str = "score", by: str = "query_id") -> DataFrame:
    """Rows that a policy keeps of each query, ranked by order; never fewer than `least`
    of those there are: the refill follows the same order."""
    w = Window.partitionBy(by)
    d = df.withColumns({"_n": F.count("*").over(w), "_pos": F.row_number().over(w.orderBy(*order))})
    if policy.keep_score is not None:
        keep = F.col(score) == policy.keep_score
    else:
        keep = F.col("_pos") <= kept_count(F.col("_n"), policy)
    d = d.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    d = d.withColumn("_again", F.row_number().over(w.orderBy(F.desc("_keep"), "_pos"))).withColumn("_kept", F.count_if("_keep").over(w))
    return d.filter(F.col("_again") <= F.greatest(F.col("_kept"), F.lit(policy.least))).drop("_n", "_pos", "_keep", "_again", "_kept")


def by_operation(candidates: DataFrame, results: DataFrame, operation: str, by: str = "query_id") -> DataFrame:
    """candidates (by, job_id) in the order that one operation's results give, as `place`. Where it ranked
    none of a query's, or failed, all of them stay in the order of their ids, and ordered_by is null."""
    r = results.filter((F.col("operation") == operation) & (F.col("status") == "ok") & F.col("rank").isNotNull()).select(F.col(by).alias("_q"), F.col("job_id").alias("_j"), "rank")
    d = candidates.join(r, (F.col(by) == F.col("_q")) & (F.col("job_id") == F.col("_j")), "left").drop("_q", "_j")
    w = Window.partitionBy(by)
    d = d.withColumn("_any", F.count("rank").over(w) > 0).filter(~F.col("_any") | F.col("rank").isNotNull())
    d = d.withColumn("place", F.row_number().over(w.orderBy(F.asc_nulls_last("rank"), "job_id")).cast("long"))
    return d.withColumn("ordered_by", F.when(F.col("_any"), F.lit(operation))).drop("_any", "rank")


def by_coverage(candidates: DataFrame, percent: Column, by: str = "query_id") -> DataFrame:
    """candidates in the order of coverage, the largest first (null is 0), then of ids, as `place`."""
    w = Window.partitionBy(by).orderBy(F.coalesce(percent, F.lit(0.0)).desc(), "job_id")
    return candidates.withColumn("place", F.row_number().over(w).cast("long"))


def best_clusters(df: DataFrame, fraction: float, by: str = "query_id") -> DataFrame:
    """Rows of the best max(1, floor(n * fraction)) clusters, by their least rank; noise (-1) goes."""
    d = df.filter(F.col("cluster") >= 0)
    c = d.groupBy(by, "cluster").agg(F.min("rank").alias("_best"))
    w = Window.partitionBy(by)
    c = c.withColumns({"_n": F.count("*").over(w), "_pos": F.row_number().over(w.orderBy("_best", "cluster"))})
    c = c.filter(F.col("_pos") <= F.greatest(F.lit(1), F.floor(F.col("_n") * fraction))).select(by, "cluster")
    return d.join(c, [by, "cluster"], "left_semi")


def coverage_cut(df: DataFrame, bottom: float, top: float, least: int, by: str = "query_id") -> DataFrame:
    """Without the bottom share by percent_flagged and the top share by bad_match_percent,
    refilled up to `least` by coverage."""
    w = Window.partitionBy(by)
    n = F.count("*").over(w)
    cut = lambda f: F.greatest(F.lit(1), F.floor(n * f)) if f > 0 else F.lit(0)
    d = df.withColumns({"_low": F.row_number().over(w.orderBy("percent_flagged", "job_id")), "_bad": F.row_number().over(w.orderBy(F.desc("bad_match_percent"), "job_id"))})
    d = d.withColumn("_keep", (F.col("_low") > cut(bottom)) & (F.col("_bad") > cut(top)))
    d = d.withColumn("_again", F.row_number().over(w.orderBy(F.desc("_keep"), F.desc("percent_flagged"), "job_id"))).withColumn("_kept", F.count_if("_keep").over(w))
    return d.filter(F.col("_again") <= F.greatest(F.col("_kept"), F.lit(least))).drop("_low", "_bad", "_keep", "_again", "_kept")


def bad_fit(metrics: DataFrame, directions: dict[str, int], fraction: float = 0.25, flags: int = 2, by: str = "query_id") -> DataFrame:
    """query_id, job_id, flag_count and is_bad: in the worst share of how many metrics.

    metrics: query_id, job_id (each once) and one column a metric; direction 1: more is better.
    Null metrics are not counted. Values are counted and summed by ranges, so no task sees a query's whole list."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(m) * F.lit(d)).cast("double").alias("goodness")) for m, d in directions.items()]))
    known = metrics.select(by, "job_id", pairs.alias("m")).select(by, "job_id", "m.*").filter("goodness IS NOT NULL AND NOT isnan(goodness)")
    long = stored(known, "bad-fit")  # read by the counts and by their values
    # The last place of the worst share falls on a value: below it all are in, at it the first by id are.
    per = running(long.groupBy(by, "metric", "goodness").agg(F.count("*").alias("_n")), "goodness", F.col("_n"), [by, "metric"])
    most = F.greatest(F.lit(1), F.floor(F.col("total") * fraction)).cast("long")
    ends = stored(per.filter((F.col("upto") >= most) & (F.col("upto") - F.col("_n") < most)).select(F.col(by).alias("_q"), F.col("metric").alias("_m"), F.col("goodness").alias("_at"), (most - F.col("upto") + F.col("_n")).alias("_left")), "bad-fit-ends")
    ends = small(ends)  # one row a query and metric
    same = F.col(by).eqNullSafe(F.col("_q")) & (F.col("metric") == F.col("_m"))
    d = long.join(ends, same)
    ties = numbered(d.filter(F.col("goodness") == F.col("_at")).select(by, "job_id", "metric", "_left"), "job_id", [by, "metric"])
    flag = d.select(by, "job_id", (F.col("goodness") < F.col("_at")).cast("long").alias("_flag")).unionByName(ties.select(by, "job_id", (F.col("place") < F.col("_left")).cast("long").alias("_flag")))
    out = flag.groupBy(by, "job_id").agg(F.sum("_flag").alias("flag_count"))
    return out.withColumn("is_bad", F.col("flag_count") >= flags)


def _filled(df: DataFrame, names: list[str], by: str) -> DataFrame:
    """Oriented metrics with the query's mean for missing ones, as z-scores by the population's deviation."""
    w = Window.partitionBy(by)
    d = df.withColumns({f"_f_{m}": F.coalesce(F.col(m), F.avg(m).over(w)) for m in names})
    return d.withColumns({f"_z_{m}": F.coalesce((F.col(f"_f_{m}") - F.avg(f"_f_{m}").over(w)) / F.nullif(F.stddev_pop(f"_f_{m}").over(w), F.lit(0.0)), F.lit(0.0)) for m in names})


def good_direction(df: DataFrame, directions: dict[str, int], by: str = "query_id") -> DataFrame:
    """The mean oriented z-score of each job."""
    d = _filled(df, list(directions), by)
    total = sum((F.col(f"_z_{m}") * F.lit(float(s)) for m, s in directions.items()), F.lit(0.0))
    return d.select(by, "job_id", (total / len(directions)).alias("score"))


def mahalanobis(df: DataFrame, directions: dict[str, int], by: str = "query_id") -> DataFrame:
    """The Mahalanobis distance of each job's z-scores, by the pseudo-inverse of their
    sample covariance. Covariances are a few sums a query; the pseudo-inverse of the
    small matrix is taken in numpy, once a query, over aggregated rows."""
    import numpy as np
    import pandas as pd

    names = list(directions)
    d = _filled(df, names, by)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    cov = d.groupBy(by).agg(*[F.covar_samp(f"_z_{names[i]}", f"_z_{names[j]}").alias(f"c_{i}_{j}") for i, j in pairs])

    def inverted(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                m = np.zeros((len(names), len(names)))
                for (i, j), v in zip(pairs, r[1:], strict=True):
                    m[i, j] = m[j, i] = 0.0 if v is None or v != v else v
                p = np.linalg.pinv(m)
                rows.append((r[0], *(p[i, j] for i, j in pairs)))
            yield pd.DataFrame(rows, columns=[by, *(f"p_{i}_{j}" for i, j in pairs)])

    kind = dict(df.dtypes)[by]
    inv = cov.mapInPandas(inverted, f"`{by}` {kind}, " + ", ".join(f"p_{i}_{j} double" for i, j in pairs))
    joined = d.join(inv, by)
    square = sum((F.col(f"p_{i}_{j}") * F.col(f"_z_{names[i]}") * F.col(f"_z_{names[j]}") * (1.0 if i == j else 2.0) for i, j in pairs), F.lit(0.0))
    return joined.select(by, "job_id", F.sqrt(F.greatest(F.lit(0.0), square)).alias("score"))


#: Seniority by title and by years (fixed values).
TITLE_FLOORS = [(r"(?i)\b(?:principal|director|head|vp|vice president|manager)\b", 5.0), (r"(?i)\b(?:lead|staff)\b", 4.0), (r"(?i)\b(?:senior|sr\.?)\b", 3.0), (r"(?i)\b(?:mid|mid-level|intermediate)\b", 2.0), (r"(?i)\b(?:junior|jr\.?)\b", 1.0), (r"(?i)\b(?:entry|entry-level|intern|internship)\b", 0.0)]
TITLE_CEILING = r"(?i)\b(?:intern|internship)\b"
YEARS_FLOORS = [(10.0, 5.0), (8.0, 4.0), (5.0, 3.0), (3.0, 2.0), (1.0, 1.0), (0.0, 0.0)]
LEVELS = ["entry", "junior", "mid", "senior", "lead", "principal/manager"]


def level_score(similarities: Column, alpha: float = 3.0) -> Column:
    """The expected level of an array of similarities to the six levels: shifted above
    zero, made a distribution, sharpened."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def shifted(sims: Column) -> Column:
        return let(F.least(F.array_min(sims), F.lit(0.0)), lambda least: F.transform(sims, lambda s: s - least))

    def shares(a: Column) -> Column:
        return let(total(a), lambda t: F.transform(a, lambda s: F.when(t > 0, s / t).otherwise(F.lit(1.0) / F.size(a))))

    def expected(p: Column) -> Column:
        weighted = F.transform(p, lambda v, k: v * k)
        return total(weighted) / total(p)

    def sharpened(p: Column) -> Column:
        return F.transform(p, lambda v: F.pow(v, F.lit(alpha)))

    return let(similarities, lambda sims: let(shifted(sims), lambda a: let(shares(a), lambda p: let(sharpened(p), expected))))


def bounded_level(score: Column, title: Column, years: Column) -> Column:
    """A level raised to the floor of its title or years, and lowered to an intern's ceiling."""
    t = F.coalesce(title, F.lit(""))
    by_title = F.coalesce(*[F.when(t.rlike(p), F.lit(v)) for p, v in TITLE_FLOORS])
    y = years.cast("string").try_cast("double")
    by_years = F.coalesce(*[F.when(y >= a, F.lit(v)) for a, v in YEARS_FLOORS])
    raised = F.greatest(score, by_title, by_years)
    return F.when(t.rlike(TITLE_CEILING), F.least(raised, F.lit(0.0))).otherwise(raised)


def level_label(score: Column) -> Column:
    """The nearest level; halves go to the even one."""
    return F.get(F.array(*[F.lit(x) for x in LEVELS]), F.least(F.greatest(F.rint(score), F.lit(0.0)), F.lit(5.0)).cast("int"))


def technology_mismatch(df: DataFrame, least: int = 3, most_overlap: float = 0.333333) -> DataFrame:
    """df (job_categories, resume_categories) with overlap and is_mismatch."""
    shared = F.size(F.array_intersect("job_categories", "resume_categories"))
    n = F.size("job_categories")
    overlap = F.when(n > 0, shared / n).otherwise(F.lit(1.0))
    return df.withColumns({"overlap": overlap, "is_mismatch": (n >= least) & (overlap <= most_overlap)})


def by_company(df: DataFrame, rank: str = "final_rank", company: str = "company") -> DataFrame:
    """Companies in order of their best job: count, first and last place, and a label (#a or #a-#b)."""
    g = df.groupBy(company).agg(F.count("*").alias("jobs"), F.min(rank).alias("first_rank"), F.max(rank).alias("last_rank"))
    a, b = F.col("first_rank").cast("string"), F.col("last_rank").cast("string")
    return g.withColumn("label", F.when(F.col("jobs") == 1, F.concat(F.lit("#"), a)).otherwise(F.concat(F.lit("#"), a, F.lit("-#"), b)))


def ordered_union(*parts: DataFrame) -> DataFrame:
    """query_id and job_id of the parts, each once, at its first place: by part, then by rank."""
    every = None
    for k, p in enumerate(parts):
        q = p.select("query_id", "job_id", F.struct(F.lit(k).alias("part"), F.col("rank").cast("long").alias("rank")).alias("at"))
        every = q if every is None else every.unionByName(q)
    first = every.groupBy("query_id", "job_id").agg(F.min("at").alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "job_id")
    return first.select("query_id", "job_id", F.row_number().over(w).cast("long").alias("place"))


def until_enough(df: DataFrame, passes: Column, order: list[Column], enough: int, by: str = "query_id") -> DataFrame:
    """Rows that pass, in order, up to the k-th: what a screen that stops early would keep."""
    w = Window.partitionBy(by).orderBy(*order)
    before = F.coalesce(F.sum(passes.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_before", before).filter(passes & (F.col("_before") < enough)).drop("_before")
