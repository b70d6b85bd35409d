"""Queries of the ranking algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, ranking
from ..session import stored
from .registry import query, table
from .shapes import JOBS_SQL, METRICS_SQL, RESULTS_SQL, jobs, metrics, results

DIRECTIONS = {"word_distance": -1, "coverage": 1, "cross_score": 1}
_DENSE = "dense AS (SELECT query_id, operation, job_id, dense_rank() OVER (PARTITION BY query_id, operation ORDER BY rank) AS d FROM results WHERE status = 'ok' AND operation <> 'seniority_filter' AND job_id % 3 <> 0), per AS (SELECT query_id, job_id, list_sort(list(d), 'DESC') AS worst, sum(1.0 / (60 + d)) AS rrf FROM dense GROUP BY query_id, job_id), remaining AS (SELECT DISTINCT query_id, job_id FROM metrics WHERE job_id % 3 <> 0)"


@query(f"WITH {METRICS_SQL}, {RESULTS_SQL} SELECT query_id, operation, job_id, CAST(rank AS BIGINT) AS rank FROM results WHERE operation = 'phrase_coverage'")
def competition_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1, 1, 3."""
    m = metrics(spark, sf_dir).filter("coverage IS NOT NULL")
    return ranking.ranked(m, F.col("coverage"), ["query_id"], ascending=False).select("query_id", F.lit("phrase_coverage").alias("operation"), "job_id", "rank")


def _fusion(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    left = metrics(spark, sf_dir).filter("job_id % 3 <> 0")
    return ranking.fused(results(spark, sf_dir), left, mode).select("query_id", "job_id", "final_rank")


@query(f"WITH {METRICS_SQL}, {RESULTS_SQL}, {_DENSE} SELECT r.query_id, r.job_id, row_number() OVER (PARTITION BY r.query_id ORDER BY worst IS NULL, worst, r.job_id) AS final_rank FROM remaining r LEFT JOIN per p ON p.query_id = r.query_id AND p.job_id = r.job_id")
def minimax_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks compared from worst to best."""
    return _fusion(spark, sf_dir, "minimax")


@query(f"WITH {METRICS_SQL}, {RESULTS_SQL}, {_DENSE} SELECT r.query_id, r.job_id, row_number() OVER (PARTITION BY r.query_id ORDER BY worst IS NULL, round(rrf, 12) DESC, worst, r.job_id) AS final_rank FROM remaining r LEFT JOIN per p ON p.query_id = r.query_id AND p.job_id = r.job_id")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal ranks summed."""
    return _fusion(spark, sf_dir, "rrf")


@query(f"WITH {METRICS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY word_distance, job_id) AS k, count(*) OVER (PARTITION BY query_id) AS n FROM metrics) SELECT query_id, job_id FROM p WHERE k <= least(n, 40, greatest(1, floor(n * 0.25)))")
def reduce_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list cut by number and share."""
    m = metrics(spark, sf_dir)
    return ranking.reduced(m, [F.col("word_distance"), F.col("job_id")], ranking.Policy(top_n=40, top_fraction=0.25)).select("query_id", "job_id")


@query(f"WITH {METRICS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY word_distance, job_id) AS k, count(*) FILTER (WHERE cross_score = 10) OVER (PARTITION BY query_id) AS good FROM metrics), q AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cross_score = 10 DESC, k) AS again FROM p) SELECT query_id, job_id FROM q WHERE again <= greatest(good, 60)")
def min_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter by score that is refilled up to a floor."""
    m = metrics(spark, sf_dir)
    return ranking.reduced(m, [F.col("word_distance"), F.col("job_id")], ranking.Policy(keep_score=10.0, least=60), score="cross_score").select("query_id", "job_id")


@query(f"WITH {METRICS_SQL}, r AS (SELECT query_id, job_id, job_id % 12 - 1 AS cluster, rank() OVER (PARTITION BY query_id ORDER BY word_distance) AS rank FROM metrics), c AS (SELECT query_id, cluster, min(rank) AS best FROM r WHERE cluster >= 0 GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, cluster) AS k, count(*) OVER (PARTITION BY query_id) AS n FROM c) SELECT r.query_id, r.job_id, r.cluster FROM r JOIN o ON o.query_id = r.query_id AND o.cluster = r.cluster WHERE k <= greatest(1, floor(n * 0.4))")
def cluster_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best clusters by their best member; noise goes."""
    r = ranking.ranked(metrics(spark, sf_dir).withColumn("cluster", F.col("job_id") % 12 - 1), F.col("word_distance"), ["query_id"])
    return ranking.best_clusters(r, 0.4).select("query_id", "job_id", "cluster")


@query(f"WITH {METRICS_SQL}, s AS (SELECT query_id, job_id, coalesce(coverage, 0) AS pf, word_distance AS bad FROM metrics), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pf, job_id) AS low, row_number() OVER (PARTITION BY query_id ORDER BY bad DESC, job_id) AS high, count(*) OVER (PARTITION BY query_id) AS n FROM s) SELECT query_id, job_id FROM p WHERE low > greatest(1, floor(n * 0.2)) AND high > greatest(1, floor(n * 0.3))")
def coverage_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the worst by coverage and the worst by bad matches."""
    s = metrics(spark, sf_dir).select("query_id", "job_id", F.coalesce("coverage", F.lit(0.0)).alias("percent_flagged"), F.col("word_distance").alias("bad_match_percent"))
    return ranking.coverage_cut(s, 0.2, 0.3, 1).select("query_id", "job_id")


_LONG = "l AS (SELECT query_id, job_id, 'w' AS metric, -word_distance AS g FROM metrics UNION ALL SELECT query_id, job_id, 'c', coverage FROM metrics WHERE coverage IS NOT NULL UNION ALL SELECT query_id, job_id, 'x', cross_score FROM metrics)"


@query(f"WITH {METRICS_SQL}, {_LONG}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id, metric ORDER BY g, job_id) AS k, count(*) OVER (PARTITION BY query_id, metric) AS n FROM l) SELECT query_id, job_id, count(*) FILTER (WHERE k <= greatest(1, floor(n * 0.25))) AS flag_count, count(*) FILTER (WHERE k <= greatest(1, floor(n * 0.25))) >= 2 AS is_bad FROM p GROUP BY query_id, job_id")
def multi_metric_badfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the worst quarter of two metrics or more."""
    return ranking.bad_fit(metrics(spark, sf_dir), DIRECTIONS)


_FILLED = "f AS (SELECT query_id, job_id, word_distance AS a, coalesce(coverage, avg(coverage) OVER (PARTITION BY query_id)) AS b FROM metrics), z AS (SELECT query_id, job_id, (a - avg(a) OVER w) / nullif(stddev_pop(a) OVER w, 0) AS x, (b - avg(b) OVER w) / nullif(stddev_pop(b) OVER w, 0) AS y FROM f WINDOW w AS (PARTITION BY query_id))"


@query(f"WITH {METRICS_SQL}, {_FILLED} SELECT query_id, job_id, round((coalesce(y, 0) - coalesce(x, 0)) / 2, 6) AS score FROM z")
def good_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean oriented z-score, missing metrics filled by the mean."""
    out = ranking.good_direction(metrics(spark, sf_dir), {"word_distance": -1, "coverage": 1})
    return out.select("query_id", "job_id", F.round("score", 6).alias("score"))


@query(f"WITH {METRICS_SQL}, {_FILLED}, c AS (SELECT query_id, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM z GROUP BY query_id) SELECT z.query_id, job_id, round(sqrt(greatest(0, (yy * x * x - 2 * xy * x * y + xx * y * y) / (xx * yy - xy * xy))), 5) AS score FROM z JOIN c ON c.query_id = z.query_id")
def mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers by Mahalanobis distance."""
    out = ranking.mahalanobis(metrics(spark, sf_dir), {"word_distance": -1, "coverage": 1})
    return out.select("query_id", "job_id", F.round("score", 5).alias("score"))


_FLOOR = "CASE WHEN regexp_matches(title, '(?i)\\b(principal|director|head|vp|vice president|manager)\\b') THEN 5.0 WHEN regexp_matches(title, '(?i)\\b(lead|staff)\\b') THEN 4.0 WHEN regexp_matches(title, '(?i)\\b(senior|sr)\\b') THEN 3.0 WHEN regexp_matches(title, '(?i)\\b(junior|jr)\\b') THEN 1.0 WHEN regexp_matches(title, '(?i)\\b(entry|intern)\\b') THEN 0.0 END"
_YEARS = "CASE WHEN y >= 10 THEN 5.0 WHEN y >= 8 THEN 4.0 WHEN y >= 5 THEN 3.0 WHEN y >= 3 THEN 2.0 WHEN y >= 1 THEN 1.0 WHEN y >= 0 THEN 0.0 END"


@query(f"WITH {JOBS_SQL}, s AS (SELECT id, title, try_cast(min_years_experience AS DOUBLE) AS y, 1.5 AS score FROM jobs), t AS (SELECT id, CASE WHEN regexp_matches(title, '(?i)\\bintern\\b') THEN 0.0 ELSE greatest(score, {_FLOOR}, {_YEARS}) END AS level FROM s) SELECT id, CAST(level AS DOUBLE) AS level, CASE WHEN level = 1.5 THEN 'mid' WHEN level = 0 THEN 'entry' WHEN level = 2 THEN 'mid' WHEN level = 3 THEN 'senior' WHEN level = 4 THEN 'lead' ELSE 'principal/manager' END AS label, level - 2.0 > 1.5 AS too_senior FROM t")
def seniority_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels raised by title and years, lowered for interns, against a mid-level resume."""
    level = ranking.bounded_level(F.lit(1.5), F.col("title"), F.col("min_years_experience"))
    out = jobs(spark, sf_dir).select("id", level.cast("double").alias("level"))
    return out.select("id", "level", ranking.level_label(F.col("level")).alias("label"), (F.col("level") - 2.0 > 1.5).alias("too_senior"))


_SIM = "s AS (SELECT vec_id, list_transform(embedding[1:6], lambda v: CAST(v AS DOUBLE) - least(list_min(list_transform(embedding[1:6], lambda u: CAST(u AS DOUBLE))), 0.0)) AS a FROM embeddings), p AS (SELECT vec_id, list_transform(a, lambda v: pow(v / list_sum(a), 3)) AS q FROM s)"


@query(f"WITH {_SIM} SELECT vec_id, round((q[2] + 2 * q[3] + 3 * q[4] + 4 * q[5] + 5 * q[6]) / list_sum(q), 6) AS level FROM p")
def seniority_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected level of six similarities, shifted, made a distribution and sharpened."""
    sims = F.transform(F.slice("embedding", 1, 6), lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(ranking.level_score(sims), 6).alias("level"))


@query("WITH o AS (SELECT p_partkey AS id, p_brand AS company, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS final_rank FROM part) SELECT company, count(*) AS jobs, CAST(min(final_rank) AS BIGINT) AS first_rank, CAST(max(final_rank) AS BIGINT) AS last_rank, CASE WHEN count(*) = 1 THEN concat('#', min(final_rank)) ELSE concat('#', min(final_rank), '-#', max(final_rank)) END AS label FROM o GROUP BY company")
def company_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked results by company."""
    from pyspark.sql import Window

    # One query's results are one list, as long as its candidates.
    o = table(spark, sf_dir, "part").withColumn("final_rank", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).cast("long"))
    return ranking.by_company(o.withColumnRenamed("p_brand", "company"))


@query(f"WITH {METRICS_SQL}, a AS (SELECT query_id, job_id, row_number() OVER (PARTITION BY query_id ORDER BY word_distance, job_id) AS k FROM metrics), b AS (SELECT query_id, job_id, row_number() OVER (PARTITION BY query_id ORDER BY cross_score DESC, job_id) AS k FROM metrics), u AS (SELECT query_id, job_id, 0 AS part, k FROM a WHERE k <= 10 UNION ALL SELECT query_id, job_id, 1, k FROM b WHERE k <= 10), m AS (SELECT query_id, job_id, min(part * 1000 + k) AS first_at FROM u GROUP BY 1, 2) SELECT query_id, job_id, row_number() OVER (PARTITION BY query_id ORDER BY first_at, job_id) AS place FROM m")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of two top tens, each job at its first place."""
    from pyspark.sql import Window

    m = metrics(spark, sf_dir)
    w = Window.partitionBy("query_id")
    a = m.withColumn("rank", F.row_number().over(w.orderBy("word_distance", "job_id"))).filter("rank <= 10")
    b = m.withColumn("rank", F.row_number().over(w.orderBy(F.desc("cross_score"), "job_id"))).filter("rank <= 10")
    return ranking.ordered_union(a, b)


@query(f"WITH {METRICS_SQL}, p AS (SELECT query_id, job_id, word_distance, coalesce(coverage, 0) > 60 AS ok FROM metrics), q AS (SELECT *, coalesce(sum(CAST(ok AS INTEGER)) OVER (PARTITION BY query_id ORDER BY word_distance, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT query_id, job_id FROM q WHERE ok AND before < 2")
def screen_until_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a screen that stops after two passes keeps."""
    m = metrics(spark, sf_dir)
    return ranking.until_enough(m, F.coalesce(F.col("coverage") > 60, F.lit(False)), [F.col("word_distance"), F.col("job_id")], 2).select("query_id", "job_id")


@query(f"WITH {METRICS_SQL}, {RESULTS_SQL} SELECT query_id, job_id, CAST(max(CASE WHEN operation = 'word_wasserstein' THEN rank END) AS BIGINT) AS word_wasserstein, CAST(max(CASE WHEN operation = 'phrase_coverage' THEN rank END) AS BIGINT) AS phrase_coverage, CAST(max(CASE WHEN operation = 'cross_encoder' THEN rank END) AS BIGINT) AS cross_encoder FROM results WHERE operation <> 'seniority_filter' GROUP BY query_id, job_id")
def final_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, M4, M5: long metrics pivoted to a wide row a job."""
    r = results(spark, sf_dir).filter("operation <> 'seniority_filter'")
    return r.groupBy("query_id", "job_id").pivot("operation", ["word_wasserstein", "phrase_coverage", "cross_encoder"]).agg(F.max("rank").cast("long"))


@query(f"WITH {METRICS_SQL}, {RESULTS_SQL}, {_LONG}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id, metric ORDER BY g, job_id) AS k, count(*) OVER (PARTITION BY query_id, metric) AS n FROM l), bad AS (SELECT query_id, job_id FROM p GROUP BY 1, 2 HAVING count(*) FILTER (WHERE k <= greatest(1, floor(n * 0.25))) >= 2), remaining AS (SELECT DISTINCT m.query_id, m.job_id FROM metrics m ANTI JOIN bad b ON b.query_id = m.query_id AND b.job_id = m.job_id), dense AS (SELECT r.query_id, operation, r.job_id, dense_rank() OVER (PARTITION BY r.query_id, operation ORDER BY rank) AS d FROM results r SEMI JOIN remaining m ON m.query_id = r.query_id AND m.job_id = r.job_id WHERE status = 'ok' AND operation <> 'seniority_filter'), per AS (SELECT query_id, job_id, list_sort(list(d), 'DESC') AS worst FROM dense GROUP BY 1, 2), o AS (SELECT r.query_id, r.job_id, row_number() OVER (PARTITION BY r.query_id ORDER BY worst IS NULL, worst, r.job_id) AS final_rank FROM remaining r LEFT JOIN per p ON p.query_id = r.query_id AND p.job_id = r.job_id) SELECT query_id, job_id, final_rank FROM o WHERE final_rank <= 10")
def rank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking pipeline end to end: metrics, the bad-fit filter, fusion, the ten best a query (a report)."""
    m = stored(metrics(spark, sf_dir), "metrics")  # read by the filter, by every operation and by the fusion
    bad = ranking.bad_fit(m, DIRECTIONS).filter("is_bad").select("query_id", "job_id")
    left = stored(m.join(bad, ["query_id", "job_id"], "left_anti").select("query_id", "job_id"), "remaining")
    return ranking.fused(results(spark, sf_dir, m), left).filter("final_rank <= 10").select("query_id", "job_id", "final_rank")


@query(f"""WITH {METRICS_SQL}, a AS (SELECT query_id, job_id, CASE WHEN query_id % 7 = 3 AND job_id % 5 = 0 THEN NULL ELSE job_id % 3 = 0 END AS accepted, row_number() OVER (PARTITION BY query_id ORDER BY word_distance, job_id) AS place FROM metrics),
    b AS (SELECT *, coalesce(count(*) FILTER (accepted) OVER w, 0) AS passed, coalesce(count(*) FILTER (accepted IS NULL) OVER w, 0) AS failed FROM a WHERE place <= 9 WINDOW w AS (PARTITION BY query_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT * FROM b WHERE passed < 2 AND failed = 0),
    e AS (SELECT query_id, count(*) AS calls, bool_or(accepted IS NULL) AS lost FROM c GROUP BY query_id)
    SELECT a.query_id, a.job_id, CASE WHEN lost THEN 'failed' ELSE 'ok' END AS status, calls FROM a JOIN e USING (query_id) LEFT JOIN c ON c.query_id = a.query_id AND c.job_id = a.job_id WHERE lost OR c.accepted""")
def asked_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A screen that asks about the next candidate of every open query, until two pass, nine were asked or a call fails."""
    answer = lambda d: d.withColumn("accepted", F.when((F.col("query_id") % 7 == 3) & (F.col("job_id") % 5 == 0), F.lit(None).cast("boolean")).otherwise(F.col("job_id") % 3 == 0))
    out = clusters.asked_in_rounds(metrics(spark, sf_dir), answer, [F.col("word_distance"), F.col("job_id")], 2, 9)
    return out.select("query_id", "job_id", "status", "calls")
