"""The test tables projected into the shapes that the operators work on.

Every projection is SQL that Spark and DuckDB both read, so that a query and its
oracle start from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered
from ..session import stored

#: Postings made of orders: blanks, nulls, unreadable years and every location status occur.
JOB_COLUMNS = {
    "id": "o_orderkey",
    "source_type": "CASE o_orderkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' END",
    "source_company": "concat('c', CAST(o_custkey % 50 AS VARCHAR(20)))",
    "source_job_id": "CAST(o_orderkey - o_orderkey % 3 AS VARCHAR(20))",
    "title": "CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE concat(CASE o_custkey % 7 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Junior ' WHEN 2 THEN 'Staff ' WHEN 3 THEN 'Intern ' WHEN 4 THEN 'Director ' ELSE '' END, 'role ', CAST(o_orderkey % 17 AS VARCHAR(20))) END",
    "content_text": "CASE o_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN 'nan' WHEN 2 THEN '  ' ELSE concat('We build things. Needs at least ', CAST(o_custkey % 15 AS VARCHAR(20)), ' years of experience in ', o_orderpriority, '. ', CASE o_custkey % 4 WHEN 0 THEN 'Active TS/SCI clearance with polygraph.' WHEN 1 THEN 'No clearance required.' WHEN 2 THEN 'A secret clearance is preferred.' ELSE '' END) END",
    "posted_at_utc": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate END",
    "location_parse_status": "CASE o_orderkey % 9 WHEN 0 THEN 'parsed' WHEN 1 THEN 'country_only' WHEN 2 THEN 'remote' WHEN 3 THEN 'multi_location' WHEN 4 THEN 'city_resolved' WHEN 5 THEN 'ambiguous' WHEN 6 THEN 'unparseable' WHEN 7 THEN 'missing' END",
    "is_active": "o_orderkey % 5 <> 0",
    "min_years_experience": "CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' ELSE CAST(o_custkey % 15 AS VARCHAR(20)) END",
    "requires_clearance": "CASE o_custkey % 6 WHEN 0 THEN 'True' WHEN 1 THEN 'false' WHEN 2 THEN ' ' WHEN 3 THEN 'None' END",
    "clearance_type": "CASE WHEN o_custkey % 10 = 0 THEN 'Secret' END",
    "yoe_version": "CASE o_orderkey % 3 WHEN 0 THEN 'v1' WHEN 1 THEN 'v0' END",
    "salary": "o_totalprice",
}
JOBS_SQL = "jobs AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in JOB_COLUMNS.items()) + " FROM orders)"

#: Three metrics of each (supplier as query, part as job), some missing.
METRICS_SQL = """metrics AS (SELECT l_suppkey % 20 AS query_id, l_partkey AS job_id,
    round(avg(l_extendedprice), 4) AS word_distance,
    CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE round(sum(l_quantity), 4) END AS coverage,
    round(max(l_discount * 100) + l_partkey % 5, 4) AS cross_score
    FROM lineitem GROUP BY l_suppkey % 20, l_partkey)"""

#: The rank of every job under each metric.
RESULTS_SQL = """results AS (
    SELECT query_id, 'word_wasserstein' AS operation, 'ok' AS status, job_id, rank() OVER (PARTITION BY query_id ORDER BY word_distance) AS rank FROM metrics
    UNION ALL SELECT query_id, 'phrase_coverage', 'ok', job_id, rank() OVER (PARTITION BY query_id ORDER BY coverage DESC) FROM metrics WHERE coverage IS NOT NULL
    UNION ALL SELECT query_id, 'cross_encoder', CASE WHEN query_id % 5 = 4 THEN 'failed' ELSE 'ok' END, job_id, rank() OVER (PARTITION BY query_id ORDER BY cross_score DESC) FROM metrics
    UNION ALL SELECT query_id, 'seniority_filter', 'ok', job_id, job_id FROM metrics)"""


def from_sql(spark: SparkSession, sf_dir: str, tables: list[str], sql: str) -> DataFrame:
    """SQL over tables of the folder, under names of its own."""
    out = sql
    for t in tables:
        out = out.replace(f"FROM {t}", f"FROM parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(out)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, ["orders"], f"WITH {JOBS_SQL} SELECT * FROM jobs")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, ["lineitem"], f"WITH {METRICS_SQL} SELECT * FROM metrics")


def results(spark: SparkSession, sf_dir: str, m: DataFrame | None = None) -> DataFrame:
    """The rows of RESULTS_SQL (of m, the metrics as stored, if given): ranks by counted values, so that no task sorts a query's whole list."""
    m = stored(metrics(spark, sf_dir), "metrics") if m is None else m
    ok = F.lit("ok")
    row = lambda d, name, status, rank: d.select("query_id", F.lit(name).alias("operation"), status.alias("status"), "job_id", rank.cast("long").alias("rank"))
    rank = lambda d, value: ordered.ranks(d.select("query_id", "job_id", "word_distance", "coverage", "cross_score"), value, ["query_id"])
    out = row(rank(m, F.col("word_distance")), "word_wasserstein", ok, F.col("rank"))
    out = out.unionByName(row(rank(m.filter("coverage IS NOT NULL"), -F.col("coverage")), "phrase_coverage", ok, F.col("rank")))
    out = out.unionByName(row(rank(m, -F.col("cross_score")), "cross_encoder", F.when(F.col("query_id") % 5 == 4, "failed").otherwise("ok"), F.col("rank")))
    return out.unionByName(row(m, "seniority_filter", ok, F.col("job_id")))
