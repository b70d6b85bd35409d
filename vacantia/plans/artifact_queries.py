"""Queries of stored features, packaging, restarts and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import artifacts, ranking, vectors
from .registry import query, table
from .shapes import JOBS_SQL, METRICS_SQL, jobs, metrics

_GROUPED = "g AS (SELECT (vec_id // 5) % 4 AS artifact_shard, vec_id // 20 AS row_index, list(list_transform(embedding, lambda v: CAST(v AS DOUBLE)) ORDER BY vec_id) FILTER (vec_id % 7 <> 0) AS vectors FROM embeddings GROUP BY 1, 2)"


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").selectExpr("cast(floor(vec_id / 5) as bigint) % 4 AS artifact_shard", "cast(floor(vec_id / 20) as bigint) AS row_index", "vec_id", "transform(embedding, v -> double(v)) AS embedding")
    packed = F.array_sort(F.collect_list(F.when(F.col("vec_id") % 7 != 0, F.struct("vec_id", "embedding"))))
    return e.groupBy("artifact_shard", "row_index").agg(F.transform(packed, lambda s: s["embedding"]).alias("vectors"))


@query(f"WITH {_GROUPED}, o AS (SELECT artifact_shard, row_index, coalesce(len(vectors), 0) AS n, vectors FROM g) SELECT artifact_shard, row_index, CAST(sum(n) OVER w - n AS BIGINT) AS first, CAST(sum(n) OVER w AS BIGINT) AS last, CAST(n AS BIGINT) AS gathered, round(coalesce(vectors[1][1], 0), 6) AS head, round(coalesce(vectors[n][64], 0), 6) AS tail FROM o WINDOW w AS (PARTITION BY artifact_shard ORDER BY row_index)")
def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested vectors to a flat list with offsets, and gathered back by row."""
    g = _groups(spark, sf_dir)
    spans = artifacts.offsets(g, "vectors").select("artifact_shard", "row_index", "first", "last")
    back = artifacts.gathered(artifacts.flattened(g, "vectors"), spans)
    out = back.join(spans.selectExpr("artifact_shard AS s", "row_index AS r", "first", "last"), (F.col("artifact_shard") == F.col("s")) & (F.col("row_index") == F.col("r")))
    ends = [F.round(F.coalesce(F.try_element_at(F.try_element_at("vectors", F.lit(a)), F.lit(b)), F.lit(0.0)), 6) for a, b in ((1, 1), (-1, 64))]
    return out.select("artifact_shard", "row_index", "first", "last", F.size("vectors").cast("long").alias("gathered"), ends[0].alias("head"), ends[1].alias("tail"))


@query(f"WITH {_GROUPED} SELECT artifact_shard, row_index, concat('job ', row_index * 4 + artifact_shard) AS title, CAST(len(vectors) AS BIGINT) AS n FROM g WHERE row_index < 40")
def metadata_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and vectors of the same row of the same shard, at most 40 rows of each shard (a cap of the reader)."""
    g = _groups(spark, sf_dir)
    m = g.select("artifact_shard", "row_index", F.concat(F.lit("job "), (F.col("row_index") * 4 + F.col("artifact_shard")).cast("string")).alias("title"))
    return artifacts.by_row(m, g, most=40).select("artifact_shard", "row_index", "title", F.size("vectors").cast("long").alias("n"))


@query("WITH p AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 > 0 THEN range(0, p_size % 5) END AS c, CASE WHEN p_size % 7 > 0 THEN range(0, p_size % 7) END AS v FROM part) SELECT id, least(coalesce(len(c), 0), coalesce(len(v), 0)) AS pairs FROM p")
def phrase_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and vectors of unequal number, as long as the shorter."""
    upto = lambda k: F.when(F.col("p_size") % k > 0, F.sequence(F.lit(1).cast("long"), (F.col("p_size") % k).cast("long")))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), upto(5).alias("c"), upto(7).alias("v"))
    return p.select("id", F.coalesce(F.size(artifacts.trimmed_group(F.col("c"), F.col("v"))), F.lit(0)).alias("n")).select("id", F.greatest("n", F.lit(0)).cast("long").alias("pairs"))


@query(f"WITH {METRICS_SQL}, r AS (SELECT query_id, job_id, cross_score, row_number() OVER (PARTITION BY query_id ORDER BY cross_score DESC, job_id) AS place FROM metrics) SELECT query_id, job_id, place, CASE WHEN place <= 10 THEN 'top' ELSE 'more' END AS section, CAST(least(2500, length(repeat('text ', CAST(job_id % 700 AS INT)))) AS BIGINT) AS preview_chars FROM r WHERE place <= 60")
def packaged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten results and fifty more of each query (lists of a set length), with previews."""
    text = F.expr("repeat('text ', cast(job_id % 700 as int))")
    out = artifacts.packaged(metrics(spark, sf_dir), [F.desc("cross_score"), F.col("job_id")], 10, text, more=50)
    return out.select("query_id", "job_id", "place", "section", F.length("preview").cast("long").alias("preview_chars"))


@query(f"WITH {JOBS_SQL} SELECT id, concat('JOB TITLE:', chr(10), substr(coalesce(title, ''), 1, 12), chr(10), chr(10), 'JOB REQUIREMENTS:', chr(10), substr(coalesce(content_text, ''), 1, 12)) AS prompt FROM jobs")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts, either part clipped."""
    return jobs(spark, sf_dir).select("id", artifacts.prompt(F.col("title"), F.col("content_text"), 12).alias("prompt"))


@query(f"WITH {JOBS_SQL} SELECT id FROM jobs WHERE id > 1000 ORDER BY id LIMIT 500")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 rows behind a key (a page)."""
    return artifacts.page_after(jobs(spark, sf_dir).select("id"), "id", 1000, 500)


@query("SELECT event_id, CAST(json_extract_string(m, '$.k') AS VARCHAR) AS k, json_extract_string(m, '$.user') AS user, json_type(m, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE') AS number, CAST(len(json_keys(m)) AS BIGINT) AS keys FROM (SELECT event_id, json_merge_patch(json(coalesce(props, '{}')), CASE event_id % 3 WHEN 0 THEN json(concat('{\"user\": \"u', user_id, '\"}')) WHEN 1 THEN json('{\"k\": 7, \"user\": \"x\"}') ELSE json('{}') END) AS m FROM events)")
def merged_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: one JSON object over another."""
    e = table(spark, sf_dir, "events").withColumn("new", F.expr("CASE event_id % 3 WHEN 0 THEN concat('{\"user\": \"u', user_id, '\"}') WHEN 1 THEN '{\"k\": 7, \"user\": \"x\"}' END"))
    m = e.withColumn("m", artifacts.merged_json(F.col("props"), F.col("new")))
    plain = F.from_json("m", "map<string,variant>")
    return m.select("event_id", F.get_json_object("m", "$.k").alias("k"), F.get_json_object("m", "$.user").alias("user"), F.schema_of_variant(plain["k"]).isin("BIGINT", "DOUBLE").alias("number"), F.json_array_length(F.to_json(F.map_keys(plain))).cast("long").alias("keys"))


_RESUMES = [(1, "alpha"), (2, "beta"), (3, "gamma"), (4, "delta"), (5, "epsilon")]


@query(f"WITH {JOBS_SQL}, r AS (SELECT * FROM (VALUES (1, 'alpha'), (2, 'beta'), (3, 'gamma'), (4, 'delta'), (5, 'epsilon')) AS v(resume_id, resume)) SELECT resume_id, CAST(count(*) AS BIGINT) AS pairs, CAST(sum(length(resume) * (id % 10)) AS BIGINT) AS total FROM r, jobs WHERE is_active GROUP BY resume_id")
def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five stated resumes with every posting."""
    p = artifacts.all_pairs(_RESUMES, "resume_id int, resume string", jobs(spark, sf_dir).filter("is_active").select("id"))
    return p.groupBy("resume_id").agg(F.count("*").alias("pairs"), F.sum(F.length("resume") * (F.col("id") % 10)).cast("long").alias("total"))


@query("WITH d AS (SELECT l_suppkey % 40 AS resume_id, l_linenumber AS job_id FROM lineitem WHERE l_suppkey % 40 < 20 OR l_linenumber < 3 GROUP BY 1, 2) SELECT resume_id, job_id FROM d SEMI JOIN (SELECT resume_id FROM d GROUP BY 1 HAVING count(*) = 7) w ON w.resume_id = d.resume_id")
def finished_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a restart keeps: resumes with all their pairs."""
    d = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 40 AS resume_id", "l_linenumber AS job_id").filter("resume_id < 20 OR job_id < 3").distinct()
    return artifacts.finished(d, "resume_id", 7)


@query(f"WITH {METRICS_SQL}, n AS (SELECT query_id, job_id, round(word_distance + 3 * coalesce(coverage, 0), 4) AS d FROM metrics) SELECT query_id, job_id, d AS requirements_distance, rank() OVER (PARTITION BY query_id ORDER BY d) AS rank FROM n")
def recomputed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric computed again over saved pairs, and its ranks with it."""
    m = metrics(spark, sf_dir).withColumn("requirements_distance", F.round(F.col("word_distance") + 3 * F.coalesce("coverage", F.lit(0.0)), 4))
    return ranking.ranked(m, F.col("requirements_distance"), ["query_id"]).select("query_id", "job_id", "requirements_distance", "rank")


@query("SELECT page_id, octet_length(encode(html)) <= 2000 AS whole, CAST(octet_length(encode(html)) AS BIGINT) AS bytes FROM pages WHERE octet_length(encode(html)) <= 2000")
def byte_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses within the limit of bytes; larger ones are refused whole."""
    from ..sources import files

    p = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return files.within_limit(p, "content", 2000).select("page_id", F.lit(True).alias("whole"), F.length("content").cast("long").alias("bytes"))


@query(f"WITH {JOBS_SQL} SELECT id FROM jobs WHERE is_active AND posted_at_utc IS NOT NULL AND source_type IS NOT NULL AND min_years_experience IS NOT NULL AND clearance_type IS NOT NULL AND content_text IS NOT NULL AND yoe_version = 'v1' AND id % 2 = 0")
def export_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eligible, five features there, both versions current."""
    j = jobs(spark, sf_dir)
    features = [F.col(c) for c in ("posted_at_utc", "source_type", "min_years_experience", "clearance_type", "content_text")]
    versions = {"enrichment_version": (F.col("yoe_version"), "v1"), "enrichment_ml_version": (F.when(F.col("id") % 2 == 0, F.lit("m1")), "m1")}
    return j.filter(artifacts.export_ready(F.col("is_active"), features, versions)).select("id")


@query(f"WITH {METRICS_SQL} SELECT query_id, job_id, 'technology_mismatch' AS operation, 'unavailable' AS status, 1.0 AS overlap, false AS is_mismatch FROM metrics")
def unavailable_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neutral result of an operation whose dictionary is missing."""
    out = artifacts.unavailable(metrics(spark, sf_dir), ["query_id", "job_id"], "technology_mismatch", "no terms", overlap=1.0, is_mismatch=False)
    return out.drop("reason")


@query(f"WITH {JOBS_SQL}, t AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'same words' ELSE concat('words ', id % 50) END AS t, row_number() OVER (ORDER BY posted_at_utc DESC NULLS LAST, id DESC) AS k FROM jobs) SELECT id, k <= 1000 AS kept, CAST(64 AS BIGINT) AS dim FROM t WHERE k <= 1000")
def embedding_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest thousand are encoded, each distinct text once (the number kept is the feature)."""
    j = jobs(spark, sf_dir).orderBy(F.desc_nulls_last("posted_at_utc"), F.desc("id")).limit(1000)
    t = j.select("id", F.when(F.col("id") % 3 == 0, F.lit("same words")).otherwise(F.concat(F.lit("words "), (F.col("id") % 50).cast("string"))).alias("t"))
    return vectors.encoded(t, "t").select("id", F.lit(True).alias("kept"), F.size("vector").cast("long").alias("dim"))
