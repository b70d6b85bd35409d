"""Queries of what came of fetching: listings and answers as stored, outcomes, backlogs and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display
from ..operators import lifecycle, quality
from ..sources import boards, postings
from .registry import query, table
from .shapes import JOBS_SQL, from_sql, jobs

_FETCHED = """stored AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN '<p>old</p>' END AS content_html, CASE WHEN o_orderkey % 5 = 0 THEN 'old text' END AS content_text,
    CASE WHEN o_orderkey % 7 <> 0 THEN concat('{"a": ', CAST(o_orderkey AS VARCHAR(20)), '}') END AS raw_json, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 4 AS INT) END AS fetch_failed_count,
    CASE WHEN o_orderkey % 4 > 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS fetch_last_failed_at, CASE WHEN o_orderkey % 4 > 0 THEN 'Timeout' END AS fetch_last_error_type, 'v1' AS yoe_version FROM orders),
    tried AS (SELECT o_orderkey AS id, concat('<p>', o_orderpriority, '</p>') AS html, concat(o_orderpriority, repeat('ä', CAST(o_orderkey % 12 AS INT))) AS text, CASE WHEN o_orderkey % 3 = 1 THEN concat('Http', CAST(400 + o_orderkey % 9 AS VARCHAR(20))) END AS error_type FROM orders WHERE o_orderkey % 3 < 2)"""


@query(f"""WITH {_FETCHED}, j AS (SELECT s.*, t.html, t.text AS body, t.error_type, t.id IS NOT NULL AND t.error_type IS NULL AS won, t.error_type IS NOT NULL AS failed FROM stored s LEFT JOIN tried t USING (id))
    SELECT id, CASE WHEN won THEN coalesce(content_html, substr(html, 1, 12)) ELSE content_html END AS content_html, CASE WHEN won THEN concat(rtrim(body, 'ä'), repeat('ä', CAST(least(len(body) - len(rtrim(body, 'ä')), (20 - len(rtrim(body, 'ä'))) // 2) AS INT))) ELSE content_text END AS content_text,
    CASE WHEN id % 7 <> 0 THEN CAST(id AS VARCHAR) END AS kept, CASE WHEN won THEN CASE WHEN len(html) > 12 THEN 'true' ELSE 'false' END END AS html_cut, CASE WHEN won THEN CASE WHEN octet_length(encode(body)) > 20 THEN 'true' ELSE 'false' END END AS text_cut,
    CASE WHEN won THEN 0 WHEN failed THEN coalesce(fetch_failed_count, 0) + 1 ELSE fetch_failed_count END AS fetch_failed_count, CASE WHEN failed THEN TIMESTAMP '2024-02-01 00:00:00' WHEN NOT won THEN fetch_last_failed_at END AS fetch_last_failed_at, CASE WHEN failed THEN error_type WHEN NOT won THEN fetch_last_error_type END AS fetch_last_error_type, CASE WHEN NOT won THEN yoe_version END AS yoe_version FROM j""")
def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: stored postings after a batch of fetched pages, some of which failed."""
    s, t = (from_sql(spark, sf_dir, ["orders"], f"WITH {_FETCHED} SELECT * FROM {n}") for n in ("stored", "tried"))
    out = lifecycle.fetched(s, t, "id", F.expr("TIMESTAMP '2024-02-01 00:00:00'"), 12, 20)
    limit = lambda c: F.get_json_object("raw_json", f"$.ingestion_size_limits.{c}_truncated")
    return out.select("id", "content_html", "content_text", F.get_json_object("raw_json", "$.a").alias("kept"), limit("content_html").alias("html_cut"), limit("content_text").alias("text_cut"), "fetch_failed_count", "fetch_last_failed_at", "fetch_last_error_type", "yoe_version")


_SOURCES = """sources AS (SELECT concat('https://', CAST(c_custkey AS VARCHAR(20))) AS source_url, c_mktsegment AS ats, max(o_orderdate) AS last_get_at, CASE WHEN c_custkey % 6 = 0 THEN 404 WHEN c_custkey % 7 > 0 THEN 200 END AS last_http_status_code, CASE WHEN c_custkey % 9 > 0 THEN c_custkey % 9 END AS http_404_streak
    FROM customer LEFT JOIN (SELECT o_custkey, o_orderdate FROM orders) ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment)"""


@query(f"WITH {_SOURCES} SELECT ats, source_url, row_number() OVER (PARTITION BY ats ORDER BY last_get_at NULLS FIRST, source_url) AS place FROM sources WHERE NOT coalesce(last_http_status_code = 404 AND http_404_streak >= 3, false)")
def unread_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of each kind in the order in which they are read, without those gone for long."""
    s = from_sql(spark, sf_dir, ["customer", "orders"], f"WITH {_SOURCES} SELECT * FROM sources")
    return lifecycle.source_backlog(s, 3).select("ats", "source_url", "place")


@query(f"WITH {_SOURCES} SELECT ats, count(*) FILTER (WHERE last_http_status_code = 404 AND http_404_streak >= 3) AS skipped FROM sources GROUP BY ats")
def skipped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sources of each kind are not read."""
    return lifecycle.skipped_sources(from_sql(spark, sf_dir, ["customer", "orders"], f"WITH {_SOURCES} SELECT * FROM sources"), 3)


_PAGES = """entries AS (SELECT o_custkey AS source, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    said AS (SELECT *, CASE source % 4 WHEN 0 THEN 2 * n WHEN 1 THEN 5 WHEN 2 THEN 0 ELSE n END AS total FROM entries)"""


@query(f"WITH {_PAGES}, t AS (SELECT source, id, k, k - k % 4 AS before, CASE WHEN total = 0 THEN least(n, 4) ELSE total END AS total FROM said), r AS (SELECT source, id, count(*) OVER (PARTITION BY source ORDER BY id) AS place FROM t WHERE before < total AND id % 10 <> 0) SELECT source, count(*) AS jobs, max(id) AS last_id, count(*) FILTER (WHERE place <= 6) AS first_jobs, max(CASE WHEN place <= 6 THEN id END) AS last_of_first FROM r GROUP BY source")
def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs of stored listing pages, whole and with at most six a source; totals that
    are too large, too small or absent decide where reading ends."""
    e = from_sql(spark, sf_dir, ["orders"], f"WITH {_PAGES} SELECT * FROM said")
    entry = F.when(F.col("id") % 10 == 0, F.lit('"no job"')).otherwise(F.to_json(F.struct("id")))
    pages = e.groupBy("source", (F.floor(F.col("k") / 4) + 1).alias("page")).agg(F.max("total").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("k", entry.alias("e")))), lambda s: s["e"]).alias("jobs"))  # four entries
    read = lambda most: boards.pages_read(pages, most=most).select("source", F.get_json_object("raw_json", "$.id").cast("long").alias("id"))
    whole = read(None).groupBy("source").agg(F.count("*").alias("jobs"), F.max("id").alias("last_id"))
    first = read(6).groupBy("source").agg(F.count("*").alias("first_jobs"), F.max("id").alias("last_of_first"))
    return whole.join(first, "source")


_ANSWERS = """answered AS (SELECT CASE o_orderstatus WHEN 'O' THEN concat('https://boards-api.greenhouse.io/v1/boards/a', CAST(o_custkey AS VARCHAR(20)), '/jobs') WHEN 'F' THEN concat('https://api.lever.co/v0/postings/a', CAST(o_custkey AS VARCHAR(20)), '?mode=json') ELSE concat('https://api.ashbyhq.com/posting-api/job-board/b%20', CAST(o_custkey AS VARCHAR(20))) END AS url,
    max(CASE WHEN o_custkey % 5 = 0 THEN 404 ELSE 200 END) AS status, max(CASE WHEN o_orderstatus = 'F' THEN '[]' WHEN o_custkey % 7 = 0 THEN '{"error": 1}' ELSE '{"jobs": []}' END) AS body, max(o_custkey) AS cust, max(o_orderstatus) AS kind FROM orders GROUP BY o_custkey, o_orderstatus)"""


@query(f"WITH {_ANSWERS}, v AS (SELECT cust, min(CASE kind WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END) AS k FROM answered WHERE status = 200 AND (kind = 'F' OR cust % 7 <> 0) GROUP BY cust) SELECT cust AS id, CASE k WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'ashby' END AS provider, CASE k WHEN 2 THEN concat('b ', cust) ELSE concat('a', cust) END AS identifier FROM v")
def first_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all endpoints of a company, the first with a valid answer among those stored."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), *[F.concat(F.lit(x), F.col("c_custkey").cast("string")).alias(x[0]) for x in ("a", "b ")])
    tried = boards.endpoints(c, "id", F.array("a", "b"))
    got = boards.first_answers(tried, from_sql(spark, sf_dir, ["orders"], f"WITH {_ANSWERS} SELECT url, status, body FROM answered"), "id")
    return got.select("id", "provider", "identifier")


_POSTED = f"{JOBS_SQL}, seen AS (SELECT *, CASE WHEN id % 19 = 0 THEN ' NaN ' WHEN id % 23 = 0 THEN ' ' WHEN posted_at_utc IS NOT NULL THEN 'Posted Today' END AS posted_at FROM jobs)"


@query(f"WITH {_POSTED}, t AS (SELECT count(*) AS active_jobs, count(*) FILTER (WHERE lower(trim(coalesce(posted_at, ''))) NOT IN ('', 'nan', 'none', 'null')) AS has_posted_at FROM seen WHERE is_active) SELECT active_jobs, has_posted_at, active_jobs - has_posted_at AS missing_posted_at, round(100.0 * (active_jobs - has_posted_at) / active_jobs, 6) AS percent_missing_posted_at FROM t")
def posted_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active postings with and without a posting time."""
    out = quality.posted_summary(from_sql(spark, sf_dir, ["orders"], f"WITH {_POSTED} SELECT * FROM seen"))
    return out.withColumn("percent_missing_posted_at", F.round("percent_missing_posted_at", 6))


_BATCH = """batch AS (SELECT concat('c', CAST(o_custkey % 40 AS VARCHAR(20))) AS source, CASE WHEN o_orderkey % 29 = 0 THEN ' ' ELSE CAST(o_orderkey - o_orderkey % 3 AS VARCHAR(20)) END AS source_job_id, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE 't' END AS title, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'u' END AS job_url,
    CASE WHEN o_orderkey % 5 > 0 THEN 'Ulm' END AS location_name, 'x' AS content_text, CAST(o_totalprice AS VARCHAR(20)) AS fingerprint FROM orders),
    known AS (SELECT source, source_job_id, min(fingerprint) AS fingerprint FROM batch GROUP BY source, source_job_id)"""


@query(f"WITH {_BATCH}, j AS (SELECT b.*, coalesce(b.fingerprint = k.fingerprint, false) AS same FROM batch b LEFT JOIN known k ON k.source = b.source AND k.source_job_id = b.source_job_id) SELECT source, count(*) AS fetched, count(*) FILTER (WHERE same) AS unchanged_skipped, count(*) FILTER (WHERE NOT same) AS to_upsert, count(*) FILTER (WHERE trim(title) = '') AS missing_title, count(*) FILTER (WHERE trim(job_url) = '') AS missing_url, count(*) FILTER (WHERE location_name IS NULL) AS missing_location, count(*) FILTER (WHERE content_text IS NULL) AS missing_content_text, count(*) FILTER (WHERE trim(source_job_id) <> '') - count(DISTINCT CASE WHEN trim(source_job_id) <> '' THEN source_job_id END) AS duplicate_source_job_ids FROM j GROUP BY source")
def connector_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a connector fetched, a row a source."""
    b, k = (from_sql(spark, sf_dir, ["orders"], f"WITH {_BATCH} SELECT * FROM {n}") for n in ("batch", "known"))
    return quality.connector_summary(b, k, "source")


_EXPORTED = f"{JOBS_SQL}, exported AS (SELECT id, source_type, CASE WHEN id % 17 = 0 THEN NULL ELSE posted_at_utc END AS first_seen_at_utc, id // 1000 AS artifact_shard FROM jobs WHERE is_active)"


@query(f"WITH {_EXPORTED}, e AS (SELECT artifact_shard, coalesce(source_type, 'unknown') AS s, first_seen_at_utc >= TIMESTAMP '1995-01-01 00:00:00' AS new FROM exported), n AS (SELECT artifact_shard, s, count(*) AS n, count(*) FILTER (WHERE new) AS new FROM e GROUP BY 1, 2 UNION ALL SELECT NULL, s, count(*), count(*) FILTER (WHERE new) FROM e GROUP BY s) SELECT artifact_shard, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(new) AS BIGINT) AS new_first_seen_24h, string_agg(concat(s, ':', n), ',' ORDER BY s) AS counts FROM n GROUP BY artifact_shard")
def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: exported rows, new ones and sources, by shard and in all."""
    e = from_sql(spark, sf_dir, ["orders"], f"WITH {_EXPORTED} SELECT * FROM exported".replace("id // 1000", "id DIV 1000"))
    out = quality.export_summary(e, F.expr("TIMESTAMP '1995-01-02 00:00:00'").cast(e.schema["first_seen_at_utc"].dataType))
    counts = F.array_join(F.transform(F.map_entries("source_type_counts"), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return out.select("artifact_shard", "rows", "new_first_seen_24h", counts.alias("counts"))


_CALLS = """calls AS (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('{"input_tokens": ', CAST(event_id % 900 AS VARCHAR(20)), ', "output_tokens": null}') WHEN 2 THEN concat('{"output_tokens": ', CAST(event_id % 70 AS VARCHAR(20)), ', "total_tokens": ', CAST(event_id AS VARCHAR(20)), '}') ELSE '{"total_tokens": "n/a", "reasoning_tokens": 7}' END AS usage FROM events)"""


@query("SELECT user_id, count(*) AS calls, CAST(sum(CASE WHEN event_id % 4 = 1 THEN event_id % 900 ELSE 0 END) AS BIGINT) AS input_tokens, CAST(0 AS BIGINT) AS cached_input_tokens, CAST(sum(CASE WHEN event_id % 4 = 2 THEN event_id % 70 ELSE 0 END) AS BIGINT) AS output_tokens, CAST(sum(CASE WHEN event_id % 4 = 3 THEN 7 ELSE 0 END) AS BIGINT) AS reasoning_tokens, CAST(sum(CASE WHEN event_id % 4 = 2 THEN event_id ELSE 0 END) AS BIGINT) AS total_tokens FROM events GROUP BY user_id")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that the calls of a screen used, where some say nothing."""
    return quality.usage_totals(from_sql(spark, sf_dir, ["events"], f"WITH {_CALLS} SELECT * FROM calls"), ["user_id"])


_ICIMS = """raws AS (SELECT p_partkey AS id, concat('{"data": {"slug": "s', CAST(p_partkey AS VARCHAR(20)), '", ', CASE WHEN p_size % 3 > 0 THEN concat('"req_id": "r', CAST(p_partkey AS VARCHAR(20)), '", ') ELSE '' END, '"title": "', p_name, '", "description": "<p>About ', p_brand, '</p>", ', CASE WHEN p_size % 2 = 0 THEN '"qualifications": "<ul><li>SQL</li></ul>", ' ELSE '' END,
    CASE p_size % 4 WHEN 0 THEN '"location_name": "Ulm, DE", ' WHEN 1 THEN '"city": "Bonn", "state": " ", "country": "DE", ' ELSE '' END, '"categories": [{"name": "', p_type, '"}, {"name": "', p_type, '"}], "posted_date": "2024-01-02", "apply_url": "https://c/', CAST(p_partkey AS VARCHAR(20)), '"}}') AS raw_json, p_size, p_name, p_brand, p_type FROM part)"""


@query(f"WITH {_ICIMS} SELECT CASE WHEN p_size % 3 > 0 THEN concat('r', id) ELSE concat('s', id) END AS source_job_id, p_name AS title, p_type AS department, CASE p_size % 4 WHEN 0 THEN 'Ulm, DE' WHEN 1 THEN 'Bonn, DE' END AS location_name, concat('About ', p_brand, CASE WHEN p_size % 2 = 0 THEN concat(chr(10), chr(10), '- SQL') ELSE '' END) AS content_text, concat('https://c/', id) AS job_url, '2024-01-02' AS posted_at FROM raws")
def icims_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iCIMS' JSON to posting records."""
    p = postings.icims(from_sql(spark, sf_dir, ["part"], f"WITH {_ICIMS} SELECT * FROM raws"))
    return p.select("source_job_id", "title", "department", "location_name", "content_text", "job_url", "posted_at")


@query(f"WITH {JOBS_SQL} SELECT id, trim(title) AS title, source_company AS company, CASE WHEN id % 2 = 0 THEN 'Ulm' ELSE '' END AS location, '' AS work_arrangement, concat('https://c/', id) AS url, CASE WHEN posted_at_utc IS NULL THEN '' ELSE strftime(posted_at_utc, '%b %-d, %Y') END AS posted_display FROM jobs WHERE trim(title) <> ''")
def feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what a feed shows of postings; those without a title are not shown."""
    j = jobs(spark, sf_dir).withColumns({"company_name": F.lit(""), "location": F.when(F.col("id") % 2 == 0, F.lit(" Ulm ")), "job_url": F.concat(F.lit("https://c/"), F.col("id").cast("string")), "posted_at_utc": F.col("posted_at_utc").cast("timestamp")})
    return display.rows(j, F.expr("TIMESTAMP '2024-06-01 00:00:00'"), keep=["id"])
