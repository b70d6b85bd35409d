"""Queries of lifecycle, quality and hard-filter operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..functions.text import fingerprint, trimmed
from ..operators import filters, lifecycle, quality
from ..session import new_folder
from .registry import query, table
from .shapes import JOBS_SQL, jobs

NOW = "TIMESTAMP '2001-07-01 12:00:00'"
_ELIGIBLE = "(is_active AND trim(content_text) <> '' AND lower(trim(content_text)) NOT IN ('nan', 'none', 'null') AND posted_at_utc IS NOT NULL AND location_parse_status IN ('parsed', 'country_only', 'remote', 'multi_location', 'city_resolved'))"


def _eligible(df: DataFrame) -> DataFrame:
    return df.filter(lifecycle.eligible(F.col("is_active"), F.col("content_text"), F.col("posted_at_utc"), F.col("location_parse_status")))


@query(f"WITH {JOBS_SQL}, r AS (SELECT id, posted_at_utc, row_number() OVER (ORDER BY posted_at_utc DESC, id DESC) - 1 AS recency FROM jobs WHERE {_ELIGIBLE}) SELECT id, posted_at_utc, CAST(recency AS BIGINT) AS recency, CAST(recency // 100 AS BIGINT) AS artifact_shard FROM r WHERE recency < 1000")
def recency_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 1000 eligible postings in shards of 100."""
    out = lifecycle.newest_shards(_eligible(jobs(spark, sf_dir)), "posted_at_utc", "id", 100, 1000)
    return out.select("id", "posted_at_utc", F.col("recency").cast("long").alias("recency"), "artifact_shard")


@query(f"WITH {JOBS_SQL}, r AS (SELECT id, is_active, posted_at_utc, row_number() OVER (ORDER BY posted_at_utc DESC, id DESC) - 1 AS recency FROM jobs WHERE posted_at_utc IS NOT NULL), s AS (SELECT *, recency // 200 AS shard FROM r), n AS (SELECT shard, count(*) FILTER (WHERE is_active AND id % 3 = 0) AS k FROM s GROUP BY shard), b AS (SELECT shard, coalesce(sum(k) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n WHERE k > 0) SELECT id, CAST(s.shard AS BIGINT) AS shard FROM s JOIN b ON s.shard = b.shard WHERE before < 250 AND is_active AND id % 3 = 0")
def early_stop_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors of shards, up to the one that makes 250; later shards are not read."""
    path = new_folder(spark, "shards")
    s = lifecycle.newest_shards(jobs(spark, sf_dir), "posted_at_utc", "id", 200)
    s.select("id", "is_active", "artifact_shard").repartition("artifact_shard").write.partitionBy("artifact_shard").parquet(path)
    s = spark.read.parquet(path)
    shards = sorted(r[0] for r in s.select("artifact_shard").distinct().collect())  # the export's manifest
    out = lifecycle.read_until(s, "artifact_shard", shards, F.col("is_active") & (F.col("id") % 3 == 0), 250)
    return out.select("id", F.col("artifact_shard").cast("long").alias("shard"))


@query(f"WITH {JOBS_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY coalesce(posted_at_utc, TIMESTAMP '1990-01-01'), id) AS k, count(*) OVER () AS n FROM jobs WHERE is_active) SELECT id, k <= least(500, n - 2000) AS cleaned FROM r")
def cleanup_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest rows past those to keep, at most 500, lose their vectors."""
    r = jobs(spark, sf_dir).filter("is_active").withColumn("at", F.coalesce("posted_at_utc", F.lit("1990-01-01").cast("timestamp")))
    extra = r.agg(F.least(F.lit(500), F.count("*") - 2000).alias("_budget"))
    old = lifecycle.newest_shards(r.withColumns({"at": F.timestamp_micros(-F.unix_micros("at")), "_id": -F.col("id")}), "at", "_id", 1)
    return old.join(F.broadcast(extra)).select("id", (F.col("recency") < F.col("_budget")).alias("cleaned"))


@query(f"WITH {JOBS_SQL} SELECT id, yoe_version FROM jobs WHERE yoe_version IS DISTINCT FROM 'v1'")
def pending_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows whose derivation is out of date."""
    return jobs(spark, sf_dir).filter(lifecycle.pending(F.col("yoe_version"), "v1")).select("id", "yoe_version")


_OLD = "old AS (SELECT o_orderkey AS id, o_totalprice AS price, o_orderpriority AS title, CAST(o_custkey AS VARCHAR) AS derived, o_orderdate AS first_seen FROM orders WHERE o_orderkey % 3 <> 0)"
_NEW = "new AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price, o_orderpriority AS title, TIMESTAMP '2002-01-01' AS first_seen FROM orders WHERE o_orderkey % 5 <> 0)"


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    old = o.filter("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS id", "o_totalprice AS price", "o_orderpriority AS title", "cast(o_custkey AS string) AS derived", "o_orderdate AS first_seen")
    new = o.filter("o_orderkey % 5 <> 0").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price", "o_orderpriority AS title", "cast('2002-01-01' AS timestamp_ntz) AS first_seen")
    return old, new.withColumn("first_seen", F.col("first_seen").cast(dict(old.dtypes)["first_seen"]))


@query(f"WITH {_OLD}, {_NEW} SELECT coalesce(old.id, new.id) AS id, CASE WHEN new.id IS NOT NULL THEN new.price ELSE old.price END AS price, CASE WHEN new.id IS NOT NULL THEN new.title ELSE old.title END AS title, CASE WHEN old.id IS NOT NULL AND new.id IS NOT NULL AND old.price IS DISTINCT FROM new.price THEN NULL ELSE derived END AS derived, coalesce(old.first_seen, new.first_seen) AS first_seen FROM old FULL JOIN new ON old.id = new.id")
def upsert_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge that keeps first_seen and resets what a changed price invalidates."""
    old, new = _old_new(spark, sf_dir)
    return lifecycle.upsert(old, new, ["id"], keep=["first_seen"], reset={"derived": ["price"]})


@query(f"WITH {_OLD}, {_NEW} SELECT new.id, new.price FROM new LEFT JOIN old ON old.id = new.id WHERE old.id IS NULL OR old.price <> new.price")
def changed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows whose fingerprint differs from the stored one."""
    old, new = (d.withColumn("fingerprint", fingerprint(F.col("price"), F.col("title"))) for d in _old_new(spark, sf_dir))
    return lifecycle.changed_only(new, old, ["id"]).select("id", "price")


@query(f"WITH seen AS (SELECT DISTINCT c_nationkey, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND c_nationkey < 20) SELECT c.c_custkey AS id, NOT (c.c_nationkey < 20 AND s.o_custkey IS NULL AND c.c_custkey % 4 <> 0) AND c.c_custkey % 4 <> 0 AS is_active, CASE WHEN c.c_nationkey < 20 AND s.o_custkey IS NULL AND c.c_custkey % 4 <> 0 THEN {NOW} END AS missing_at FROM customer c LEFT JOIN seen s ON s.c_nationkey = c.c_nationkey AND s.o_custkey = c.c_custkey")
def mark_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation that its orders do not name become inactive."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_nationkey AS nation", "c_custkey % 4 <> 0 AS is_active", "cast(NULL AS timestamp_ntz) AS missing_at")
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    seen = o.join(c.select("id", "nation").filter("nation < 20"), "id").select("nation", "id")
    return lifecycle.mark_missing(c, seen, ["nation"], "id", F.expr(NOW).cast("timestamp_ntz")).select("id", "is_active", "missing_at")


@query("WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 404 WHEN 'signup' THEN 500 ELSE 200 END AS code FROM events), l AS (SELECT user_id, max(CASE WHEN code <> 404 THEN event_id ELSE -1 END) AS ok, max(event_id) AS last FROM e GROUP BY user_id) SELECT e.user_id AS source, any_value(z.ts) AS last_get_at, any_value(z.code) AS last_http_status_code, count(*) FILTER (WHERE e.event_id > l.ok) AS http_404_streak, any_value(CASE WHEN z.code >= 400 THEN z.ts END) AS last_error_at FROM e JOIN l ON e.user_id = l.user_id JOIN e z ON z.event_id = l.last GROUP BY e.user_id")
def source_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: per source, the last attempt and how many 404s in a row it ends with."""
    code = F.when(F.col("event_type") == "error", 404).when(F.col("event_type") == "signup", 500).otherwise(200)
    return lifecycle.attempt_streaks(table(spark, sf_dir, "events"), "user_id", "event_id", code, "event_id").join(table(spark, sf_dir, "events").select(F.col("event_id").alias("_e"), "ts"), F.col("last_get_at") == F.col("_e")).select("source", F.col("ts").alias("last_get_at"), "last_http_status_code", "http_404_streak", F.when(F.col("last_error_at").isNotNull(), F.col("ts")).alias("last_error_at"))


@query("SELECT event_id, user_id FROM events WHERE NOT (event_type = 'error' AND value >= 20 AND ts > TIMESTAMP '2024-01-20 00:00:00') AND event_type IN ('error', 'signup')")
def failure_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backlog without rows that failed too often, too recently."""
    now = F.expr("TIMESTAMP '2024-01-31 00:00:00'").cast("timestamp_ntz")
    e = table(spark, sf_dir, "events").filter("event_type IN ('error', 'signup')")
    fails = F.when(F.col("event_type") == "error", F.col("value")).otherwise(0)
    return e.filter(~lifecycle.backing_off(fails, F.col("ts"), now, 20, 264)).select("event_id", "user_id")


@query("SELECT s_suppkey, s_acctbal, CASE WHEN s_suppkey % 6 = 0 THEN 404 ELSE 200 END AS status FROM supplier WHERE NOT (s_suppkey % 6 = 0 AND s_nationkey >= 3)")
def source_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources to read, without those that have been gone for long."""
    s = table(spark, sf_dir, "supplier").withColumn("status", F.when(F.col("s_suppkey") % 6 == 0, 404).otherwise(200))
    return s.filter(~((F.col("status") == 404) & (F.col("s_nationkey") >= 3))).orderBy(F.asc_nulls_first("s_acctbal")).select("s_suppkey", "s_acctbal", "status")


@query(f"WITH {JOBS_SQL} SELECT coalesce(source_type, 'unknown') AS source_type, count(*) AS n, count(*) FILTER (WHERE coalesce(trim(title), '') = '') AS blank_titles, round(100.0 * count(*) FILTER (WHERE posted_at_utc IS NULL) / count(*), 4) AS missing_posted_percent, count(*) FILTER (WHERE coalesce({_ELIGIBLE}, false)) AS eligible FROM jobs GROUP BY 1")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aggregation a source."""
    j = jobs(spark, sf_dir).withColumn("source_type", F.coalesce("source_type", F.lit("unknown")))
    ok = lifecycle.eligible(F.col("is_active"), F.col("content_text"), F.col("posted_at_utc"), F.col("location_parse_status"))
    return j.groupBy("source_type").agg(F.count("*").alias("n"), quality.blanks(F.col("title")).alias("blank_titles"), quality.share(F.col("posted_at_utc").isNull()).alias("missing_posted_percent"), F.count_if(ok).alias("eligible"))


@query("SELECT l_returnflag, count(l_extendedprice) AS n, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, max(l_extendedprice) AS max FROM lineitem GROUP BY l_returnflag")
def dq_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2: exact percentiles of prices."""
    out = quality.numeric_profile(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), ["l_returnflag"])
    return out.withColumns({"p50": F.round("p50", 4), "p90": F.round("p90", 4)})


@query(f"WITH {JOBS_SQL}, t AS (SELECT length(trim(content_text)) AS k FROM jobs WHERE trim(content_text) <> '') SELECT count(*) AS n, round(avg(k), 4) AS avg, round(quantile_cont(k, 0.1), 4) AS p10, round(quantile_cont(k, 0.5), 4) AS p50, round(quantile_cont(k, 0.9), 4) AS p90 FROM t")
def dq_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: lengths of posting texts."""
    out = quality.length_profile(jobs(spark, sf_dir), F.col("content_text"))
    return out.select("n", *[F.round(c, 4).alias(c) for c in ("avg", "p10", "p50", "p90")])


@query("WITH k AS (SELECT o_custkey, count(*) AS c FROM orders GROUP BY 1) SELECT count(*) AS n, round(avg(c), 4) AS avg, round(quantile_cont(c, 0.1), 4) AS p10, round(quantile_cont(c, 0.5), 4) AS p50, round(quantile_cont(c, 0.9), 4) AS p90 FROM k")
def dq_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: postings per company."""
    k = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("c"))
    return quality.count_profile(k, F.col("c")).select("n", *[F.round(c, 4).alias(c) for c in ("avg", "p10", "p50", "p90")])


@query("SELECT count(text) - count(DISTINCT text) AS duplicates FROM documents WHERE trim(text) <> ''")
def fingerprint_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents repeat another's text, by fingerprint."""
    d = table(spark, sf_dir, "documents").filter(trimmed(F.col("text")) != "")
    return quality.duplicates(d, fingerprint(F.col("text")))


@query("SELECT event_type, CAST(event_type = 'error' AS INTEGER) AS failed, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by kind, null-safe sums."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.max((F.col("event_type") == "error").cast("int")).alias("failed"), F.count("*").alias("n"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("total"))


@query(f"WITH {JOBS_SQL} SELECT id, min_years_experience FROM jobs WHERE try_cast(min_years_experience AS DOUBLE) IS NULL OR try_cast(min_years_experience AS DOUBLE) <= 5")
def yoe_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """at most five years asked for; unknown passes."""
    return filters.within_experience(jobs(spark, sf_dir), 5).select("id", "min_years_experience")


@query(f"WITH {JOBS_SQL} SELECT id FROM jobs WHERE coalesce(lower(trim(requires_clearance)), '') IN ('', 'false', '0', 'no', 'none', 'null', 'nan') AND coalesce(lower(trim(clearance_type)), '') IN ('', 'false', '0', 'no', 'none', 'null', 'nan')")
def clearance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """postings without any sign of a clearance."""
    return filters.without_clearance(jobs(spark, sf_dir)).select("id")


@query(f"WITH {JOBS_SQL} SELECT id, posted_at_utc FROM jobs WHERE posted_at_utc BETWEEN {NOW} - INTERVAL 2000 HOUR AND {NOW}")
def recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posted within a window, both ends in."""
    j = jobs(spark, sf_dir)
    return filters.recent(j, F.expr(NOW).cast(dict(j.dtypes)["posted_at_utc"]), 2000).select("id", "posted_at_utc")


_GEO = "geo AS (SELECT s_suppkey AS id, CASE s_nationkey % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' WHEN 2 THEN NULL WHEN 3 THEN 'GB' ELSE NULL END AS seg, CASE s_nationkey % 3 WHEN 0 THEN 'MA' WHEN 1 THEN 'CA' END AS region, CASE s_nationkey % 4 WHEN 0 THEN 'us' WHEN 1 THEN ' ' ELSE NULL END AS country, CASE s_nationkey % 6 WHEN 0 THEN 'Boston, USA' WHEN 1 THEN 'Remote - United States' ELSE 'Toronto' END AS name FROM supplier)"


@query(f"WITH {_GEO} SELECT id FROM geo WHERE CASE WHEN seg IS NOT NULL THEN seg = 'US' WHEN trim(country) <> '' THEN upper(trim(country)) = 'US' ELSE regexp_matches(name, '(?i)(^|[^a-z])(united states|usa)($|[^a-z])') END")
def hard_filter_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """postings in the United States, by segments, country, then text."""
    from .shapes import from_sql

    g = from_sql(spark, sf_dir, ["supplier"], f"WITH {_GEO} SELECT * FROM geo")
    seg = F.array(F.struct(F.col("seg").alias("country"), F.col("region")))
    return g.filter(filters.in_country(seg, F.col("country"), F.col("name"), "United States")).select("id")


@query(f"WITH {_GEO} SELECT id FROM geo WHERE coalesce(seg = 'US' AND region = 'MA', false)")
def hard_filter_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state holds only for postings with a region of the United States."""
    from .shapes import from_sql

    g = from_sql(spark, sf_dir, ["supplier"], f"WITH {_GEO} SELECT * FROM geo")
    seg = F.array(F.struct(F.col("seg").alias("country"), F.col("region")))
    return g.filter(filters.in_country(seg, F.col("country"), F.col("name"), "US", "MA")).select("id")


@query(f"WITH {JOBS_SQL} SELECT id FROM jobs WHERE (try_cast(min_years_experience AS DOUBLE) IS NULL OR try_cast(min_years_experience AS DOUBLE) <= 8) AND coalesce(lower(trim(requires_clearance)), '') <> 'true' AND clearance_type IS NULL AND posted_at_utc BETWEEN {NOW} - INTERVAL 9000 HOUR AND {NOW}")
def hard_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """all hard filters in their order; one scan."""
    j = jobs(spark, sf_dir)
    j = filters.without_clearance(filters.within_experience(j, 8))
    return filters.recent(j, F.expr(NOW).cast(dict(j.dtypes)["posted_at_utc"]), 9000).select("id")


_SHOWN = """CASE WHEN s < 0 THEN d WHEN s < 3600 THEN 'just now' WHEN s < 86400 THEN CASE WHEN s // 3600 = 1 THEN '1 hour ago' ELSE concat(s // 3600, ' hours ago') END
 WHEN s // 86400 = 1 THEN 'yesterday' WHEN s // 86400 < 30 THEN concat(s // 86400, ' days ago') WHEN s // 86400 < 365 THEN CASE WHEN s // 86400 // 30 = 1 THEN '1 month ago' ELSE concat(s // 86400 // 30, ' months ago') END ELSE d END"""


@query(f"WITH t AS (SELECT event_id, CAST(floor(epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(ts)) AS BIGINT) AS s, strftime(ts, '%b %-d, %Y') AS d FROM events) SELECT event_id, {_SHOWN} AS shown FROM t")
def posted_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long ago, in words."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", times.shown(ts, F.expr("TIMESTAMP '2024-01-30 12:00:00'")).alias("shown"))


_WRITTEN = "written AS (SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN concat('Posted ', o_custkey % 40, ' Days Ago') WHEN 1 THEN concat(o_custkey % 30, '+ hours ago') WHEN 2 THEN 'Posted Today' WHEN 3 THEN 'yesterday' WHEN 4 THEN concat('2024-0', 1 + o_custkey % 9, '-1', o_custkey % 10, 'T08:00:00Z') WHEN 5 THEN concat('2 weeks from ', o_custkey) ELSE NULL END AS posted, o_custkey FROM orders)"


@query(f"WITH {_WRITTEN} SELECT id, CASE id % 7 WHEN 0 THEN TIMESTAMP '2026-06-07 18:30:00' - to_days(CAST(o_custkey % 40 AS INTEGER)) WHEN 1 THEN TIMESTAMP '2026-06-07 18:30:00' - to_hours(CAST(o_custkey % 30 AS INTEGER)) WHEN 2 THEN TIMESTAMP '2026-06-07 18:30:00' WHEN 3 THEN TIMESTAMP '2026-06-06 18:30:00' WHEN 4 THEN strptime(posted, '%Y-%m-%dT%H:%M:%SZ') END AS posted_at, CASE WHEN id % 7 < 5 THEN 'normalized' ELSE 'unparseable' END AS status, CASE id % 7 WHEN 5 THEN 'unrecognized_format' WHEN 6 THEN 'missing' END AS reason FROM written")
def posted_at_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute dates, else relative to the time of fetching."""
    from .shapes import from_sql

    w = from_sql(spark, sf_dir, ["orders"], f"WITH {_WRITTEN} SELECT * FROM written")
    p = times.posted_at(F.col("posted"), F.expr("TIMESTAMP '2026-06-07 18:30:00'"))
    w = w.withColumn("p", p)
    return w.select("id", F.col("p.at").cast("timestamp_ntz").alias("posted_at"), F.col("p.status").alias("status"), F.col("p.reason").alias("reason"))
