"""Queries of connectors: pages, listings, details, endpoints and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, text
from ..operators import lifecycle, quality
from ..session import dealt
from ..sources import boards, pages, postings
from .registry import query, table
from .shapes import JOBS_SQL, from_sql, jobs

_PAGES = "pages_of AS (SELECT c_custkey AS id, concat('<html><head><title>T</title></head><body><nav>Menu</nav><div class=\"a job-description b\"><p>Short&nbsp;one</p></div><main><h1>', c_name, '</h1><script>if (a < b) { x(); }</script><form>Apply <button>now</button></form><p>', repeat(concat(c_mktsegment, '  experience &amp; skills '), CAST(c_custkey % 30 AS INT)), '</p>line one<br>line two</main><p>Foot</p></body></html>') AS html, c_name, c_mktsegment FROM customer)"
_MAIN = "concat(c_name, CASE WHEN id % 30 > 0 THEN concat(chr(10), trim(repeat(concat(c_mktsegment, ' experience & skills '), CAST(id % 30 AS INT)))) ELSE '' END, chr(10), 'line one', chr(10), 'line two')"


@query(f"WITH {_PAGES}, t AS (SELECT id, {_MAIN} AS main FROM pages_of), b AS (SELECT id, main, concat('Menu', chr(10), 'Short', chr(160), 'one', chr(10), main, chr(10), 'Foot') AS raw FROM t), c AS (SELECT id, main, replace(raw, chr(160), ' ') AS body FROM b) SELECT id, CASE WHEN length(main) >= 300 AND contains(main, 'experience') THEN main WHEN length(body) >= 300 AND contains(body, 'experience') THEN body ELSE '' END AS description FROM c")
def page_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest text of a page that reads like a description."""
    p = dealt(from_sql(spark, sf_dir, ["customer"], f"WITH {_PAGES} SELECT * FROM pages_of").select("id", "html"), "id").withColumn("t", pages.node_texts(F.col("html")))
    return p.select("id", pages.description(F.col("t")).alias("description"))


_SITES = "sites AS (SELECT s_suppkey AS id, concat('https://t', s_suppkey, '.wd5.myworkdayjobs.com/', CASE s_suppkey % 3 WHEN 0 THEN 'de-DE/' WHEN 1 THEN '' ELSE 'en-US/x/' END, 'Careers') AS url, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('/job/', s_suppkey) WHEN 2 THEN concat('job/', s_suppkey) ELSE concat('https://y/', s_suppkey) END AS path, concat('https://apply.workable.com/', CASE s_suppkey % 3 WHEN 0 THEN concat('company/z/jobs-at-c', s_suppkey) WHEN 1 THEN concat('c', s_suppkey, '/') ELSE 'company/' END) AS board FROM supplier)"


@query(f"WITH {_SITES}, b AS (SELECT *, concat('https://t', id, '.wd5.myworkdayjobs.com') AS site, CASE WHEN id % 3 = 0 THEN 'de-DE' ELSE 'en-US' END AS locale FROM sites) SELECT id, concat(site, '/wday/cxs/t', id, '/Careers/jobs') AS endpoint, CASE id % 4 WHEN 0 THEN concat(site, '/', locale, '/Careers') WHEN 3 THEN path ELSE concat(site, '/', locale, '/Careers/job/', id) END AS detail, CASE id % 3 WHEN 2 THEN 'apply.workable.com' ELSE concat('c', id) END AS company FROM b")
def board_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints and postings' pages of a Workday site, and the company of a Workable listing."""
    s = from_sql(spark, sf_dir, ["supplier"], f"WITH {_SITES} SELECT * FROM sites")
    return s.select("id", boards.workday_endpoint(F.col("url")).alias("endpoint"), boards.workday_detail(F.col("url"), F.col("path")).alias("detail"), boards.workable_company(F.col("board")).alias("company"))


_LD = """ld AS (SELECT p_partkey AS id, p_name, p_brand, p_size, concat('<script>var a = 1;</script><script type="application/ld+json">{ not json</script><SCRIPT id=x type=''application/ld+json''>', CASE p_size % 3 WHEN 0 THEN '{"@graph": [{"@type": "WebPage"}, [' WHEN 1 THEN '[{"@type": "Thing"}, ' ELSE '' END, '{"@type": ', CASE WHEN p_size % 2 = 0 THEN '["Thing", "JobPosting"]' ELSE '"JobPosting"' END, ', "title": "', p_name, '", "identifier": ', CASE WHEN p_size % 2 = 0 THEN concat('{"value": " i', p_partkey, ' "}') ELSE concat('"j', p_partkey, '"') END, ', "hiringOrganization": {"name": "', p_brand, '"}, "jobLocation": ', CASE WHEN p_size % 2 = 0 THEN '{"address": {"addressLocality": "Ulm", "addressRegion": " ", "addressCountry": "DE"}}' ELSE '[{"name": "Bonn"}, {"address": {"addressLocality": "Ulm"}}, {"name": "Bonn"}, {"name": ""}]' END, '}', CASE p_size % 3 WHEN 0 THEN ']]}' WHEN 1 THEN ']' ELSE '' END, '</SCRIPT>') AS html FROM part)"""


@query(f"WITH {_LD} SELECT id, p_name AS title, concat(CASE WHEN p_size % 2 = 0 THEN 'i' ELSE 'j' END, id) AS source_job_id, p_brand AS company, CASE WHEN p_size % 2 = 0 THEN 'Ulm, DE' ELSE 'Bonn | Ulm' END AS places FROM ld")
def json_ld_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posting in a page's structured data, in lists and graphs."""
    p = from_sql(spark, sf_dir, ["part"], f"WITH {_LD} SELECT * FROM ld").withColumn("j", pages.job_posting(F.col("html")))
    j = F.col("j")
    return p.select("id", F.get_json_object(j, "$.title").alias("title"), pages.posting_id(j).alias("source_job_id"), pages.posting_company(j).alias("company"), pages.posting_places(j).alias("places"))


_STATE = "states AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN '<script>nothing</script>' ELSE concat('<script>window.jobBoard = { other: {}, initialState: {\"api\": {\"id\": ', s_suppkey, ', \"status\": ', CASE WHEN s_suppkey % 2 = 0 THEN '200' ELSE '404' END, '}, \"n\": {}} };</script>') END AS html FROM supplier)"


@query(f"WITH {_STATE} SELECT id, CASE WHEN id % 5 <> 0 THEN id END AS state_id, coalesce(id % 5 <> 0 AND id % 2 = 0, false) AS usable FROM states")
def initial_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state a board embeds in a page, and whether it is usable (else its API is asked)."""
    s = from_sql(spark, sf_dir, ["supplier"], f"WITH {_STATE} SELECT * FROM states").withColumn("j", pages.initial_state(F.col("html")))
    return s.select("id", F.get_json_object("j", "$.api.id").cast("long").alias("state_id"), F.coalesce(F.get_json_object("j", "$.api.status") == "200", F.lit(False)).alias("usable"))


@query("WITH l AS (SELECT p_partkey AS id, p_name AS title, p_brand AS department, CASE p_size % 4 WHEN 0 THEN 'draft' WHEN 1 THEN NULL ELSE 'published' END AS state FROM part), d AS (SELECT ps AS id, concat('detail ', ps) AS title, CASE WHEN ps % 2 = 0 THEN ' ' ELSE 'D' END AS department FROM (SELECT s_suppkey * 3 AS ps FROM supplier)) SELECT l.id, coalesce(d.title, l.title) AS title, CASE WHEN d.department = 'D' THEN 'D' ELSE l.department END AS department FROM l LEFT JOIN d ON d.id = l.id WHERE coalesce(l.state, 'published') = 'published'")
def details_over_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published rows of a listing, with what their details say first."""
    listed = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS title", "p_brand AS department", "CASE p_size % 4 WHEN 0 THEN 'draft' WHEN 1 THEN NULL ELSE 'published' END AS state")
    d = table(spark, sf_dir, "supplier").selectExpr("s_suppkey * 3 AS id", "concat('detail ', s_suppkey * 3) AS title", "CASE WHEN s_suppkey * 3 % 2 = 0 THEN ' ' ELSE 'D' END AS department")
    return boards.with_details(listed, d, "id", ["title", "department"], "state").select("id", "title", "department")


@query(f"WITH {JOBS_SQL}, r AS (SELECT id, source_company, content_text, id % 2 = 0 AS same, coalesce(trim(content_text), '') <> '' AS known FROM jobs), n AS (SELECT *, sum(CASE WHEN known AND same THEN 0 ELSE 1 END) OVER (PARTITION BY source_company ORDER BY id) AS k FROM r) SELECT id, CASE WHEN known AND same THEN 'reuse' WHEN k <= 20 THEN 'fetch' WHEN known THEN 'keep' ELSE 'seen' END AS listing_class FROM n")
def listing_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which listed postings are reused, fetched (20 a source), kept, or only seen."""
    return boards.classified(jobs(spark, sf_dir), "source_company", "id", "content_text", F.col("id") % 2 == 0, 20).select("id", "listing_class")


_ICIMS = """payloads AS (SELECT p_partkey AS id, CASE p_size % 7 WHEN 0 THEN '{}' WHEN 1 THEN '{"jobs": []}' WHEN 2 THEN '{"jobs": [{}]}' WHEN 3 THEN '{"jobs": [{"data": {"ats_code": "icims"}}]}' WHEN 4 THEN '{"jobs": [{"data": {"meta_data": {"icims": {}}}}]}' WHEN 5 THEN '{"jobs": [{"data": {"ats_code": "other"}}]}' ELSE '{"jobs": {"a": 1}}' END AS raw, CASE p_size % 3 WHEN 0 THEN concat('{"slug": "s', p_partkey, '", "meta_data": {"canonical_url": " https://c/', p_partkey, ' "}}') WHEN 1 THEN concat('{"slug": "", "req_id": "r', p_partkey, '"}') ELSE '{"title": "t"}' END AS data, concat('https://jobs.x.com', CASE WHEN p_size % 2 = 0 THEN '/careers/?page=2' ELSE '' END) AS url, p_size FROM part)"""


@query(f"WITH {_ICIMS} SELECT id, CASE p_size % 7 WHEN 0 THEN 'jobs is no list' WHEN 6 THEN 'jobs is no list' WHEN 2 THEN 'no data object' WHEN 5 THEN 'no provider marker' END AS fault, CASE p_size % 3 WHEN 0 THEN concat('https://c/', id) WHEN 1 THEN concat('https://jobs.x.com/', CASE WHEN p_size % 2 = 0 THEN 'careers' ELSE 'jobs' END, '/r', id, '?lang=en-us') END AS job_url FROM payloads")
def payload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that are refused, and the public URL of a job."""
    p = from_sql(spark, sf_dir, ["part"], f"WITH {_ICIMS} SELECT * FROM payloads")
    return p.select("id", boards.payload_fault(F.col("raw")).alias("fault"), boards.public_url(F.col("data"), F.col("url")).alias("job_url"))


@query("SELECT concat('ashby:', c_custkey) AS job_id, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN concat('Ulm | n', c_nationkey) ELSE 'Ulm' END AS location_name, CASE WHEN c_custkey % 3 = 0 THEN 'From HTML' ELSE concat('Plain ', c_mktsegment) END AS content_text FROM customer")
def ashby_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ashby's JSON to posting records."""
    c = table(spark, sf_dir, "customer")
    nation = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    raw = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.lit("Ulm").alias("location"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.struct(nation.alias("location")), F.struct(F.lit("Ulm").alias("location")))).alias("secondaryLocations"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("Plain "), F.col("c_mktsegment"))).alias("descriptionPlain"), F.lit("<p>From <b>HTML</b></p>").alias("descriptionHtml")))
    j = postings.ashby(c.select(raw.alias("raw_json")))
    return j.select(F.concat_ws(":", "source_type", "source_job_id").alias("job_id"), "title", "location_name", "content_text")


@query("SELECT concat('lever:l', s_suppkey) AS job_id, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'Dept' ELSE 'Team' END AS department, concat('Open', chr(10), chr(10), 'You do', chr(10), 'Things ', s_suppkey) AS content_text, strftime(make_timestamp(CAST(1700000000 + s_suppkey AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS posted_at FROM supplier")
def lever_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lever's JSON to posting records, times from milliseconds."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    team = F.struct(F.lit("Team").alias("team"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("Dept")).alias("department"))
    lists = F.array(F.struct(F.lit("You do").alias("text"), F.concat(F.lit("<p>Things "), key, F.lit("</p>")).alias("content")))
    raw = F.to_json(F.struct(F.concat(F.lit("l"), key).alias("id"), F.col("s_name").alias("text"), team.alias("categories"), F.lit("Open").alias("openingPlain"), lists.alias("lists"), ((F.col("s_suppkey") + 1700000000) * 1000 + 123).alias("createdAt")))
    j = postings.lever(s.select(raw.alias("raw_json")))
    return j.select(F.concat_ws(":", "source_type", "source_job_id").alias("job_id"), "title", "department", "content_text", "posted_at")


@query("SELECT concat('workable:w', p_partkey) AS job_id, p_name AS title, concat('Ulm, ', CASE WHEN p_size % 2 = 0 THEN 'Sub' ELSE 'Reg' END, ', DE') AS location_name, concat('About ', p_brand, chr(10), chr(10), 'Skills') AS content_text FROM part WHERE p_size % 5 <> 0")
def workable_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workable's published jobs to posting records."""
    p = table(spark, sf_dir, "part")
    place = F.struct(F.lit("Ulm").alias("city"), F.when(F.col("p_size") % 2 == 0, F.lit("Sub")).otherwise(F.lit(" ")).alias("subregion"), F.lit("Reg").alias("region"), F.lit("DE").alias("country"))
    raw = F.to_json(F.struct(F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("shortcode"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 5 == 0, F.lit("draft")).when(F.col("p_size") % 5 == 1, F.lit("published")).alias("state"), place.alias("location"), F.concat(F.lit("<p>About "), F.col("p_brand"), F.lit("</p>")).alias("description"), F.lit("Skills").alias("requirements")))
    j = postings.workable(p.select(raw.alias("raw_json")))
    return j.select(F.concat_ws(":", "source_type", "source_job_id").alias("job_id"), "title", "location_name", "content_text")


@query(f"WITH {JOBS_SQL} SELECT id, row_number() OVER (ORDER BY coalesce(posted_at_utc, TIMESTAMP '1990-01-01') DESC, id DESC) AS place FROM jobs WHERE is_active AND coalesce(trim(content_text), '') IN ('', 'nan') AND NOT (id % 6 >= 3 AND id % 4 = 0) AND (source_type IS NULL OR source_type <> 'greenhouse' OR coalesce(posted_at_utc, TIMESTAMP '1990-01-01') >= TIMESTAMP '1995-01-01') QUALIFY place <= 500")
def fetch_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 500 pages to fetch (a batch): active, without text, not backing off, direct sources only if recent."""
    from pyspark.sql import Window

    now, old = F.lit("1995-02-01").cast("timestamp"), F.lit("1990-01-01").cast("timestamp")
    j = jobs(spark, sf_dir)
    at = F.coalesce(F.col("posted_at_utc").cast("timestamp"), old)
    last = F.when(F.col("id") % 4 == 0, now - F.expr("interval 1 hour"))
    blank = ~F.coalesce(text.usable(F.col("content_text")), F.lit(False))
    direct = F.col("source_type").isNull() | (F.col("source_type") != "greenhouse") | (at >= now - F.expr("interval 31 days"))
    open_ = j.filter(F.col("is_active") & blank & ~lifecycle.backing_off(F.col("id") % 6, last, now, 3, 24) & direct)
    top = open_.orderBy(F.desc(at), F.desc("id")).limit(500)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc(at), F.desc("id"))).cast("long").alias("place"))  # 500 rows


@query(f"WITH {JOBS_SQL}, r AS (SELECT CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'one line' WHEN 2 THEN repeat('x', 150) WHEN 3 THEN concat(repeat('y', 60), chr(10), 'z') ELSE repeat('long ', 60) END AS r FROM jobs) SELECT count(*) FILTER (WHERE r IS NULL) AS empty, count(*) FILTER (WHERE length(r) < 120) AS short, count(*) FILTER (WHERE length(r) < 200 AND NOT contains(r, chr(10))) AS generic FROM r")
def requirement_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many extracted requirements are empty, short or a single short line."""
    r = jobs(spark, sf_dir).select(F.expr("CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'one line' WHEN 2 THEN repeat('x', 150) WHEN 3 THEN concat(repeat('y', 60), '\n', 'z') ELSE repeat('long ', 60) END").alias("r"))
    return extract.requirement_stats(r, "r")


@query("SELECT status, n, row_number() OVER (ORDER BY status = 'unknown', TRY_CAST(status AS INT)) AS place FROM (SELECT coalesce(CAST(CASE user_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN 1000 END AS VARCHAR), 'unknown') AS status, count(*) AS n FROM events GROUP BY 1)")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by status, in numeric order, unknown ones last."""
    e = table(spark, sf_dir, "events").select(F.expr("CASE user_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN 1000 END").alias("code"))
    return quality.status_counts(e, "code")
