"""Queries of records, files, shards, profiles and what surrounds a ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import STOP_WORDS
from ..operators import artifacts, features, filters, lifecycle, matching, quality, ranking
from ..session import new_folder
from ..sources import files, postings
from .registry import query, table
from .shapes import JOBS_SQL, METRICS_SQL, RESULTS_SQL, from_sql, jobs, metrics, results

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_WORDS = "regexp_extract_all(lower({0}), '[a-z]+(?:''[a-z]+)?')"

_SEEN = """seen AS (SELECT c_custkey AS id, c_custkey % 5 <> 0 AS stored, c_custkey % 3 <> 0 AS fetched,
    CASE WHEN c_custkey % 2 = 0 THEN concat('S', CAST(c_custkey AS VARCHAR(20))) ELSE '' END AS said,
    CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('D', CAST(c_custkey AS VARCHAR(20))) END AS detailed,
    CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE 'Ulm' END AS place FROM customer)"""


@query(f"""WITH {_SEEN} SELECT id, CASE WHEN stored THEN concat('old-', id) WHEN fetched THEN concat('ld-', id) ELSE concat('/job/', id) END AS source_job_id,
    CASE WHEN fetched AND detailed <> '' THEN detailed WHEN said <> '' THEN said WHEN stored THEN concat('O', id) END AS title,
    CASE WHEN trim(place) <> '' THEN place WHEN fetched THEN 'Bonn' WHEN stored THEN 'Old' END AS location_name,
    CASE WHEN fetched AND id % 11 <> 0 THEN concat('text ', id) WHEN stored THEN 'old text' END AS content_text FROM seen""")
def workday_over_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details, summary and stored row, each with its own precedence."""
    s = from_sql(spark, sf_dir, ["customer"], f"WITH {_SEEN} SELECT * FROM seen")
    n = F.col("id").cast("string")
    detail = F.when(F.col("fetched"), F.struct(F.col("detailed").alias("title"), F.when(F.col("id") % 11 == 0, "<p> </p>").otherwise(F.concat(F.lit("<p>text <b>"), n, F.lit("</b></p>"))).alias("description"), F.struct(F.concat(F.lit("ld-"), n).alias("value")).alias("identifier"), F.lit("Bonn").alias("location")))
    summary = F.struct(F.col("said").alias("title"), F.col("place").alias("locationsText"), F.concat(F.lit("/job/"), n).alias("externalPath"))
    old = F.when(F.col("stored"), F.struct(F.concat(F.lit("old-"), n).alias("source_job_id"), F.concat(F.lit("O"), n).alias("title"), F.lit("Old").alias("location_name"), F.lit("old text").alias("content_text"), F.lit(None).cast("string").alias("posted_at")))
    raw = s.select("id", F.to_json(F.struct(summary.alias("summary"), detail.alias("detail"), F.col("id"))).alias("raw_json"), old.alias("old"))
    out = postings.workday(raw, "old")
    return out.select(F.get_json_object("raw_json", "$.id").cast("long").alias("id"), "source_job_id", "title", "location_name", "content_text")


@query("SELECT CAST(c_nationkey AS BIGINT) AS nation, n AS csv_row_index, id, body FROM (SELECT c_nationkey, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('a \"quoted\", text', chr(10), 'of ', c_name) ELSE c_name END AS body FROM customer) WHERE body IS NOT NULL")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files of a nation each, written and read with the number of each row."""
    body = F.when(F.col("c_custkey") % 4 == 0, "  ").when(F.col("c_custkey") % 4 == 1, F.concat(F.lit('a "quoted", text\n'), F.lit("of "), "c_name")).otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_custkey").cast("long").alias("id"), body.alias("body"))
    path = new_folder(spark, "csv-rows")
    c.repartition("nation").sortWithinPartitions("nation", "id").write.partitionBy("nation").csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_csv(spark, path, "id long, body string, nation long", "body").select("nation", "csv_row_index", "id", "body")


@query("SELECT concat('cv', c_custkey, '.txt') AS path, trim(regexp_replace(concat(c_name, ' lives', chr(10), chr(9), 'at ', c_mktsegment), '[ \\n\\t]+', ' ', 'g')) AS text FROM customer")
def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded files as texts with single spaces."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("cv"), F.col("c_custkey").cast("string"), F.lit(".txt")).alias("path"), F.encode(F.concat(F.lit("\n "), "c_name", F.lit(" lives\n\tat "), "c_mktsegment", F.lit("  ")), "UTF-8").alias("content"))
    return files.uploaded_text(c)


@query("SELECT concat('resumes/r', n_nationkey) AS name, body AS text, sha256(body) AS sha256 FROM (SELECT n_nationkey, concat('# ', n_name, chr(10), 'Five years of SQL.', chr(10)) AS body FROM nation)")
def example_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text file below a folder, with its hash."""
    s = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("name"), F.concat(F.lit("# "), "n_name", F.lit("\nFive years of SQL.")).alias("value"))
    path = new_folder(spark, "example-texts") + "/resumes"
    s.repartition("name").write.partitionBy("name").text(path)
    got = files.read_texts(spark, path, "*.txt")
    return got.select(F.concat(F.lit("resumes/"), F.regexp_extract("path", "name=([^/]+)/", 1)).alias("name"), "text", "sha256")


_LINES = "lines AS (SELECT p_type AS path, p_partkey AS n, CASE WHEN p_partkey % 9 = 4 THEN concat('## ', p_brand, ' ') WHEN p_partkey % 9 = 6 THEN '  ' WHEN p_partkey % 2 = 0 THEN concat('- ', p_name) ELSE p_name END AS value, p_name, p_brand FROM part)"


@query(f"WITH {_LINES}, c AS (SELECT *, last_value(CASE WHEN n % 9 = 4 THEN p_brand END IGNORE NULLS) OVER (PARTITION BY path ORDER BY n) AS category FROM lines) SELECT p_name AS name, category FROM c WHERE n % 9 NOT IN (4, 6) AND category IS NOT NULL")
def technology_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of Markdown under headings as terms of categories."""
    return features.read_terms(from_sql(spark, sf_dir, ["part"], f"WITH {_LINES} SELECT path, n, value FROM lines"))


_RAW = "raws AS (SELECT s_suppkey AS id, 'lever' AS source_type, CASE WHEN s_suppkey % 2 = 0 THEN concat('c', CAST(s_suppkey AS VARCHAR(20))) ELSE '' END AS source_company, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS company_name, CASE WHEN s_suppkey % 5 <> 0 THEN concat('https://x/', CAST(s_suppkey AS VARCHAR(20))) END AS source_url, CASE WHEN s_suppkey % 4 = 0 THEN TIMESTAMP '2024-01-02 03:04:05' END AS fetched_at_utc, CASE WHEN s_suppkey % 6 = 0 THEN TIMESTAMP '2023-01-01 00:00:00' END AS first_seen_at_utc, CASE WHEN s_suppkey % 7 = 0 THEN false WHEN s_suppkey % 7 = 1 THEN true END AS is_active FROM supplier)"


@query(f"WITH {_RAW} SELECT id, concat('j', id) AS source_job_id, CASE WHEN source_company <> '' THEN source_company ELSE coalesce(company_name, source_url, 'unknown') END AS source_company, coalesce(fetched_at_utc, TIMESTAMP '2024-06-01 00:00:00') AS fetched_at_utc, coalesce(first_seen_at_utc, fetched_at_utc, TIMESTAMP '2024-06-01 00:00:00') AS first_seen_at_utc, coalesce(fetched_at_utc, TIMESTAMP '2024-06-01 00:00:00') AS last_seen_at_utc, coalesce(is_active, true) AS is_active, '{{}}' AS raw_json FROM raws")
def normalized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: records with their company, times and state filled in."""
    r = from_sql(spark, sf_dir, ["supplier"], f"WITH {_RAW} SELECT * FROM raws").withColumn("source_job_id", F.concat(F.lit("j\0"), F.col("id").cast("string")))
    out = lifecycle.normalized_record(r, F.expr("TIMESTAMP '2024-06-01 00:00:00'"))
    return out.select("id", "source_job_id", "source_company", "fetched_at_utc", "first_seen_at_utc", "last_seen_at_utc", "is_active", "raw_json")


@query(f"WITH {JOBS_SQL} SELECT id, is_active AND coalesce(trim(content_text), '') NOT IN ('', 'nan') AND posted_at_utc IS NOT NULL AND coalesce(location_parse_status IN ('parsed', 'country_only', 'remote', 'multi_location', 'city_resolved'), false) AS is_export_eligible FROM jobs")
def eligibility_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maintained predicate as a column, behind the gate of the columns it needs."""
    j = artifacts.require_columns(filters.required(jobs(spark, sf_dir), "id", "content_text"), "is_active boolean, content_text string, location_parse_status string")
    return j.select("id", lifecycle.eligible(F.col("is_active"), F.col("content_text"), F.col("posted_at_utc"), F.col("location_parse_status")).alias("is_export_eligible"))


@query(f"WITH t AS (SELECT conv_id, turn, unnest({_WORDS.format('text')}) AS term FROM conversations), tf AS (SELECT conv_id, turn, term, count(*) AS tf FROM t WHERE term NOT IN ({_STOP}) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), w AS (SELECT conv_id, turn, tf.term, tf, tf * (ln((1.0 + (SELECT count(*) FROM conversations)) / (1 + df)) + 1) AS w FROM tf JOIN df ON df.term = tf.term), n AS (SELECT conv_id, turn, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, turn)), 9) AS v, count(*) OVER (PARTITION BY conv_id, turn) AS size FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY v DESC, term) AS place FROM n) SELECT concat(conv_id, '-', turn) AS k, term, round(v, 6) AS tfidf FROM r WHERE place <= least(40, greatest(1, ceil(size * 0.3)))")
def web_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a query's side: one letter is enough, and shares are rounded up."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("k"), "text")
    return features.tfidf(c, "k", "text", least_chars=1, fraction=0.3, most=40, round_up=True).select("k", "term", F.round("tfidf", 6).alias("tfidf"))


@query(f"WITH t AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS word FROM documents), n AS (SELECT doc_id, word, count(*) AS n FROM t WHERE word NOT IN ({_STOP}) GROUP BY 1, 2) SELECT doc_id, CAST(sum(n) AS BIGINT) AS words, min(word) AS first_word, max(word) AS last_word FROM n WHERE n <= 4 GROUP BY 1")
def filtered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents without stop words and without those that a document has more than four times."""
    d = table(spark, sf_dir, "documents")
    w = features.without_frequent(d, "doc_id", text.without_stop_words(text.tokens(F.col("text"))), 4)
    return w.groupBy("doc_id").agg(F.count("*").alias("words"), F.min("word").alias("first_word"), F.max("word").alias("last_word"))


@query(f"WITH {JOBS_SQL} SELECT id, concat('Job title: ', coalesce(title, ''), chr(10), 'Requirements and description: ', CASE WHEN id % 3 = 0 THEN concat('knows ', salary > 1000) ELSE coalesce(content_text, '') END) AS body FROM jobs")
def title_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that is encoded of a posting."""
    needs = F.when(F.col("id") % 3 == 0, F.concat(F.lit("knows "), (F.col("salary") > 1000).cast("string"))).when(F.col("id") % 3 == 1, "  ")
    return jobs(spark, sf_dir).select("id", features.title_text(F.col("title"), needs, F.col("content_text")).alias("body"))


@query(f"WITH {JOBS_SQL}, g AS (SELECT source_type, count(*) AS n, min(id) / 8.0 AS low, count_if(is_active) AS a, count_if(NOT is_active) AS b FROM jobs GROUP BY 1) SELECT concat('DATA_QUALITY stage=export source=', coalesce(source_type, 'unknown'), ' n=', n, ' low=', CASE WHEN low = floor(low) THEN CAST(CAST(low AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.2f', low + 0.0001), '0+$', '') END, ' none=unknown active={{false:', b, ',true:', a, '}}') AS line FROM g")
def quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the quality log, a source each."""
    g = jobs(spark, sf_dir).groupBy("source_type").agg(F.count("*").alias("n"), (F.min("id") / 8.0 + 0.0001).alias("low"), F.count_if("is_active").alias("a"), F.count_if(~F.col("is_active")).alias("b"))
    counts = F.create_map(F.lit("true"), "a", F.lit("false"), "b")
    return g.select(quality.line(F.lit("export"), source=quality.shown_text(F.col("source_type")), n=quality.shown(F.col("n")), low=quality.shown(F.col("low")), none=quality.shown(F.lit(None)), active=quality.shown_counts(counts)).alias("line"))


_CVS = "cvs AS (SELECT s_suppkey AS id, concat('I used Python for several years at ', s_name, '.', CASE WHEN s_suppkey % 2 = 0 THEN ' My team moved reports to SQL tables.' ELSE '' END, CASE WHEN s_suppkey % 4 = 0 THEN ' Every release was tested twice.' ELSE '' END) AS body, CASE s_suppkey % 4 WHEN 0 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS sentences FROM supplier)"


@query(f"WITH {_CVS}, w AS (SELECT id, sentences, body, list_distinct(list_filter({_WORDS.format('body')}, lambda x: x NOT IN ({_STOP}))) AS ws FROM cvs) SELECT id, CAST(len(ws) AS BIGINT) AS words, CAST(len(ws) AS BIGINT) AS word_vectors, CAST(2 * sentences - 1 AS BIGINT) AS phrases, CAST(64 AS BIGINT) AS dimension, CASE WHEN sentences > 1 THEN 'Python,SQL' ELSE 'Python' END AS technologies FROM w")
def resume_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ranking needs of resumes, made once."""
    p = features.profiles(from_sql(spark, sf_dir, ["supplier"], f"WITH {_CVS} SELECT * FROM cvs"), "id", "body", [("Python", "Languages"), ("SQL", "Data")])
    size = lambda c: F.size(c).cast("long").alias(c)
    return p.select("id", size("words"), size("word_vectors"), size("phrases"), F.size("vector").cast("long").alias("dimension"), F.array_join("technologies", ",").alias("technologies"))


@query(f"WITH {METRICS_SQL} SELECT query_id, job_id, 'covered' AS operation, 'ok' AS status FROM metrics WHERE coverage IS NOT NULL UNION ALL SELECT query_id, job_id, 'breaks', 'failed: breaks: SparkRuntimeException' FROM metrics")
def contained_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failing operation says so and lets every id pass."""
    m = metrics(spark, sf_dir).select("query_id", "job_id", "coverage")
    steps = {"covered": lambda d: d.filter("coverage IS NOT NULL"), "breaks": lambda d: d.filter(F.raise_error(F.lit("no model")).cast("boolean"))}
    out = None
    for name, step in steps.items():
        d, status = matching.contained(step, m, name)
        d = d.select("query_id", "job_id", F.lit(name).alias("operation"), F.lit(status).alias("status"))
        out = d if out is None else out.unionByName(d)
    return out


@query(f"WITH {JOBS_SQL} SELECT id, title, salary FROM jobs")
def existing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export columns that the table has; one that must be there and is not raises."""
    return filters.existing(jobs(spark, sf_dir), ["id", "title", "not_there", "salary"], ["id", "title"])


_WRITTEN = "written AS (SELECT c_custkey AS id, CASE c_custkey % 14 WHEN 0 THEN 'Boston, MA' WHEN 1 THEN 'UT-Cottonwood Heights' WHEN 2 THEN 'In Office' WHEN 3 THEN 'Remote | Leeds, U.K.' WHEN 4 THEN 'Dublin (IE)' WHEN 5 THEN 'Remote - US' WHEN 6 THEN NULL WHEN 7 THEN 'Austin' WHEN 8 THEN 'Bonn; Fort Worth/Texas' WHEN 9 THEN 'Indianapolis' WHEN 10 THEN 'Business Park, Oregonia' WHEN 11 THEN 'Northern Ireland' WHEN 12 THEN 'N/A' ELSE 'Office: Provo, UT' END AS place FROM customer)"


@query(f"WITH {_WRITTEN} SELECT id, id % 14 IN (0, 1, 5, 7, 8, 13) AS us, id % 14 IN (3, 11) AS uk, id % 14 IN (4, 11) AS ireland, id % 14 IN (1, 13) AS utah, true AS anywhere FROM written")
def written_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries and states that a location names, by words alone."""
    p, at = from_sql(spark, sf_dir, ["customer"], f"WITH {_WRITTEN} SELECT * FROM written"), F.col("place")
    return p.select("id", filters.text_in_country(at, "U.S.").alias("us"), filters.text_in_country(at, "United  Kingdom").alias("uk"), filters.text_in_country(at, "Ireland").alias("ireland"), filters.text_in_state(at, "Ut").alias("utah"), filters.text_in_country(at, " ").alias("anywhere"))


@query(f"WITH {METRICS_SQL}, {RESULTS_SQL}, r AS (SELECT query_id, job_id, rank FROM results WHERE operation = 'cross_encoder' AND status = 'ok'), c AS (SELECT m.query_id, m.job_id, m.coverage, r.rank, count(r.rank) OVER (PARTITION BY m.query_id) > 0 AS found FROM metrics m LEFT JOIN r ON r.query_id = m.query_id AND r.job_id = m.job_id) SELECT query_id, job_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, job_id) AS place, CASE WHEN found THEN 'cross_encoder' END AS ordered_by, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(coverage, 0) DESC, job_id) AS coverage_place FROM c")
def ordered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in the order of one operation, and of coverage."""
    m = ranking.by_coverage(metrics(spark, sf_dir), F.col("coverage")).withColumnRenamed("place", "coverage_place")
    return ranking.by_operation(m, results(spark, sf_dir), "cross_encoder").select("query_id", "job_id", "place", "ordered_by", "coverage_place")


@query(f"WITH {JOBS_SQL}, n AS (SELECT id, row_number() OVER (ORDER BY posted_at_utc DESC NULLS LAST, id DESC) - 1 AS k FROM jobs WHERE is_active) SELECT id, CAST(k // 200 AS BIGINT) AS artifact_shard FROM n WHERE k < 1600 AND k // 200 IN (1, 3, 4)")
def shard_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards written once, and one or several read by pruning; one that is not there has no rows."""
    path = new_folder(spark, "shards")
    files.write_shards(lifecycle.newest_shards(jobs(spark, sf_dir).filter("is_active"), "posted_at_utc", "id", 200, 1600).select("id", "artifact_shard"), path)
    out = files.read_shard(spark, path, 1).unionByName(files.read_shards(spark, path, [3, 4])).unionByName(files.read_shard(spark, path, 99))
    return out.select("id", F.col("artifact_shard").cast("long").alias("artifact_shard"))
