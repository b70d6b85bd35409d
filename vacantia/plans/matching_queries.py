"""Queries of matching operators, joins and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import listed, tokens
from ..operators import features, filters, forest, matching, profiles
from ..session import new_folder, stored
from ..sources import files
from .registry import query, table
from .shapes import JOBS_SQL, METRICS_SQL, jobs, metrics


@query("WITH t AS (SELECT i.conv_id, i.text AS a, j.text AS b FROM conversations i JOIN conversations j ON j.conv_id = i.conv_id AND i.turn = 0 AND j.turn = 1), w AS (SELECT conv_id, list_filter(string_split_regex(a, '\\s+'), lambda x: x <> '') AS x, list_filter(string_split_regex(b, '\\s+'), lambda x: x <> '') AS y FROM t), p AS (SELECT conv_id, x[i * 30 + 1 : i * 30 + 40] AS ca, y[j * 30 + 1 : j * 30 + 40] AS cb, i, j FROM (SELECT *, unnest(range(0, CAST(greatest(ceil((len(x) - 40) / 30.0), 0) AS BIGINT) + 1)) AS i FROM w), LATERAL (SELECT unnest(range(0, CAST(greatest(ceil((len(y) - 40) / 30.0), 0) AS BIGINT) + 1)) AS j) WHERE len(x) > 0 AND len(y) > 0), s AS (SELECT conv_id, i, j, len(list_intersect(list_distinct(list_transform(ca, lambda z: lower(z))), list_distinct(list_transform(cb, lambda z: lower(z))))) / len(list_distinct(list_concat(list_transform(ca, lambda z: lower(z)), list_transform(cb, lambda z: lower(z))))) AS score FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, i, j) AS k FROM s) SELECT conv_id, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score, round(avg(score) FILTER (WHERE k <= 2), 6) AS top_mean_score, count(*) AS pairs FROM r GROUP BY conv_id")
def cross_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of two texts scored pair by pair, then max, mean and best-two mean."""
    c = table(spark, sf_dir, "conversations")
    a = c.filter("turn = 0").select("conv_id", F.col("text").alias("a"))
    b = c.filter("turn = 1").select(F.col("conv_id").alias("_c"), F.col("text").alias("b"))
    both = a.join(b, F.col("conv_id") == F.col("_c")).drop("_c")
    s = matching.chunk_aggregate(matching.pair_scores(matching.chunk_pairs(both, ["conv_id"], "a", "b", 40, 10)), ["conv_id"])
    return s.select("conv_id", *[F.round(x, 6).alias(x) for x in ("max_score", "mean_score", "top_mean_score")], "pairs")


@query(f"WITH {METRICS_SQL}, k AS (SELECT query_id, job_id, CASE WHEN job_id % 2 = 0 THEN cross_score ELSE CASE WHEN job_id % 3 = 0 THEN 1.0 ELSE 0.0 END END AS score FROM metrics) SELECT query_id, job_id, score, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank FROM k")
def filled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V12 over every candidate: those without a score are scored, and all are ranked anew."""
    m = metrics(spark, sf_dir)
    c = m.select("query_id", "job_id", F.lit("x").alias("a"), F.when(F.col("job_id") % 3 == 0, F.lit("x")).otherwise(F.lit("y")).alias("b"))
    known = m.filter("job_id % 2 = 0").select("query_id", "job_id", F.col("cross_score").alias("score"))
    return matching.filled_scores(c, known)


@query(f"WITH {METRICS_SQL}, d AS (SELECT query_id, job_id % 10 AS resume, round(word_distance, 2) AS d, job_id % 4 = 0 AS ref FROM metrics), n AS (SELECT d, count(*) FILTER (WHERE ref) AS k FROM d GROUP BY d), p AS (SELECT d, sum(k) OVER (ORDER BY d) * 100.0 / sum(k) OVER () AS pct FROM n) SELECT resume, count(*) AS phrases, round(100.0 * count(*) FILTER (WHERE pct <= 10) / count(*), 4) AS percent_flagged, round(100.0 * count(*) FILTER (WHERE pct >= 90) / count(*), 4) AS bad_match_percent, round(avg(pct), 4) AS mean_percentile, round(avg(d.d), 1) AS mean_distance FROM d JOIN p ON p.d = d.d WHERE NOT ref GROUP BY resume")
def job_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a candidate's nearest phrases compare with a pool's."""
    d = metrics(spark, sf_dir).select((F.col("job_id") % 10).alias("resume"), F.round("word_distance", 2).alias("d"), (F.col("job_id") % 4 == 0).alias("ref"))
    out = matching.coverage(d, F.col("ref"), ["resume"])
    return out.select("resume", "phrases", *[F.round(c, 4).alias(c) for c in ("percent_flagged", "bad_match_percent", "mean_percentile")], F.round("mean_distance", 1).alias("mean_distance"))


@query(f"WITH {METRICS_SQL}, p AS (SELECT query_id, job_id AS phrase_no, word_distance AS d, row_number() OVER (PARTITION BY query_id ORDER BY cross_score, word_distance, job_id) AS place FROM metrics) SELECT query_id, phrase_no, place FROM p WHERE place <= 5")
def strongest_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five strongest phrases of each job (a top-k report)."""
    m = metrics(spark, sf_dir).select("query_id", F.col("job_id").alias("phrase_no"), F.col("cross_score").alias("pct"), F.col("word_distance").alias("d"))
    return matching.strongest(m, ["query_id"]).select("query_id", "phrase_no", "place")


@query(f"WITH {METRICS_SQL}, v AS (SELECT query_id, job_id, word_distance / 100000 AS w, cross_score / 10 AS p, coverage / 100 AS n, CAST(job_id % 5 AS DOUBLE) AS g, CAST(job_id % 3 AS DOUBLE) / 2 AS t, coverage / 50 AS f, cross_score / 20 AS b FROM metrics) SELECT query_id, job_id, round(sqrt(w * p), 10) AS semantic_distance_geomean, round(ln((w + 1e-9) / (p + 1e-9)), 10) AS semantic_distance_ratio_log, round(CASE WHEN n IS NULL THEN (w + p) / 2 ELSE (w + p + n) / 3 END, 10) AS semantic_requirements_mean, round(greatest(w, p, n), 10) AS semantic_requirements_max, round(exp(-g), 10) AS seniority_fit_exp, round(t * exp(-sqrt(w * p)), 10) AS technology_x_semantic_similarity, round(n * (1 + g), 10) AS requirements_x_seniority_badness, round(CASE WHEN f IS NULL THEN b ELSE (f + b) / 2 END, 10) AS coverage_badness_mean FROM v WHERE NOT coalesce(n * (1 + g) >= 1.2, false)")
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a pair classifier, and a filter on one of them that fails open."""
    out = _pairs(spark, sf_dir)
    out = matching.screened(out, F.col("requirements_x_seniority_badness"), 1.2)
    return out.select("query_id", "job_id", *[F.round(c, 10).alias(c) for c in out.columns[9:]])


#: Three small trees over two derived features and a given one; how a trained forest is stored.
_NODES = [
    (0, 0, 0, 0.16, 1, 2, None),
    (0, 1, 1, 1.3, 3, 4, None),
    (0, 2, -1, None, -1, -1, [0.7, 0.1, 0.2]),
    (0, 3, -1, None, -1, -1, [0.1, 0.8, 0.1]),
    (0, 4, -1, None, -1, -1, [0.5, 0.2, 0.3]),
    (1, 0, 2, 0.55, 1, 2, None),
    (1, 1, -1, None, -1, -1, [0.2, 0.5, 0.3]),
    (1, 2, 0, 0.13, 3, 4, None),
    (1, 3, -1, None, -1, -1, [0.3, 0.3, 0.4]),
    (1, 4, -1, None, -1, -1, [0.9, 0.0, 0.1]),
    (2, 0, -1, None, -1, -1, [0.4, 0.4, 0.2]),
]
_VALUES = ", ".join(f"({t}, {n}, {f}, {'NULL' if h is None else h}, {a}, {b}, {'NULL' if p is None else list(p)})" for t, n, f, h, a, b, p in _NODES)
_PAIR_COLUMNS = {"word_distance": "w", "phrase_distance": "p", "requirements_distance": "n", "seniority_abs_gap": "g", "technology_overlap": "t", "percent_flagged": "f", "bad_match_percent": "b"}


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir).selectExpr("query_id", "job_id", "word_distance / 100000 AS w", "cross_score / 10 AS p", "coverage / 100 AS n", "job_id % 5 AS g", "(job_id % 3) / 2 AS t", "coverage / 50 AS f", "cross_score / 20 AS b")
    return matching.pair_features(m, _PAIR_COLUMNS)


@query(f"""WITH RECURSIVE {METRICS_SQL}, nodes(tree, node, feature, threshold, lower, upper, shares) AS (VALUES {_VALUES}),
    v AS (SELECT query_id, job_id, sqrt(word_distance / 100000 * cross_score / 10) AS a, coverage / 100 * (1 + job_id % 5) AS b, coverage / 50 AS f FROM metrics),
    x AS MATERIALIZED (SELECT query_id, job_id, [coalesce(a, 0.1), coalesce(b, 0.9), coalesce(f, 0.6)] AS given, CAST((a IS NULL)::INT + (b IS NULL)::INT + (f IS NULL)::INT AS BIGINT) AS missing_features FROM v),
    walk AS (SELECT query_id, job_id, given, tree, 0 AS node FROM x, (SELECT DISTINCT tree FROM nodes)
        UNION ALL SELECT query_id, job_id, given, w.tree, CASE WHEN given[n.feature + 1] <= n.threshold THEN n.lower ELSE n.upper END FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.feature >= 0),
    p AS (SELECT query_id, job_id, avg(n.shares[1]) AS bad, avg(n.shares[2]) AS good, avg(n.shares[3]) AS unclear FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.feature < 0 GROUP BY ALL)
    SELECT query_id, job_id, round(bad, 9) AS bad_probability, round(good, 9) AS good_probability, round(unclear, 9) AS unclear_probability, bad >= 0.48125 AS is_flagged, CASE WHEN bad >= 0.48125 THEN 2 ELSE 1 END AS rank, missing_features, 'ok' AS status FROM p JOIN x USING (query_id, job_id)""")
def bad_match_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A three-class forest from its node table over every pair, and what it flags."""
    model = forest.Forest(_NODES, ["semantic_distance_geomean", "requirements_x_seniority_badness", "f"], [forest.BAD, "really_good", "unclear"], [0.1, 0.9, 0.6], bad_threshold=0.48125)
    out = forest.judged(_pairs(spark, sf_dir), lambda: model)
    p = lambda c: F.round(F.element_at("class_probabilities", F.lit(c)), 9)
    return out.select("query_id", "job_id", F.round("bad_probability", 9).alias("bad_probability"), p("really_good").alias("good_probability"), p("unclear").alias("unclear_probability"), "is_flagged", "rank", F.col("missing_features").cast("long").alias("missing_features"), "status")


@query()
def fitted_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest fitted on the documents that `labels` covers, by text statistics, written as a node
    table, read back and put to every document (learned, so no oracle; tested against SQL over its nodes)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    words = F.array_remove(F.split("t", r"\s+"), "")
    share = lambda a, b, name: F.try_divide(a, b).alias(name)  # noqa: E731 - a text without words has no shares: they are missing
    d = d.select("doc_id", F.size(words).alias("n_words"), share(F.length("t"), F.size(words), "per_word"), share(F.size(F.array_distinct(words)), F.size(words), "distinct_share"), share(F.length(F.regexp_replace("t", r"[\p{L}\s]", "")), F.length("t"), "other_share"))
    d = stored(d, "text-statistics")  # read by every pass of the fit
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), "quality")
    known = d.join(labels, F.col("doc_id") == F.col("_id"))
    made = forest.fit(known, ["n_words", "per_word", "distinct_share", "other_share"], "quality", threshold=0.5)
    path = new_folder(spark, "forest-nodes")
    made.save(spark, path)
    out = forest.judged(d, lambda: forest.load(spark, path))
    return out.select("doc_id", F.round("bad_probability", 9).alias("good_probability"), "is_flagged", "missing_features", "status")


@query("WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?')) AS word FROM documents), l AS (SELECT p_partkey AS k, string_split(p_name, ' ')[1] AS word FROM part), v AS (SELECT 'the' AS word, 1.5 AS x UNION ALL SELECT 'of', 2.5 UNION ALL SELECT 'and', 0.5) SELECT doc_id, count(*) AS n, round(sum(x), 4) AS total FROM w JOIN v ON v.word = w.word GROUP BY doc_id")
def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the words that a lookup has, in order."""
    lookup = spark.createDataFrame([("the", [1.5]), ("of", [2.5]), ("and", [0.5])], "word string, vector array<double>")
    d = features.looked_up(table(spark, sf_dir, "documents"), "doc_id", tokens(F.col("text")), F.broadcast(lookup))  # three rows
    return d.select("doc_id", F.size("vectors").cast("long").alias("n"), F.round(F.aggregate("vectors", F.lit(0.0), lambda s, v: s + v[0]), 4).alias("total"))


@query("WITH s AS (SELECT c_custkey AS id, concat('u', c_custkey % 700) AS url, concat('i', c_custkey) AS ident FROM customer), o AS (SELECT concat('u', s_suppkey * 3) AS url, concat('i', s_suppkey * 7) AS ident, s_acctbal AS content FROM supplier) SELECT s.id, coalesce(u.content, i.content) AS content FROM s LEFT JOIN o u ON u.url = s.url LEFT JOIN o i ON i.ident = s.ident")
def url_or_id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored row by URL, else by id: two equi-joins in place of an OR."""
    s = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "concat('u', c_custkey % 700) AS url", "concat('i', c_custkey) AS ident")
    o = table(spark, sf_dir, "supplier").selectExpr("concat('u', s_suppkey * 3) AS _url", "concat('i', s_suppkey * 7) AS _ident", "s_acctbal AS content")
    u = o.select("_url", F.col("content").alias("by_url"))
    i = o.select("_ident", F.col("content").alias("by_id"))
    out = s.join(u, F.col("url") == F.col("_url"), "left").join(i, F.col("ident") == F.col("_ident"), "left")
    return out.select("id", F.coalesce("by_url", "by_id").alias("content"))


@query(f"WITH {JOBS_SQL}, k AS (SELECT id FROM jobs WHERE is_active ORDER BY posted_at_utc DESC NULLS LAST, id DESC LIMIT 1000) SELECT j.id, j.title FROM jobs j SEMI JOIN k ON k.id = j.id WHERE j.yoe_version IS DISTINCT FROM 'v1'")
def newest_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending work among the newest K (K is the feature)."""
    j = jobs(spark, sf_dir)
    k = j.filter("is_active").orderBy(F.desc_nulls_last("posted_at_utc"), F.desc("id")).limit(1000).select("id")
    return j.filter(~F.col("yoe_version").eqNullSafe("v1")).join(k, "id", "left_semi").select("id", "title")


@query("WITH b AS (SELECT o_custkey AS id, max(o_totalprice) AS price FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1) SELECT c_custkey AS id, CASE WHEN b.id IS NOT NULL THEN b.price ELSE c_acctbal END AS balance FROM customer LEFT JOIN b ON b.id = c_custkey")
def update_from_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows updated from a batch by key."""
    b = table(spark, sf_dir, "orders").filter("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("_id")).agg(F.max("o_totalprice").alias("price"))
    c = table(spark, sf_dir, "customer").join(b, F.col("c_custkey") == F.col("_id"), "left")
    return c.select(F.col("c_custkey").alias("id"), F.when(F.col("_id").isNotNull(), F.col("price")).otherwise(F.col("c_acctbal")).alias("balance"))


@query(f"WITH {JOBS_SQL} SELECT a.id FROM jobs a WHERE a.is_active AND a.id NOT IN (SELECT id FROM jobs WHERE id % 7 = 0) UNION ALL SELECT id FROM jobs WHERE NOT is_active AND id % 2 = 0")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames put together, without those shown already."""
    j = jobs(spark, sf_dir)
    fresh = j.filter("is_active").join(j.filter("id % 7 = 0").select("id"), "id", "left_anti").select("id")
    return fresh.unionByName(j.filter("NOT is_active AND id % 2 = 0").select("id"))


@query("WITH p AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN concat('[\"', p_brand, '\", \" \", \"x\"]') WHEN 1 THEN concat(p_brand, ' | x') ELSE NULL END AS v, p_size, p_brand FROM part) SELECT id, CASE WHEN v IS NOT NULL THEN concat(p_brand, ',x') END AS items FROM p")
def parsed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists written as JSON or with bars."""
    p = table(spark, sf_dir, "part")
    v = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('["'), F.col("p_brand"), F.lit('", " ", "x"]'))).when(F.col("p_size") % 3 == 1, F.concat(F.col("p_brand"), F.lit(" | x")))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(listed(v), ",").alias("items"))


@query(f"WITH {JOBS_SQL} SELECT concat(source_type, ':', source_job_id) AS job_id, count(*) AS lines, count(*) FILTER (WHERE title IS NULL) AS null_titles FROM jobs WHERE source_type IS NOT NULL GROUP BY 1")
def export_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export lines as JSON, nulls kept, and read back."""
    j = jobs(spark, sf_dir).filter("source_type IS NOT NULL").select(F.concat_ws(":", "source_type", "source_job_id").alias("job_id"), "title", F.col("posted_at_utc").cast("string").alias("posted_at_utc"))
    back = files.metadata_json(j).select(F.from_json("value", "job_id string, title string, posted_at_utc string").alias("r")).select("r.*")
    return back.groupBy("job_id").agg(F.count("*").alias("lines"), F.count_if(F.col("title").isNull()).alias("null_titles"))


@query(f"WITH {JOBS_SQL} SELECT CAST(id % 10 AS BIGINT) AS shard, count(*) AS jobs, min(posted_at_utc) AS oldest, max(posted_at_utc) AS newest, count(*) FILTER (WHERE title IS NOT NULL AND content_text IS NOT NULL AND posted_at_utc IS NOT NULL AND source_type IS NOT NULL AND yoe_version IS NOT NULL) AS complete FROM jobs GROUP BY 1")
def shard_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting times and complete rows of each shard."""
    whole = F.lit(True)
    for c in ("title", "content_text", "posted_at_utc", "source_type", "yoe_version"):
        whole &= F.col(c).isNotNull()
    j = filters.required(jobs(spark, sf_dir), "posted_at_utc").withColumn("shard", F.col("id") % 10)
    return j.groupBy("shard").agg(F.count("*").alias("jobs"), F.min("posted_at_utc").alias("oldest"), F.max("posted_at_utc").alias("newest"), F.count_if(whole).alias("complete"))


@query()
def rank_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole engine on documents as postings: enrich, hard filters, every metric, fusion
    (random projections and an injected encoder, so there is no oracle)."""
    from .engine import RankQuery, enrich, job_clouds, job_vectors, rank

    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat_ws(" ", F.lit("Writer"), "lang", "source").alias("title"),
        F.concat(F.col("text"), F.lit("\nRequirements:\n* at least "), (F.col("doc_id") % 9).cast("string"), F.lit(" years of experience with SQL")).alias("content_text"),
        F.element_at(F.array(*[F.lit(x) for x in ("Boston, MA", "Remote - United States", "London")]), (F.col("doc_id") % 3 + 1).cast("int")).alias("location_name"),
        F.concat(F.lit("Posted "), (F.col("doc_id") % 30).cast("string"), F.lit(" days ago")).alias("posted_at"),
        now.alias("fetched_at_utc"),
        F.lit(True).alias("is_active"),
    )
    q = RankQuery("The thing and the thinger with years of experience in the making of good things.", country="US", max_required_yoe=7, now=now, recent_hours=24 * 20)
    # Features are made once and stored: a vector of every posting, and clouds of those that become candidates.
    j = stored(enrich(d, now), "postings")
    made = profiles.refreshed(spark, new_folder(spark, "features"), j, "id", "title_requirements_text", lambda rows: job_vectors(rows), "v1", "hashing", now)
    kept = lambda c: profiles.refreshed(spark, new_folder(spark, "clouds"), c, "id", "title_requirements_text", lambda rows: job_clouds(c.join(rows.select("id"), "id", "left_semi")), "v1", "hashing", now)
    out = rank(j, q, clouds=kept, made=made)
    return out.select("id", F.round("word_distance", 6).alias("word_distance"), F.round("phrase_distance", 6).alias("phrase_distance"), F.round("cross_score", 6).alias("cross_score"), "is_bad", "final_rank")
