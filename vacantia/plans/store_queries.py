"""Queries of tables that grow by batches: merges, backfills, runs that resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import STOP_WORDS
from ..operators import lifecycle, profiles, store
from ..session import new_folder
from .registry import query, table
from .shapes import JOBS_SQL, jobs

#: Few, for tables of some thousand rows.
_BUCKETS = 8
_KEPT = "o_orderkey AS id, o_totalprice AS price, o_orderpriority AS title, o_orderdate AS first_seen"


@query(f"""WITH a AS (SELECT {_KEPT} FROM orders WHERE o_orderstatus <> 'P'),
    b AS (SELECT o_orderkey AS id, o_totalprice + 1 AS price, 'changed' AS title, o_orderdate + INTERVAL 1 DAY AS first_seen FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P'),
    c AS (SELECT o_orderkey AS id, o_totalprice * 2 AS price, concat('twice ', o_orderstatus) AS title, o_orderdate + INTERVAL 2 DAY AS first_seen FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '2-HIGH'),
    ids AS (SELECT id FROM a UNION SELECT id FROM b UNION SELECT id FROM c)
    SELECT id, coalesce(c.price, b.price, a.price) AS price, coalesce(c.title, b.title, a.title) AS title, CASE WHEN a.id IS NOT NULL AND (b.id IS NOT NULL AND a.price <> b.price OR c.id IS NOT NULL AND coalesce(b.price, a.price) <> c.price) THEN NULL ELSE a.price END AS derived, coalesce(a.first_seen, b.first_seen, c.first_seen) AS first_seen
    FROM ids LEFT JOIN a USING (id) LEFT JOIN b USING (id) LEFT JOIN c USING (id)""")
def incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K2: a table and two batches, merged by bucket; first_seen stays, derived goes where the price changed."""
    o, path = table(spark, sf_dir, "orders"), new_folder(spark, "merged-orders")
    day = lambda n: F.expr(f"o_orderdate + INTERVAL {n} DAY").cast(o.schema["o_orderdate"].dataType)
    base = o.filter("o_orderstatus <> 'P'").selectExpr(*_KEPT.split(", ")).withColumn("derived", F.col("price"))
    first = o.filter("o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") + 1).cast(base.schema["price"].dataType).alias("price"), F.lit("changed").alias("title"), day(1).alias("first_seen"))
    second = o.filter("o_orderstatus = 'P' OR o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") * 2).cast(base.schema["price"].dataType).alias("price"), F.concat(F.lit("twice "), "o_orderstatus").alias("title"), day(2).alias("first_seen"))
    store.merge(spark, path, base, ["id"], buckets=_BUCKETS)
    for batch in (first, second):
        store.merge(spark, path, batch, ["id"], buckets=_BUCKETS, keep=["first_seen"], reset={"derived": ["price"]})
    return store.read(spark, path).select("id", "price", "title", "derived", "first_seen")


_ELIGIBLE = "is_active AND coalesce(trim(content_text), '') NOT IN ('', 'nan') AND posted_at_utc IS NOT NULL AND coalesce(location_parse_status IN ('parsed', 'country_only', 'remote', 'multi_location', 'city_resolved'), false)"


@query(f"WITH {JOBS_SQL}, e AS (SELECT min(id) AS a, CAST(ceil((max(id) - min(id) + 1) / 5.0) AS BIGINT) AS span FROM jobs) SELECT id, CASE WHEN id < a + 2 * span THEN {_ELIGIBLE} END AS after_two, {_ELIGIBLE} AS after_all FROM jobs, e")
def eligibility_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eligibility column filled by ranges of keys behind a watermark, as it is after two of five ranges and after all."""
    j = jobs(spark, sf_dir).select("id", "is_active", "content_text", "posted_at_utc", "location_parse_status")
    path = new_folder(spark, "backfilled-jobs")
    store.merge(spark, path, j.withColumn("is_export_eligible", F.lit(None).cast("boolean")), ["id"], buckets=_BUCKETS)
    value = lifecycle.eligible(F.col("is_active"), F.col("content_text"), F.col("posted_at_utc"), F.col("location_parse_status"))
    span = j.agg(F.ceil((F.max("id") - F.min("id") + 1) / 5.0)).first()[0]
    store.backfill(spark, path, "id", "is_export_eligible", value, int(span), batches=2, buckets=_BUCKETS)
    two = store.read(spark, path).select(F.col("id").alias("_id"), F.col("is_export_eligible").alias("after_two"))
    store.backfill(spark, path, "id", "is_export_eligible", value, int(span), buckets=_BUCKETS)
    both = store.read(spark, path).join(two, F.col("id") == F.col("_id"))
    return both.select("id", "after_two", F.col("is_export_eligible").alias("after_all"))


@query("WITH p AS (SELECT r_regionkey AS query_id, levenshtein(r_name, o_orderpriority) + o_orderkey % 10 AS score FROM region, orders) SELECT query_id, count(*) AS pairs, CAST(sum(score) AS BIGINT) AS total, CAST(min(score) AS BIGINT) AS least FROM p GROUP BY query_id")
def resumed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region (a stated list of five) with every order, in units of a region and a block of
    orders; the run is stopped after seven units of twenty and taken up again."""
    o, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), new_folder(spark, "pairs")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(3))))
    units = r.withColumn("unit", F.concat_ws("-", F.col("r_regionkey").cast("string"), F.col("block").cast("string")))

    def compute(now: DataFrame) -> DataFrame:
        blocks = o.withColumn("_block", F.pmod(F.xxhash64("o_orderkey"), F.lit(4)).cast("int"))
        pairs = blocks.join(F.broadcast(now), F.col("_block") == F.col("block"))  # a stated list of units
        return pairs.select("unit", F.col("r_regionkey").alias("query_id"), (F.levenshtein("r_name", "o_orderpriority") + F.col("o_orderkey") % 10).alias("score"))

    store.run_units(units, path, compute, most=7)
    out = store.run_units(units, path, compute)
    return out.groupBy("query_id").agg(F.count("*").alias("pairs"), F.sum("score").cast("long").alias("total"), F.min("score").cast("long").alias("least"))


_WORDS = "list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(body, '')), '[a-z]+(?:''[a-z]+)?'), lambda x: x NOT IN ({0}))))".format(", ".join(f"'{w}'" for w in STOP_WORDS))


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN concat(coalesce(text, ''), ' revised twice') ELSE text END AS body FROM documents)
    SELECT doc_id, sha256(coalesce(body, '')) AS text_sha256, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 2 ELSE 1 END AS made_in, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS created_in, md5(array_to_string({_WORDS}, ' ')) AS words_md5, CAST(len({_WORDS}) AS BIGINT) AS n_words FROM d WHERE doc_id % 11 <> 0""")
def stored_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of all documents, stored; some deleted, some texts changed, then refreshed: only
    those are made again. Some more are deleted at the end."""
    d, path = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body")), new_folder(spark, "profiles")

    def make(run: int):
        words = F.array_sort(F.array_distinct(text.without_stop_words(text.tokens(F.coalesce("body", F.lit(""))))))
        # One string, which is shuffled and stored in half the bytes of an array.
        return lambda rows: rows.select("doc_id", F.array_join(words, " ").alias("words"), F.lit(run).alias("made_in"))

    at = lambda n: F.lit(f"2024-01-0{n} 00:00:00").cast("timestamp")
    profiles.refreshed(spark, path, d, "doc_id", "body", make(1), "v1", "words", at(1), _BUCKETS)
    profiles.delete(spark, path, d.filter("doc_id % 5 = 0"), "doc_id", _BUCKETS)
    d = d.withColumn("body", F.when(F.col("doc_id") % 7 == 0, F.concat(F.coalesce("body", F.lit("")), F.lit(" revised twice"))).otherwise(F.col("body")))
    profiles.refreshed(spark, path, d, "doc_id", "body", make(2), "v1", "words", at(2), _BUCKETS)
    profiles.delete(spark, path, d.filter("doc_id % 11 = 0"), "doc_id", _BUCKETS)
    out = profiles.load(spark, path)
    return out.select("doc_id", "text_sha256", "made_in", F.dayofmonth("created_at").alias("created_in"), F.md5(F.col("words").cast("binary")).alias("words_md5"), F.size(F.filter(F.split("words", " "), lambda w: w != "")).cast("long").alias("n_words"))
