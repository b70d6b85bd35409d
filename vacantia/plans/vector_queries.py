"""Queries of vector operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import near, ordered, ranking, vectors
from ..session import stored
from .registry import query, table

_D = "list_transform(embedding, lambda v: CAST(v AS DOUBLE))"


@query(f"WITH e AS (SELECT vec_id, label, {_D} AS v FROM embeddings), q AS (SELECT v AS qv FROM e WHERE vec_id = 0), d AS (SELECT vec_id, round(1 - list_cosine_similarity(v, qv), 6) AS distance FROM e, q) SELECT vec_id, distance FROM d ORDER BY distance, vec_id LIMIT 100")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred nearest to a query vector (a top-k report)."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    d = e.join(F.broadcast(q)).select("vec_id", F.round(vectors.cosine_distance(F.col("embedding"), F.col("q")), 6).alias("distance"))
    return d.orderBy("distance", "vec_id").limit(100)


@query(f"WITH e AS (SELECT vec_id, label, {_D} AS v FROM embeddings), l AS (SELECT label, unnest(v) AS x, unnest(range(64)) AS pos FROM e), m AS (SELECT label, pos, avg(x) AS m, count(*) AS n FROM l GROUP BY 1, 2), c AS (SELECT label, max(n) AS size, list(m ORDER BY pos) AS c FROM m GROUP BY label), q AS (SELECT v AS qv FROM e WHERE vec_id = 0), d AS (SELECT label, size, round(1 - list_cosine_similarity(c, qv), 6) AS distance FROM c, q) SELECT label, size, distance, rank() OVER (ORDER BY distance) AS rank FROM d")
def centroid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by the distance of their centroids to a query."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    c = vectors.centroids(e, "label", "embedding").join(F.broadcast(q))
    d = c.select("label", "size", F.round(vectors.cosine_distance(F.col("centroid"), F.col("q")), 6).alias("distance"))
    return d.withColumn("rank", F.rank().over(Window.orderBy("distance")).cast("long"))  # one row a cluster


_W = "w AS (SELECT label, axis, v, sum(ia) OVER o * 1.0 / sum(ia) OVER p - sum(ib) OVER o * 1.0 / sum(ib) OVER p AS gap, lead(v) OVER (PARTITION BY label, axis ORDER BY v) - v AS step FROM g WINDOW o AS (PARTITION BY label, axis ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY label, axis))"


@query(f"WITH e AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(64)) AS axis FROM embeddings), l AS (SELECT DISTINCT label FROM e WHERE label <> 0), u AS (SELECT label, axis, v, 0 AS own FROM e WHERE label <> 0 UNION ALL SELECT l.label, axis, v, 1 FROM e, l WHERE e.label = 0), g AS (SELECT label, axis, v, count(*) FILTER (WHERE own = 1) AS ia, count(*) FILTER (WHERE own = 0) AS ib FROM u GROUP BY 1, 2, 3), {_W} SELECT label, axis, round(sum(abs(gap) * step), 6) AS distance FROM w GROUP BY label, axis")
def wasserstein_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: first Wasserstein distances, along every axis, of each label's cloud from that of label 0.

    The query's cloud stands beside every label's: once a label, not once a row."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    labels = e.filter("label <> 0").agg(F.collect_set("label").alias("all"))  # one row of distinct labels
    own = e.filter("label <> 0").withColumn("query", F.lit(False))
    query_ = e.filter("label = 0").join(F.broadcast(labels)).select(F.explode("all").alias("label"), "pos", "v", F.lit(True).alias("query"))
    both = own.unionByName(query_).withColumn("axis", F.col("pos").cast("long"))
    out = vectors.wasserstein_1d(both, F.col("query"), ~F.col("query"), F.col("v"), ["label", "axis"])
    return out.select("label", "axis", F.round("distance", 6).alias("distance"))


_HASH = "md5(concat('7:', p, ':', j))"
_PART = "CAST(('0x' || substr({}, {}, 8)) AS BIGINT)"


@query(f"""WITH h AS (SELECT p, j, {_HASH} AS h FROM range(64) AS a(p), range(64) AS b(j)),
    n AS (SELECT p, j, sqrt(-2 * ln(({_PART.format('h', 1)} + 1) / 4294967297.0::DOUBLE)) * cos(2 * pi() * {_PART.format('h', 9)} / 4294967296.0::DOUBLE) AS x FROM h),
    d AS MATERIALIZED (SELECT p, list(x ORDER BY j) AS x, sqrt(sum(x * x)) AS length FROM n GROUP BY p),
    e AS MATERIALIZED (SELECT vec_id, vec_id // 8 AS job_id, {_D} AS v FROM embeddings),
    s AS MATERIALIZED (SELECT job_id, p, list_dot_product(v, x) / length AS y, vec_id < 8 AS own FROM e, d),
    k AS (SELECT job_id, count(*) AS n FROM e GROUP BY job_id),
    u AS (SELECT job_id, p, y, 1.0::DOUBLE / n AS w FROM s JOIN k USING (job_id) UNION ALL SELECT k.job_id, p, y, -1.0::DOUBLE / (SELECT n FROM k WHERE job_id = 0) FROM s, k WHERE own),
    r AS (SELECT job_id, p, abs(sum(w) OVER o) * (lead(y) OVER (PARTITION BY job_id, p ORDER BY y, w) - y) AS area FROM u WINDOW o AS (PARTITION BY job_id, p ORDER BY y, w ROWS UNBOUNDED PRECEDING))
    SELECT job_id, round(sum(area) / 64, 9) AS distance FROM r GROUP BY job_id""")
def sliced_wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4, V5, V6, V7, V8: clouds of eight vectors ranked against a query cloud by 64 projections,
    whose directions SQL makes from the same hashes."""
    e = table(spark, sf_dir, "embeddings")
    cloud = e.withColumn("job_id", F.floor(F.col("vec_id") / 8)).groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"]).alias("matrix"))
    q = np.array([r[0] for r in e.filter("vec_id < 8").orderBy("vec_id").select("embedding").collect()])  # a query of eight vectors
    d = vectors.sliced_wasserstein(cloud, "matrix", q).withColumn("distance", F.round("distance", 9))
    return d


@query(f"WITH e AS (SELECT vec_id, label, {_D} AS v FROM embeddings), r AS (SELECT v AS rv FROM e WHERE label = 0), n AS (SELECT vec_id, label, min(1 - list_cosine_similarity(v, rv)) AS nearest FROM e, r WHERE label <> 0 GROUP BY 1, 2), pool AS (SELECT nearest FROM n WHERE label > 1), j AS (SELECT vec_id, nearest, (SELECT count(*) FROM pool WHERE round(pool.nearest, 6) <= round(n.nearest, 6)) * 100.0 / (SELECT count(*) FROM pool) AS pct FROM n WHERE label = 1) SELECT vec_id, round(nearest, 6) AS nearest, round(pct, 4) AS percentile, pct <= 10 AS flagged, pct >= 90 AS bad FROM j")
def phrase_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all vectors of label 0, which may grow with the table, sought in the
    cells of pivots; and the share of the pool (higher labels) that is as near."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    n = near.nearest(e.filter("label <> 0"), e.filter("label = 0"), "vec_id", "embedding")
    n = n.withColumn("d", F.round("nearest", 6)).select(F.col("vec_id").alias("_id"), "d")
    n = stored(e.select("vec_id", "label").join(n, F.col("vec_id") == F.col("_id")).drop("_id"), "phrase-distances")
    j = ordered.with_pool_shares(n, "d", F.col("label") > 1).filter("label = 1")
    return j.select("vec_id", F.col("d").alias("nearest"), F.round("pct", 4).alias("percentile"), (F.col("pct") <= 10).alias("flagged"), (F.col("pct") >= 90).alias("bad"))


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, label, {_D} AS v FROM embeddings),
    n AS MATERIALIZED (SELECT a.label, a.vec_id AS u, b.vec_id AS w FROM e a JOIN e b ON b.label IS NOT DISTINCT FROM a.label WHERE 1 - list_cosine_similarity(a.v, b.v) <= 0.74),
    core AS MATERIALIZED (SELECT u FROM n GROUP BY u HAVING count(*) >= 4),
    l AS MATERIALIZED (SELECT u, w FROM n WHERE u IN (SELECT u FROM core) AND w IN (SELECT u FROM core)),
    r(u, w) AS (SELECT u, w FROM l UNION SELECT r.u, l.w FROM r JOIN l ON l.u = r.w),
    c AS (SELECT u, min(w) AS first FROM r GROUP BY u),
    k AS MATERIALIZED (SELECT c.u, dense_rank() OVER (PARTITION BY e.label ORDER BY c.first) - 1 AS cluster FROM c JOIN e ON e.vec_id = c.u),
    b AS (SELECT n.u, min(k.cluster) AS cluster FROM n JOIN k ON k.u = n.w GROUP BY n.u)
    SELECT e.label, e.vec_id, coalesce(k.cluster, b.cluster, -1)::BIGINT AS cluster FROM e LEFT JOIN k ON k.u = e.vec_id LEFT JOIN b ON b.u = e.vec_id""")
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of each label's vectors, with noise, over all rows."""
    e = table(spark, sf_dir, "embeddings")
    return near.dbscan(e, "vec_id", "embedding", 0.74, 4, by="label")


@query()
def requirement_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-means clusters of vectors, ranked by the distance of their centroids from
    a query vector; the vectors of the better half of the clusters stay (an iterative fit, so no oracle)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"))
    found = KMeans(k=8, seed=11, maxIter=20).fit(e).transform(e).select("vec_id", "embedding", F.col("prediction").alias("cluster"))
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    c = vectors.centroids(found, "cluster", "embedding").join(F.broadcast(q))  # one row a cluster, and one query
    c = c.select(F.col("cluster").alias("_c"), F.rank().over(Window.orderBy(F.round(vectors.cosine_distance(F.col("centroid"), F.col("q")), 9))).alias("rank"))
    ranked = found.join(F.broadcast(c), F.col("cluster") == F.col("_c")).select(F.lit(0).alias("query_id"), "vec_id", "cluster", "rank")
    return ranking.best_clusters(ranked, 0.5).select("vec_id", F.col("cluster").cast("long").alias("cluster"), F.col("rank").cast("long").alias("rank"))


@query("WITH w AS (SELECT DISTINCT label % 3 AS text_no, count(*) AS n FROM embeddings GROUP BY 1) SELECT text_no, n FROM w")
def encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct text is encoded once and joined back."""
    e = table(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("text_no"), F.concat(F.lit("text "), (F.col("label") % 3).cast("string")).alias("t"))
    return vectors.encoded(e, "t").filter(F.size("vector") == 64).groupBy("text_no").agg(F.count("*").alias("n"))
