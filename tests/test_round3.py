"""What the findings of round 3 were about: each test failed before its change."""

import hashlib
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from vacantia.functions import text
from vacantia.operators import artifacts, features, profiles, ranking, store
from vacantia.plans import engine, registry
from vacantia.session import stored


def folder(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def by_sql(name, sf_dir, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
    return con.execute(registry.ORACLE[name])


def test_technologies_beside_signs(spark, tmp_path):
    texts = ["x the y", "the### y", "+the", "#of#", "x#the y", "the a-#and", "de/for", "with+and", "of", None, "thé x", "C# the"]
    sf = folder(spark, tmp_path, documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {tuple(r) for r in registry.QUERIES["tech_overlap"](spark, sf).collect()}
    assert got == set(by_sql("tech_overlap", sf, "documents").fetchall())


def test_whole_spellings_with_signs(spark):
    df = spark.createDataFrame([(1, "c++ and c#"), (2, "c+++ or ci/cd#"), (3, "ci/cd")], "k int, t string")
    terms = [("C++", "L"), ("C#", "L"), ("CI/CD", "T")]
    got = {r["k"]: r["technologies"] for r in features.technologies(df, "k", "t", terms, whole=True).collect()}
    assert got == {1: ["C#", "C++"], 2: [], 3: ["CI/CD"]}


def test_rows_dear_to_compute_are_dealt_out(spark):
    for name in ("requirement_items", "page_descriptions"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8


def test_first_of_each_keeps_order(spark):
    df = spark.createDataFrame([(["b", "A", "B", "a", "c"],), ([],), (None,)], "x array<string>")
    assert [r[0] for r in df.select(text.first_of_each(F.col("x"), F.lower)).collect()] == [["b", "A", "c"], [], None]


def test_clouds_are_made_for_candidates_alone(spark, tmp_path):
    now = F.expr("TIMESTAMP '2024-02-01 00:00:00'")
    rows = [(k, f"Builder {k}", f"We build thing{k} with tools and care.\nRequirements:\n* at least {k % 6} years of experience with SQL", "Boston, MA", "Posted Today", True) for k in range(12)]
    d = spark.createDataFrame(rows, "id long, title string, content_text string, location_name string, posted_at string, is_active boolean").withColumn("fetched_at_utc", now)
    jobs = stored(engine.enrich(d, now), "round3-jobs")
    q = engine.RankQuery("I build things with tools and care for years of SQL work.", now=now, candidates=5, candidate_fraction=1.0)
    asked = []

    def clouds(candidates):
        asked.append(candidates.count())
        return engine.job_clouds(candidates)

    got = engine.rank(jobs.join(engine.job_vectors(jobs), "id"), q, clouds=clouds)
    pick = ["id", "word_distance", "phrase_distance", "final_rank"]
    plain = lambda df: sorted((r["id"], round(r["word_distance"], 6), round(r["phrase_distance"], 6), r["final_rank"] or 0) for r in df.select(*pick).collect())
    assert asked == [5] and plain(got) == plain(engine.rank(jobs, q))


def _windows(df):
    """What each window of the plan is partitioned by and the sorts of the plan."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Window \[.*?\], \[([^\]]*)\]", plan), re.findall(r"Sort \[.*", plan), plan


def test_packaged_results_sort_no_text(spark):
    m = spark.range(100).selectExpr("id % 2 AS query_id", "id AS job_id", "id % 7 AS s", "repeat('x', 4000) AS t")
    out = artifacts.packaged(m.drop("t"), [F.desc("s"), F.col("job_id")], 2, F.expr("repeat(string(job_id), 3000)"), more=3)
    assert {(r["query_id"], r["place"], r["section"], len(r["preview"])) for r in out.collect()} == {(q, k, "top" if k < 3 else "more", 2500) for q in (0, 1) for k in range(1, 6)}
    plan = registry.QUERIES["packaged_results"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "repeat(" in plan and plan.index("repeat(") < plan.index("Window [")
    kept = artifacts.packaged(m, [F.desc("s"), F.col("job_id")], 2, "t", more=3)
    assert "t" not in kept.columns and all(len(r["preview"]) == 2500 for r in kept.collect())


def test_bad_fit_sorts_no_whole_query(spark):
    rows = [(q, j, float((j * 7) % 5), None if j % 4 == 0 else float(j % 3)) for q in (1, 2, None) for j in range(23)]
    m = spark.createDataFrame(rows, "query_id int, job_id long, a double, b double")
    out = ranking.bad_fit(m, {"a": -1, "b": 1}, 0.3)
    want = {}
    for q in (1, 2, None):
        for c, d in ((2, -1), (3, 1)):
            have = sorted((r[c] * d, r[1]) for r in rows if r[0] == q and r[c] is not None)
            for k, (_, j) in enumerate(have):
                want[q, j] = want.get((q, j), 0) + (k < max(1, int(len(have) * 0.3)))
    assert {(r["query_id"], r["job_id"]): r["flag_count"] for r in out.collect()} == want
    assert all("_range" in by for by in _windows(out)[0])


def test_results_rank_without_whole_queries(spark):
    for name in ("final_rows", "multi_metric_badfit"):
        df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert all("_range" in by for by in _windows(df)[0]), name


def test_buckets_are_written_by_all_tasks(spark, tmp_path):
    path = str(tmp_path)
    store.merge(spark, path, spark.range(4000).selectExpr("id", "id AS v"), ["id"], buckets=2)
    files = [p.parent.name for p in Path(path).rglob("data/**/*.parquet")]
    assert Counter(files) == {"bucket=0": 2, "bucket=1": 2}  # four shuffle partitions; one task a bucket before
    store.delete(spark, path, spark.range(0, 4000, 2), ["id"], buckets=2)
    store.merge(spark, path, spark.range(3990, 4010).selectExpr("id", "-1L AS v"), ["id"], buckets=2)
    want = {k: k for k in range(1, 3990, 2)} | dict.fromkeys(range(3990, 4010), -1)
    rows = store.read(spark, path).collect()
    assert len(rows) == len(want) and {r["id"]: r["v"] for r in rows} == want


def test_refreshed_profiles_do_not_store_texts(spark, tmp_path, monkeypatch):
    kept, now = [], F.expr("TIMESTAMP '2024-02-01 00:00:00'")
    monkeypatch.setattr(profiles, "stored", lambda df, name: kept.append(df.columns) or stored(df, name))
    d = spark.createDataFrame([(k, f"text {k}") for k in range(20)], "id long, body string")
    make = lambda rows: rows.select("id", F.length("body").alias("n"))
    refresh = lambda d: {r["id"]: (r["n"], r["text_sha256"]) for r in profiles.refreshed(spark, str(tmp_path), d, "id", "body", make, "v1", "m", now, 4).collect()}
    refresh(d)
    got = refresh(d.withColumn("body", F.when(F.col("id") % 3 == 0, F.lit("longer text")).otherwise(F.col("body"))))
    assert {k: v[0] for k, v in got.items()} == {k: 11 if k % 3 == 0 else len(f"text {k}") for k in range(20)}
    assert got[3][1] == hashlib.sha256(b"longer text").hexdigest() and got[4][1] == hashlib.sha256(b"text 4").hexdigest()
    assert kept and not any("body" in c for c in kept)


def test_tfidf_shuffles_words_of_blocks_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(features, "BLOCK", 40)  # many blocks
    texts = ["a bb cc bb", None, "", "the of", "bb dd's ee ff gg hh ii jj kk", "cc cc dd's", "BB Eeé x1zz bb"]
    rows = [*enumerate(texts), (5, "bb ee ff"), (None, "mm nn bb"), (None, "nn oo")]  # keys that stand twice are one document
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sf = folder(spark, tmp_path, documents=d)
    out = registry.QUERIES["tfidf_top"](spark, sf)
    want = by_sql("tfidf_top", sf, "documents").fetchall()
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str) and len({r[0] for r in want}) == 5
    assert features.tfidf(d.limit(0), "doc_id", "text").count() == 0 and features.tfidf(d.filter("doc_id in (1, 2, 3)"), "doc_id", "text").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_k" not in plan and "Join" not in plan  # a row a word of a document went by key, by word and by key before
