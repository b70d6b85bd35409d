"""What the findings of round 4 were about: each test failed before its change."""

from pyspark.sql import functions as F

from vacantia.functions import extract, location, text
from vacantia.plans import engine, registry
from vacantia.session import stored


def folder(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_forest_judges_documents_without_words(spark, tmp_path):
    texts = {k: "one two " * k + ("?" * k if k % 2 else "") for k in range(5, 60)} | {0: "", 1: " \n\t", 2: None, 3: "", 4: "a"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in texts if k != 3], "doc_id long, quality int")
    sf = folder(spark, tmp_path, documents=d, labels=labels)
    got = {r["doc_id"]: r for r in registry.QUERIES["fitted_forest"](spark, sf).collect()}
    assert got.keys() == texts.keys() and {r["status"] for r in got.values()} == {"ok"}
    assert all(0 <= r["good_probability"] <= 1 for r in got.values())
    assert {k: r["missing_features"] for k, r in got.items() if r["missing_features"]} == {0: 3, 1: 2, 2: 3, 3: 3}


def test_rows_are_not_dealt_by_written_location(spark):
    d = spark.createDataFrame([(k, ["Boston, MA", "London", None][k % 3]) for k in range(30)], "id long, place string")
    out = location.parse_locations(d, "place")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_written" not in plan and "BroadcastHashJoin" in plan  # three forms were three tasks before
    got = {r["place"]: (r["location_country"], r["location_parse_status"]) for r in out.collect()}
    assert out.count() == 30 and got == {"Boston, MA": ("US", "parsed"), "London": ("GB", "city_resolved"), None: (None, "missing")}


def test_vectors_meet_the_keys_of_filtered_jobs_alone(spark, monkeypatch):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    rows = [(k, f"Engineer {k % 5}", f"We build tool {k} with care. Requirements:\n* at least {k % 9} years of experience with SQL", "Boston, MA", "Posted 3 days ago", True) for k in range(30)]
    d = spark.createDataFrame(rows, "id long, title string, content_text string, location_name string, posted_at string, is_active boolean").withColumn("fetched_at_utc", now)
    jobs = stored(engine.enrich(d, now), "round4-jobs")
    made = stored(engine.job_vectors(jobs), "round4-vectors")
    q = engine.RankQuery("I build things with tools and care for years of SQL work.", country="US", max_required_yoe=7, now=now, candidates=8, candidate_fraction=0.9)
    kept = {}
    monkeypatch.setattr(engine, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    plain = lambda df: sorted((r["id"], r["word_distance"], r["phrase_distance"], r["cross_score"], r["is_bad"], r["final_rank"]) for r in df.collect())
    got = plain(engine.rank(jobs, q, made=made))
    assert "content_text_clean" not in kept["rank-nearest"].columns and kept["rank-nearest"].count() == 8
    kept.clear()
    assert got and got == plain(engine.rank(jobs.join(made, "id"), q))


def test_patterns_at_a_word_edge_find_the_same(spark):
    texts = ["5+ Years", "x5 yrs", "inexperience with", "EXPERIENCE WITH", "strong\nskills", "strong people skills", "a401k", "401K", "Bachelor's", "", None, "preferredly", "medical, dental", "ability to", "disability to"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for every in (extract.CUES, extract.NOISE):
        r = d.select(F.col("t").rlike(extract._any(every)).alias("a"), F.col("t").rlike("(?i)" + "|".join(every)).alias("b")).collect()
        assert [x["a"] for x in r] == [x["b"] for x in r] and {True, False} <= {x["a"] for x in r}


def test_pieces_are_collapsed_whatever_their_white_space(spark):
    texts = ["a b. c  d! e", " a", "a ", "a\tb\x0bc", "a  ", "a  b", "x ; y•z", "\n\n", "", None, "one.\n two  three. "]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    want = F.filter(F.transform(F.split("t", extract._SENTENCE), text.collapsed), lambda s: s != "")
    content, none = F.col("t"), F.lit(None).cast("string")
    r = d.select(extract.pieces(content).alias("a"), want.alias("b"), extract.years_of_experience(content, none, want).alias("y"), extract.years_of_experience(content, none).alias("z")).collect()
    assert [x["a"] for x in r] == [x["b"] for x in r] and [x["y"] for x in r] == [x["z"] for x in r]
