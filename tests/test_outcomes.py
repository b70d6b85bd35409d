"""Fetched pages, stored listings and answers, profiles kept in a store, and ranking that reads them."""

import json

from pyspark.sql import functions as F

from vacantia.functions import display
from vacantia.operators import lifecycle, profiles, quality, store
from vacantia.plans import engine
from vacantia.sources import boards


def test_outcomes_of_fetching(spark):
    columns = "id long, content_html string, content_text string, raw_json string, fetch_failed_count int, fetch_last_failed_at timestamp, fetch_last_error_type string, yoe_version string"
    rows = spark.createDataFrame([(1, None, None, None, 2, None, "Old", "v1"), (2, "h", "t", '{"a": [1]}', None, None, None, "v1"), (3, "h", "t", "{}", 1, None, "Old", "v1")], columns)
    tried = spark.createDataFrame([(1, "<p>é\0</p>", "aé\0b", None), (2, None, None, "Timeout"), (9, "x", "x", None)], "id long, html string, text string, error_type string")
    now = F.expr("TIMESTAMP '2024-01-01 00:00:00'")
    got = {r["id"]: r for r in lifecycle.fetched(rows, tried, "id", now, 100, 2).collect()}
    assert set(got) == {1, 2, 3} and got[3]["fetch_failed_count"] == 1 and got[3]["yoe_version"] == "v1"
    assert got[1]["content_html"] == "<p>é</p>" and got[1]["content_text"] == "a" and got[1]["yoe_version"] is None
    assert got[1]["fetch_failed_count"] == 0 and got[1]["fetch_last_error_type"] is None
    assert json.loads(got[1]["raw_json"])["ingestion_size_limits"] == {"content_html_truncated": False, "content_text_truncated": True, "raw_json_omitted": False}
    assert (got[2]["content_text"], got[2]["fetch_failed_count"], got[2]["fetch_last_error_type"], got[2]["raw_json"]) == ("t", 1, "Timeout", '{"a": [1]}') and got[2]["fetch_last_failed_at"] is not None


def test_stored_pages_are_read_as_a_reader_would(spark):
    listings = {
        "a": (7, [[1, 2, 3], [4, 5, 6], [7, 8, 9], [10]]),
        "b": (None, [[1, 2], [3]]),
        "c": (9, [[1, 2], [], [3]]),
        "d": (4, [[], [1, 2], [3, 4]]),
        "e": (3, [[1, "no"], ["no", 2], [3]]),
        "f": (50, [[1]]),
        "g": (0, [[]]),
    }
    jobs = lambda p: [{"id": x} if isinstance(x, int) else x for x in p]
    rows = [(s, k + 1, total, [json.dumps(j) for j in jobs(p)]) for s, (total, pages) in listings.items() for k, p in enumerate(pages)]
    stored = spark.createDataFrame(rows, "source string, page long, total long, jobs array<string>").repartition(3)

    def numbered(source, page, size):
        total, pages = listings[source]
        return 200, json.dumps({"totalCount": total, "jobs": jobs(pages[page - 1]) if page <= len(pages) else []})

    got = {}
    for r in boards.pages_read(stored).orderBy("source", "position").collect():
        got.setdefault(r["source"], []).append((r["position"], json.loads(r["raw_json"])))
    for s in "abcdf":
        assert got.get(s, []) == list(enumerate(boards.numbered_pages(s, numbered, 3))), s
    assert "g" not in got and [j["id"] for _, j in got["e"]] == [1, 2]

    def offset(source, at, size):
        total, pages = listings[source]
        left = [p for k, p in enumerate(pages) if sum(map(len, pages[:k])) >= at]
        return 200, json.dumps({"total": total, "jobPostings": jobs(left[0]) if left else []})

    for most in (None, 1, 2):
        read = boards.pages_read(stored, first_may_be_empty=False, most=most).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("position", "raw_json"))).alias("l")).collect()
        read = {r["source"]: [json.loads(x["raw_json"]) for x in r["l"]] for r in read}
        for s in "acdefg":
            assert read.get(s, []) == list(boards.offset_pages(s, offset, most=most)), (s, most)
    assert boards.pages_read(stored.limit(0)).count() == 0


def test_first_answers(spark):
    c = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    tried = boards.endpoints(c, "id", F.array(F.concat(F.lit("a "), F.col("id").cast("string")), F.lit("z")))
    urls = {(r["id"], r["attempt"]): r["matched_url"] for r in tried.collect()}
    assert len(urls) == 18 and urls[1, 0].endswith("/a%201/jobs")
    rows = [(urls[1, 0], 404, '{"jobs": []}'), (urls[1, 1], 200, '{"jobs": []}'), (urls[1, 2], 200, '{"jobs": [{}]}'), (urls[2, 4], 200, " []"), (urls[2, 0], 200, "broken"), (urls[2, 2], None, None)]
    got = {r["id"]: (r["provider"], r["identifier"]) for r in boards.first_answers(tried, spark.createDataFrame(rows, "url string, status int, body string"), "id").collect()}
    assert got == {1: ("ashby", "a 1"), 2: ("lever", "z"), 3: ("lever", "z")}


def test_summaries_of_nothing_and_of_nulls(spark):
    none = spark.createDataFrame([], "is_active boolean, posted_at string")
    assert quality.posted_summary(none).first().asDict() == {"active_jobs": 0, "has_posted_at": 0, "missing_posted_at": 0, "percent_missing_posted_at": 0.0}
    calls = spark.createDataFrame([(1, None), (1, '{"input_tokens": 3}'), (1, "no json")], "q int, usage string")
    assert quality.usage_totals(calls, ["q"]).first().asDict() == {"q": 1, "calls": 3, "input_tokens": 3, **dict.fromkeys(quality.USAGE[1:], 0)}
    d = spark.createDataFrame([("s", None, " ", "u", None, "x", "f"), ("s", "1", "t", "", "p", None, "f"), ("s", "1", "t", "u", "p", "x", "g")], "source string, source_job_id string, title string, job_url string, location_name string, content_text string, fingerprint string")
    got = quality.connector_summary(d, spark.createDataFrame([("s", "1", "f")], "source string, source_job_id string, fingerprint string"), "source").first().asDict()
    assert got == {"source": "s", "fetched": 3, "unchanged_skipped": 1, "to_upsert": 2, "missing_title": 1, "missing_url": 1, "missing_location": 1, "missing_content_text": 1, "duplicate_source_job_ids": 1}


def test_shown_fields(spark):
    d = spark.createDataFrame([(1, " T ", "", "c", None), (2, " ", "x", "c", None), (3, "T", " ", "c", None)], "id int, title string, company_name string, source_company string, posted_at_utc timestamp")
    got = {r["id"]: r for r in display.rows(d, F.current_timestamp(), keep=["id"]).collect()}
    assert set(got) == {1, 3} and got[1]["title"] == "T" and got[1]["company"] == "c" and got[3]["company"] == "" and got[1]["posted_display"] == "" and got[1]["url"] == ""


def test_profiles_are_made_again_only_if_stale(spark, tmp_path):
    path, calls = str(tmp_path), []
    now = lambda n: F.lit(f"2024-01-0{n} 00:00:00").cast("timestamp")

    def make(rows):
        calls.append(sorted(r["id"] for r in rows.collect()))
        return rows.select("id", F.length("body").alias("n"))

    def refresh(rows, version, n, model="m"):
        d = spark.createDataFrame(rows, "id long, body string")
        return {r["id"]: r for r in profiles.refreshed(spark, path, d, "id", "body", make, version, model, now(n), 4).collect()}

    assert profiles.load(spark, path) is None
    first = refresh([(1, "a"), (2, None), (3, "ccc")], "v1", 1)
    assert {k: r["n"] for k, r in first.items()} == {1: 1, 2: None, 3: 3}
    again = refresh([(1, "a"), (2, ""), (3, "cccc"), (4, "d")], "v1", 2)
    assert again[3]["n"] == 4 and again[3]["created_at"].day == 1 and again[3]["updated_at"].day == 2 and again[4]["created_at"].day == 2
    assert set(refresh([(1, "a")], "v1", 3)) == {1} and calls == [[1, 2, 3], [3, 4]]
    refresh([(1, "a")], "v2", 3)
    refresh([(1, "a")], "v2", 3, "other")
    assert calls[2:] == [[1], [1]]
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "id long")
    profiles.delete(spark, path, ids(1, 4, 99), "id", 4)
    assert sorted(r["id"] for r in profiles.load(spark, path).collect()) == [2, 3]
    profiles.delete(spark, path, ids(1, 2, 3), "id", 4)
    assert profiles.load(spark, path) is None and store.manifest(spark, path) == {}
    assert set(refresh([(7, "x")], "v2", 4)) == {7} and [r["id"] for r in profiles.load(spark, path).collect()] == [7]


def test_ranking_reads_what_is_stored(spark, tmp_path):
    now = F.expr("TIMESTAMP '2024-02-01 00:00:00'")
    rows = [(k, f"Senior builder {k}", "We build " + " ".join(f"thing{j} with tools and care." for j in range(k % 5 + 2)) + f"\nRequirements:\n* at least {k % 6} years of experience with SQL", "Boston, MA", "Posted Today", True) for k in range(12)]
    d = spark.createDataFrame(rows, "id long, title string, content_text string, location_name string, posted_at string, is_active boolean").withColumn("fetched_at_utc", now)
    jobs = engine.enrich(d, now).cache()
    encoded = []

    def encoder(texts):
        encoded.append(len(texts))
        from vacantia.operators.vectors import hashing_encoder

        return hashing_encoder(texts)

    q = engine.RankQuery("I build things with tools and care for years of SQL work.", now=now)
    pick = lambda r: [None if v is None else round(v, 6) if isinstance(v, float) else v for v in r]
    want = [pick(r) for r in engine.rank(jobs, q).orderBy("id").collect()]
    made = profiles.refreshed(spark, str(tmp_path), jobs, "id", "title_requirements_text", lambda rows: engine.job_features(jobs.join(rows.select("id"), "id", "left_semi")), "v1", "m", now, 4)
    ready = jobs.join(made.select("id", "title_requirements_vector", "word_vectors", "phrase_vectors"), "id")
    known = engine.resume_profile(spark, q)
    stored_q = engine.RankQuery(q.resume, now=now, profile=known, encoder=encoder)
    out = engine.rank(ready, stored_q)
    assert [pick(r) for r in out.orderBy("id").collect()] == want and len(want) == 11  # the share of 12
    assert encoded == [len(engine.LEVEL_TEXTS)]  # the anchors of the levels alone
    jobs.unpersist()
