"""Examples of input and expected output, one row each."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vacantia.functions import clean, extract, location, providers, text, times
from vacantia.operators import features, filters, lifecycle, quality, ranking, vectors


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("written", "country", "region", "status"),
    [
        ("Boston, MA", "US", "MA", "parsed"),
        ("Cambridge, Mass.", "US", "MA", "parsed"),
        ("Boston", "US", "MA", "city_resolved"),
        ("London", "GB", None, "city_resolved"),
        ("Stockholm", "SE", None, "city_resolved"),
        ("Notacityzzzz", None, None, "ambiguous"),
        ("MA", None, None, "ambiguous"),
        ("Remote - United States", "US", None, "remote"),
        ("Remote", None, None, "remote"),
        ("Toronto, Ontario, Canada", "CA", "ON", "parsed"),
        ("US-MA", "US", "MA", "parsed"),
        ("Austin TX", "US", "TX", "parsed"),
        ("Boston, MA | Toronto, ON, Canada", "US", "MA", "multi_location"),
        ("Hybrid - Boston, MA", "US", "MA", "parsed"),
        ("3 Locations", None, None, "unparseable"),
        ("", None, None, "missing"),
        (None, None, None, "missing"),
    ],
)
def test_location(spark, written, country, region, status):
    got = parsed(spark, written)
    assert (got["location_country"], got["location_region"], got["location_parse_status"]) == (country, region, status)


def parsed(spark, written, known=None):
    return location.parse_locations(spark.createDataFrame([(written,)], "place string"), "place", known).first()


def test_location_arrangement_and_segments(spark):
    assert parsed(spark, "Hybrid - Boston, MA")["work_arrangement"] == "hybrid"
    assert parsed(spark, "Remote")["location_segments"] == [(None, None)]
    assert parsed(spark, "Boston | Stockholm")["location_segments"] == [("US", "MA"), ("SE", None)]


def test_location_of_the_most_populous(spark):
    cities = spark.createDataFrame([("Málaga", "ES", None, 500_000), ("MALAGA", "US", "WA", 2_000), ("Springfield", "US", "MO", 5), ("Springfield", "US", "IL", 5), ("Lutz", "DE", None, None)], "name string, country string, region string, population long")
    known = location.places(spark, cities)
    assert parsed(spark, "málaga", known)["location_country"] == "ES"
    assert parsed(spark, "Springfield", known)["location_region"] == "IL"
    assert parsed(spark, "lutz", known)["location_parse_status"] == "city_resolved"


def test_location_rows_and_columns_are_kept(spark):
    rows = [(1, "Remote", "old"), (2, "Remote", None), (2, "Remote", None), (3, None, "x")]
    d = location.parse_locations(spark.createDataFrame(rows, "id int, place string, location_country string"), "place")
    assert sorted((r["id"], r["location_country"], r["location_parse_status"]) for r in d.collect()) == [(1, None, "remote"), (2, None, "remote"), (2, None, "remote"), (3, None, "missing")]
    assert location.parse_locations(spark.createDataFrame([], "place string"), "place").count() == 0


REFERENCE = dt.datetime(2026, 6, 7, 18, 30)


@pytest.mark.parametrize(
    ("written", "expected"),
    [
        ("2026-06-03T08:00:00-04:00", dt.datetime(2026, 6, 3, 12)),
        ("08-Jun-2026", dt.datetime(2026, 6, 8)),
        ("February 20, 2026", dt.datetime(2026, 2, 20)),
        ("June  8, 2026", dt.datetime(2026, 6, 8)),
        ("Posted 9 Days Ago", dt.datetime(2026, 5, 29, 18, 30)),
        ("Posted 30+ Days Ago", dt.datetime(2026, 5, 8, 18, 30)),
        ("Posted Today", REFERENCE),
        ("yesterday", dt.datetime(2026, 6, 6, 18, 30)),
        ("2026", None),
        ("soon", None),
        (None, None),
    ],
)
def test_posted_at(spark, written, expected):
    got = one(spark, times.posted_at(F.lit(written).cast("string"), F.lit("2026-06-07 18:30:00").cast("timestamp")))
    assert (got["status"] == "normalized") == (expected is not None)
    if expected:
        at = one(spark, F.date_format(times.posted_at(F.lit(written).cast("string"), F.lit("2026-06-07 18:30:00").cast("timestamp"))["at"], "yyyy-MM-dd HH:mm"))
        assert at == expected.strftime("%Y-%m-%d %H:%M")


@pytest.mark.parametrize(("hours", "words"), [(9 * 24, "9 days ago"), (6, "6 hours ago"), (24, "yesterday"), (0.5, "just now"), (40 * 24, "1 month ago"), (-5, "Jun 8, 2026"), (500 * 24, "Jan 24, 2025")])
def test_shown(spark, hours, words):
    at = F.lit(str(dt.datetime(2026, 6, 8, 12) - dt.timedelta(hours=hours))).cast("timestamp")
    assert one(spark, times.shown(at, F.lit("2026-06-08 12:00:00").cast("timestamp"))) == words


def test_clean_text():
    assert clean.clean("Requirements:&nbsp;Bachelorâ€™s degree in ﬁnance\r\nＰｙｔｈｏｎ") == "Requirements: Bachelor's degree in finance\nPython"
    once = clean.clean("a\n\n\n\nb")
    assert once == "a\n\nb" and clean.clean(once) == once
    assert clean.clean("  ") is None and clean.clean(None) is None


@pytest.mark.parametrize(
    ("written", "kind"),
    [("Must hold an active TS/SCI clearance with polygraph.", "TS/SCI with Polygraph"), ("No security clearance required.", None), ("Secret clearance preferred", "Secret"), ("Ability to obtain a clearance", "Ability to Obtain Clearance"), ("Public trust position", "Public Trust"), ("Nothing", None)],
)
def test_clearance(spark, written, kind):
    got = one(spark, extract.security_clearance(F.lit(written), F.lit(None).cast("string")))
    assert (got["requires"], got["kind"]) == (kind is not None, kind)


@pytest.mark.parametrize(
    ("content", "needs", "raw", "kind"),
    [("Requires 3-5 years of experience.", None, "3-5", "unspecified"), ("At least 4 years of experience required", None, "4", "required"), ("5+ years with Spark preferred", None, "5+", "preferred"), ("None here", "7+ Java", "7+", "unspecified"), ("None here", None, None, None)],
)
def test_years(spark, content, needs, raw, kind):
    got = one(spark, extract.years_of_experience(F.lit(content), F.lit(needs).cast("string")))
    assert (got["raw"], got["kind"]) == (raw, kind)


def test_requirements(spark):
    body = "About us\nWe are great.\nRequirements:\n* 3 years of experience with SQL\n* Dental and vision\nBenefits\nKnowledge of coffee"
    got = one(spark, extract.requirements(F.lit(body))).split("\n")
    assert got[0] == "3 years of experience with SQL"
    assert not any("Dental" in g for g in got)
    assert any("Knowledge of coffee" in g for g in got)


def test_html_and_tokens(spark):
    assert one(spark, text.html_to_text(F.lit("<ul><li>A &amp; B</li><li>C</li></ul><script>x</script><p>D<br>E</p>"))) == "- A & B\n- C\n D\nE"
    assert one(spark, text.html_to_text(F.lit("<p> </p>"))) is None
    assert one(spark, text.tokens(F.lit("Don't STOP 3 it's"))) == ["don't", "stop", "it's"]
    assert one(spark, text.without_frequent(F.split(F.lit("a b a c"), " "), 1)) == ["b", "c"]


def test_phrases(spark):
    assert one(spark, text.clauses(F.lit("We build tools, and we ship them; yes"))) == ["We build tools", "and we ship them yes"]
    got = one(spark, text.phrase_chunks(F.lit("We build good tools. We ship them fast.")))
    assert got == ["We build good tools.", "We ship them fast.", "We build good tools. We ship them fast."]
    assert one(spark, text.word_windows(F.lit("a b c d e"), 3, 1)) == ["a b c", "c d e"]
    assert one(spark, text.cut_utf8(F.lit("aé"), 2)) == "a"


def test_salary(spark):
    got = one(spark, providers.salary(F.array(F.lit("USD $94,000.00/Yr."), F.lit("$120,000.00"))))
    assert tuple(got) == (94000.0, None, 120000.0, "USD", "year")
    got = one(spark, providers.salary(F.array(F.lit("Minimum $50 Midpoint $60 Maximum $70 Hourly"))))
    assert tuple(got) == (50.0, 60.0, 70.0, "USD", "hour")


def test_quality(spark):
    df = spark.createDataFrame([("a", "Engineer", "abc"), ("a", "", "abcdef"), ("b", None, None)], "k string, title string, t string")
    assert quality.duplicates(df, F.col("k")).first()[0] == 1
    assert df.select(quality.blanks(F.col("title"))).first()[0] == 2
    assert quality.length_profile(df, F.col("t")).first()["p50"] == 4.5
    n = spark.createDataFrame([("1",), ("3",), ("5",), ("x",)], "v string")
    assert quality.numeric_profile(n, F.col("v")).first()["p50"] == 3.0


def test_technology(spark):
    df = spark.createDataFrame([(1, "C programming and Node.js"), (2, "bare C, R"), (3, "R language")], "id long, t string")
    rows = {r["id"]: r["technologies"] for r in features.technologies(df, "id", "t", [("C programming", "lang"), ("R language", "lang"), ("Node.js", "web")]).collect()}
    assert rows == {1: ["C programming", "Node.js"], 2: [], 3: ["R language"]}


def _results(spark, rows):
    return spark.createDataFrame([(1, o, s, j, r) for o, s, j, r in rows], "query_id long, operation string, status string, job_id long, rank double")


def test_fusion(spark):
    r = _results(spark, [("a", "ok", 101, 1.0), ("a", "ok", 202, 2.0), ("b", "ok", 101, 2.0), ("b", "ok", 202, 1.0), ("c", "ok", 101, 1.0), ("c", "ok", 202, 2.0), ("seniority_filter", "ok", 202, 1.0), ("d", "failed", 202, 1.0)])
    left = spark.createDataFrame([(1, 101), (1, 202), (1, 303)], "query_id long, job_id long")
    for mode in ("minimax", "rrf"):
        assert [x["job_id"] for x in ranking.fused(r, left, mode).orderBy("final_rank").collect()] == [101, 202, 303]
    none = ranking.fused(r.limit(0), left).orderBy("final_rank").collect()
    assert [x["job_id"] for x in none] == [101, 202, 303]
    with pytest.raises(ValueError):
        ranking.fused(r, left, "other")


def test_reduction_floor(spark):
    df = spark.createDataFrame([(1, j, float(4 - j), 1.0 if j == 0 else 0.0) for j in range(5)], "query_id long, job_id long, score float, flag double")
    got = ranking.reduced(df, [F.col("score")], ranking.Policy(top_fraction=0.2, least=3))
    assert sorted(r["job_id"] for r in got.collect()) == [2, 3, 4]
    got = ranking.reduced(df, [F.col("job_id")], ranking.Policy(keep_score=1.0, least=3), score="flag")
    assert sorted(r["job_id"] for r in got.collect()) == [0, 1, 2]


def test_outliers(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, 10.0), (1, 2, 5.0)], "query_id long, job_id long, m double")
    good = ranking.good_direction(df, {"m": 1}).orderBy(F.desc("score")).collect()
    assert [r["job_id"] for r in good] == [1, 2, 0]
    far = {r["job_id"]: round(r["score"], 6) for r in ranking.mahalanobis(df, {"m": 1}).collect()}
    assert far[0] == far[1] > far[2]


@pytest.mark.parametrize(("title", "years", "level"), [("Lead Engineer", None, 4.0), ("Engineer", "8", 4.0), ("Engineering Internship", "9", 0.0), ("Engineer", "x", 1.2)])
def test_levels(spark, title, years, level):
    assert one(spark, ranking.bounded_level(F.lit(1.2), F.lit(title), F.lit(years).cast("string"))) == level


def test_wasserstein(spark):
    import numpy as np

    x, y = np.array([[0.0], [1.0]]), np.array([[2.0], [3.0]])
    df = spark.createDataFrame([(1, [[0.0], [1.0]]), (2, [])], "id long, m array<array<float>>")
    got = {r["id"]: r["distance"] for r in vectors.sliced_wasserstein(df, "m", y).collect()}
    assert got[1] == pytest.approx(2.0) and got[2] == float("inf")
    assert vectors._sorted_distance(x, x) == 0
    assert vectors._sorted_distance(x, y) == vectors._sorted_distance(y, x)


def test_filters(spark):
    df = spark.createDataFrame([("a", None, None), ("b", "true", None), ("c", "0", "None"), ("d", None, "Secret")], "t string, requires_clearance string, clearance_type string")
    assert [r["t"] for r in filters.without_clearance(df).orderBy("t").collect()] == ["a", "c"]
    with pytest.raises(ValueError, match="min_years"):
        filters.within_experience(df, 3)
    assert filters.country_code("usa") == "US" and filters.country_code("de") == "DE" and filters.country_code("x") is None


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "x", 1), (2, "b", "y", 1)], "id long, v string, d string, first int")
    new = spark.createDataFrame([(2, "c", 9), (3, "e", 9)], "id long, v string, first int")
    got = [tuple(r) for r in lifecycle.upsert(old, new, ["id"], keep=["first"], reset={"d": ["v"]}).orderBy("id").collect()]
    assert got == [(1, "a", "x", 1), (2, "c", None, 1), (3, "e", None, 9)]


def test_shards(spark, tmp_path):
    from vacantia.sources import files

    df = spark.createDataFrame([(k, dt.datetime(2024, 1, 1 + k % 3, k)) for k in range(10)], "id long, at timestamp")
    got = lifecycle.newest_shards(df, "at", "id", 3, 7).orderBy("recency").collect()
    assert [r["id"] for r in got] == [8, 5, 2, 7, 4, 1, 9]
    assert [r["artifact_shard"] for r in got] == [0, 0, 0, 1, 1, 1, 2]
    files.write_shards(lifecycle.newest_shards(df, "at", "id", 3), str(tmp_path / "s"))
    assert files.read_shard(spark, str(tmp_path / "s"), 1).count() == 3
    assert files.read_shard(spark, str(tmp_path / "s"), 99).count() == 0


def test_stream(spark, tmp_path):
    from vacantia.streaming.front import upsert_stream

    for k, rows in enumerate([[(1, "a", 1), (1, "b", 2)], [(1, "c", 3), (2, "d", 1)]]):
        spark.createDataFrame(rows, "id long, v string, at int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema("id long, v string, at int").parquet(str(tmp_path / "in"))
        upsert_stream(s, str(tmp_path / "out"), str(tmp_path / "ck"), ["id"], "at").awaitTermination(120)
    from vacantia.operators import store

    got = store.read(spark, str(tmp_path / "out"), 1).orderBy("id").collect()
    assert [(r["id"], r["v"]) for r in got] == [(1, "c"), (2, "d")]


def test_boards(spark):
    from vacantia.sources import postings

    raw = spark.createDataFrame([('{"id":"7","text":"T","categories":{"team":"X","location":"L"},"openingPlain":"A","lists":[{"text":"Q","content":"<li>B</li>"}],"createdAt":1700000000999}',)], "raw_json string")
    r = postings.lever(raw).first()
    assert (r["source_job_id"], r["department"], r["content_text"], r["posted_at"]) == ("7", "X", "A\n\nQ\n- B", "2023-11-14T22:13:20+00:00")
    html = spark.createDataFrame([('<script type="application/ld+json">{"@graph":[{"@type":"Thing"},{"@type":"JobPosting","title":"T"}]}</script>',)], "h string")
    assert '"T"' in html.select(postings.json_ld_posting(F.col("h"))).first()[0]
    tags = spark.createDataFrame([('{"data":{"tags10":"b","tags2":"a","x":"c"}}',)], "r string")
    assert tags.select(postings.icims_tags(F.col("r"))).first()[0] == ["a", "b"]
    for board in (postings.greenhouse, postings.ashby, postings.icims, postings.workable, postings.workday):
        assert board(spark.createDataFrame([("{}",), (None,)], "raw_json string")).count() == 2
