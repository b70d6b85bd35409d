import collections

import pytest
from pyspark.sql import functions as F

from vacantia.llm import mixing


def brute_targets(sizes):
    """Reshare the excess by weight until no source is above three times its size."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


@pytest.fixture(scope="module")
def corpus(spark):
    import random

    r = random.Random(3)
    rows = []
    for k in range(900):
        s = "hot" if k % 3 == 0 else r.choice(["a", "b", "Z", "é", None, "tiny"] if k % 50 == 0 else ["a", "b", "Z", "é", None])
        rows.append((k, " ".join(["w"] * int(r.paretovariate(1.1) * 8 % 3000)), s))
    rows += [(9001, None, "a"), (9002, "", "void"), (None, "x y z", "a"), (None, "x y z", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_totals(spark, corpus):
    mix = mixing.fit(corpus)
    rows = mixing.copies(corpus.withColumn("target", F.lit("clash")).withColumn("size", F.lit("clash")), mix).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r["source"]] += len((r["text"] or "").split())
        taken[r["source"]] += r["_size"] * r["_copies"]
        assert 0 <= r["_copies"] <= 3 and 0 <= r["_rate"] <= 3
    want = brute_targets(sizes)
    for r in rows:
        assert r["_target"] == pytest.approx(want[r["source"]]) and r["_source_size"] == sizes[r["source"]]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(3, 0.02 * t), (s, taken[s], t)
    again = mixing.copies(corpus.repartition(7), mixing.fit(corpus.repartition(5)))
    assert sorted(map(str, (r["_copies"] for r in again.orderBy("doc_id", "text").collect()))) == sorted(str(r["_copies"]) for r in rows)


def test_rates_are_the_tilt_that_meets_the_target(corpus):
    mix = {r["source"]: r for r in mixing.solve(corpus.select(F.col("source"), mixing.words(F.col("text")).alias("size")).groupBy("source", "size").agg(F.count("*").alias("n"))).collect()}
    rows = corpus.select("source", mixing.words(F.col("text")).alias("size")).collect()
    import math

    for s, m in mix.items():
        if m["lambda"] is not None:
            total = sum(r["size"] * min(3.0, math.exp(min(2.0, m["lambda"] * r["size"] / m["mean"]))) for r in rows if r["source"] == s)
            assert total == pytest.approx(m["target"], rel=1e-5)


def test_edges(spark, corpus):
    assert mixing.copies(corpus.limit(0), mixing.fit(corpus.limit(0))).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "s")], "doc_id long, text string, source string")
    assert {r["_copies"] for r in mixing.copies(blank, mixing.fit(blank)).collect()} == {1}
    one = spark.createDataFrame([(1, "a b c", "s")], "doc_id long, text string, source string")
    assert mixing.mixed(one).count() == 1


def test_a_source_of_one_repeated_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    rows = [(1, "w " * 100, "s")] * 1000 + [(k, "w " * (k % 90 + 10), "t") for k in range(2, 900)] + [(None, "x " * 7, "u")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    mix = mixing.fit(docs)
    out = mixing.copies(docs, mix)
    got = {r["source"]: r for r in out.groupBy("source").agg(F.sum(F.col("_size") * F.col("_copies")).alias("taken"), F.count("*").alias("n"), F.first("_target").alias("target")).collect()}
    assert {s: r["n"] for s, r in got.items()} == {"s": 1000, "t": 898, "u": 300}
    assert abs(got["s"]["taken"] - got["s"]["target"]) <= 100 and abs(got["u"]["taken"] - got["u"]["target"]) <= 7
    again = mixing.copies(docs.repartition(3), mix)
    count = lambda d: sorted(map(str, d.groupBy("doc_id", "source", "_copies").count().collect()))
    assert count(out) == count(again)


def test_equal_rows_that_differ_in_a_map_or_another_column(spark):
    rows = [(1, "w " * 50, "s", {"a": 1}, k % 2) for k in range(40)] + [(2, "w " * 10, "t", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>, other int")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.filter("source = 's' AND m['a'] = 1").count() == out.filter("source = 's'").count() > 0


def test_sizes_in_place_of_texts_and_clashes(spark, corpus):
    sizes = corpus.select("doc_id", "source", mixing.words(F.col("text")).alias("size"), F.xxhash64("text").alias("h"))
    by = {"size": "size", "identity": ("doc_id", "source", "h")}
    mix = mixing.fit(sizes, **by)
    assert mixing.copies(sizes, mix, **by).count() == corpus.count()
    with pytest.raises(ValueError):
        mixing.copies(corpus.withColumn("_rate", F.lit(1)), mix)
    with pytest.raises(ValueError):
        mixing.fit(corpus.withColumn("_mix_row", F.lit(1)))
