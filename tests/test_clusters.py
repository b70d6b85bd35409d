"""Clusters and screens, by example."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.operators import clusters, quality


def _clouds():
    rng = np.random.default_rng(0)
    centre = np.eye(8)[:3]
    return np.concatenate([c + 0.03 * rng.normal(size=(12, 8)) for c in centre]), np.repeat(np.arange(3), 12)


def test_three_clouds(spark, monkeypatch):
    v, truth = _clouds()
    rows = [(q, k, [float(x) for x in v[k]]) for q in (0, 1) for k in range(len(v))]
    d = spark.createDataFrame(rows, "query_id int, job_id int, vector array<double>")
    got = clusters.linked(d, "job_id", "vector", clusters=3).collect()
    by = {(r["query_id"], r["job_id"]): r["cluster"] for r in got}
    assert len(got) == len(rows)
    for q in (0, 1):
        assert len({(by[q, k], truth[k]) for k in range(len(v))}) == 3
    assert clusters.linked(d.limit(0), "job_id", "vector").count() == 0
    monkeypatch.setattr(clusters, "MOST", 4)
    with pytest.raises(Exception, match="4 at most"):
        clusters.linked(d, "job_id", "vector").collect()


def test_asked_in_order_until_enough(spark):
    d = spark.createDataFrame([(q, k, f"{q} {k}") for q in (0, 1) for k in range(8)], "query_id int, job_id int, prompt string")

    def ask(text):
        if text == "1 2":
            raise TimeoutError
        return int(text.split()[1]) % 2 == 1

    got = {(r["query_id"], r["job_id"]): r["status"] for r in clusters.asked(d, ask, "prompt", [F.col("job_id")], 2, 5).collect()}
    assert got == {(0, 1): "ok", (0, 3): "ok"} | {(1, k): "failed" for k in range(8)}


def test_percentiles_against_numpy(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=300).round(2) * 1000, np.zeros(40), rng.integers(-5, 6, 200), [1e-300, -1e300]])
    rows = [(None if k % 3 == 0 else k % 3, float(x)) for k, x in enumerate(v)] + [(7, None), (8, 3.5)]
    d = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: r for r in quality.percentiles(d, F.col("v"), {"p10": 0.1, "p50": 0.5, "p90": 0.9}, ["g"]).collect()}
    assert set(got) == {None, 1, 2, 8}
    for g in got:
        own = [x for k, x in rows if k == g and x is not None]
        for name, p in (("p10", 10), ("p50", 50), ("p90", 90)):
            assert got[g][name] == pytest.approx(np.percentile(own, p), rel=1e-9, abs=1e-9)
    assert quality.percentiles(d.limit(0), F.col("v"), {"p50": 0.5}).count() in (0, 1)


def test_rounds_ask_as_one_by_one(spark):
    rows = [(q, k) for q in (0, 1, 2, None) for k in range(8)]
    d = spark.createDataFrame(rows, "query_id int, job_id int").repartition(3)
    asked = []

    def ask(now):
        asked.extend((r["query_id"], r["job_id"]) for r in now.collect())
        return now.withColumn("accepted", F.when((F.col("query_id") == 1) & (F.col("job_id") == 2), F.lit(None).cast("boolean")).when(F.col("query_id") == 2, F.lit(False)).otherwise(F.col("job_id") % 2 == 1))

    got = {(r["query_id"], r["job_id"]): (r["status"], r["calls"]) for r in clusters.asked_in_rounds(d, ask, [F.col("job_id")], 2, 5).collect()}
    assert got == {(q, k): ("ok", 4) for q in (0, None) for k in (1, 3)} | {(1, k): ("failed", 3) for k in range(8)}
    assert len(asked) == len(set(asked)) == 4 + 3 + 5 + 4
    assert clusters.asked_in_rounds(d.limit(0), ask, [F.col("job_id")], 2, 5).count() == 0


def test_only_finite_ranks_are_fused(spark):
    from vacantia.operators import ranking

    nan, inf = float("nan"), float("inf")
    rows = [(0, "a", "ok", j, r) for j, r in enumerate([1.0, nan, inf, -inf, None, 7.0])]
    d = spark.createDataFrame(rows, "query_id int, operation string, status string, job_id int, rank double")
    assert {(r["job_id"], r["dense"]) for r in ranking.dense_ranks(d, d).collect()} == {(0, 1), (5, 2)}
