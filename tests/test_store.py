"""Merges that rewrite what they touch, runs that resume, backfills, and reading that stops."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vacantia.operators import lifecycle, store


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("data/**/*.parquet")}


def test_merge_keeps_the_files_it_does_not_touch(spark, tmp_path):
    path = str(tmp_path)
    base = spark.range(400).selectExpr("id", "id * 2 AS v", "'old' AS s")
    store.merge(spark, path, base, ["id"], buckets=16)
    before = files(path)
    batch = spark.createDataFrame([(3, -1, "new"), (1000, 5, "new")], "id long, v long, s string")
    touched = store.merge(spark, path, batch, ["id"], buckets=16, derive={"s": F.upper("s")})
    assert 1 <= len(touched) <= 2
    after = files(path)
    assert before.items() <= after.items()  # no file is rewritten in place
    found = store.manifest(spark, path)
    assert {b for b, v in found.items() if v == 1} == touched and {v for b, v in found.items() if b not in touched} == {0}
    rows = {r["id"]: (r["v"], r["s"]) for r in store.read(spark, path).collect()}
    assert rows[3] == (-1, "NEW") and rows[1000] == (5, "NEW") and len(rows) == 401
    assert {r["id"]: r["v"] for r in store.read(spark, path, 0).collect()} == {k: 2 * k for k in range(400)}
    # The same version again gives the same rows, and touched buckets alone are read.
    store.merge(spark, path, batch, ["id"], 1, buckets=16, derive={"s": F.upper("s")})
    assert {r["id"]: (r["v"], r["s"]) for r in store.read(spark, path).collect()} == rows
    opened = store.read(spark, path, 0, sorted(touched)).inputFiles()
    assert {f.rsplit("bucket=", 1)[1].split("/")[0] for f in opened} == {str(b) for b in touched}


def test_empty_batches(spark, tmp_path):
    path = str(tmp_path)
    none = spark.createDataFrame([], "id long, v long")
    assert store.read(spark, path) is None
    assert store.merge(spark, path, none, ["id"]) == set()
    store.merge(spark, path, spark.createDataFrame([(1, 2)], "id long, v long"), ["id"])
    store.merge(spark, path, none, ["id"])
    assert [tuple(r) for r in store.read(spark, path).collect()] == [(1, 2)]


def test_resumes_after_a_failure(spark, tmp_path):
    units = spark.createDataFrame([(f"u{k}", k) for k in range(6)], "unit string, k int")
    calls = []

    def compute(now, bad=None):
        names = sorted(r["unit"] for r in now.collect())
        calls.extend(names)
        return now.select("unit", F.explode(F.sequence(F.lit(1), F.col("k") + 1)).alias("x"), F.when(F.col("unit") == bad, F.raise_error(F.lit("stopped"))).alias("e"))

    with pytest.raises(Exception, match="stopped"):
        store.run_units(units, str(tmp_path), lambda now: compute(now, "u3"), at_once=2)
    assert {r["unit"] for r in store.finished_units(spark, str(tmp_path)).collect()} == {"u0", "u1"}
    calls.clear()
    out = store.run_units(units, str(tmp_path), compute, at_once=3)
    assert calls == ["u2", "u3", "u4", "u5"]
    assert sorted((r["unit"], r["x"]) for r in out.collect()) == sorted((f"u{k}", x) for k in range(6) for x in range(1, k + 2))
    calls.clear()
    assert store.run_units(units, str(tmp_path), compute).count() == 21 and calls == []


def test_backfill_by_ranges(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.createDataFrame([(k, k % 3, None) for k in range(10, 110)], "id long, v long, ok boolean")
    store.merge(spark, path, rows, ["id"], buckets=8)
    value = F.col("v") > 0
    state = lambda: {r["id"]: r["ok"] for r in store.read(spark, path).collect()}
    assert store.backfill(spark, path, "id", "ok", value, 30, batches=2, buckets=8) == 2
    assert state() == {k: k % 3 > 0 if k < 70 else None for k in range(10, 110)}
    assert store.backfill(spark, path, "id", "ok", value, 30, buckets=8) == 2
    assert state() == {k: k % 3 > 0 for k in range(10, 110)}
    assert store.backfill(spark, path, "id", "ok", value, 30, buckets=8) == 0


def test_reading_stops(spark, tmp_path):
    rows = spark.createDataFrame([(s, k, k % 2 == 0) for s in range(12) for k in range(10)], "shard int, k int, good boolean")
    rows.repartition("shard").write.partitionBy("shard").parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    out = lifecycle.read_until(t, "shard", list(range(12)), F.col("good"), 12, at_once=2)
    want = lifecycle.early_stop(rows, "shard", F.col("good"), 12)
    assert sorted((r["shard"], r["k"]) for r in out.collect()) == sorted((r["shard"], r["k"]) for r in want.collect())
    assert out.select(F.input_file_name()).distinct().count() == 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "shard" in plan.split("PartitionFilters")[1].split("]")[0]
    assert lifecycle.read_until(t, "shard", list(range(12)), F.col("good"), 10_000).count() == 60
