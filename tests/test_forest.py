"""Forests as node tables: against MLlib's own answers, against SQL over the nodes, and what cannot be judged."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.operators import forest, matching


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 3))
    kind = np.where(x[:, 0] + 0.3 * x[:, 1] > 0.4, "really_good", np.where(x[:, 2] > 0, "really_bad", "unclear"))
    data = [(k, *[float(v) for v in a], str(c)) for k, (a, c) in enumerate(zip(x, kind, strict=True))]
    data += [(900, None, 0.0, 1.0, None), (901, float("nan"), float("inf"), 1.0, None), (902, None, None, None, None)]
    return spark.createDataFrame(data, "id int, a double, b double, c double, kind string")


def test_fitted_nodes_answer_as_sql_over_them_and_hold_out(spark, rows, tmp_path):
    made = forest.fit(rows.filter("id % 3 <> 0"), ["a", "b", "c"], "kind", bad_threshold=0.4, trees=15, depth=5)
    made.save(spark, str(tmp_path))
    assert forest.load(spark, str(tmp_path)) == made
    out = forest.judged(rows, lambda: forest.load(spark, str(tmp_path))).collect()
    held = [r for r in out if r["id"] % 3 == 0 and r["id"] < 900]
    right = sum((r["kind"] == "really_bad") == r["is_flagged"] for r in held) / len(held)
    assert right > 0.9
    fill = made.fill
    con = duckdb.connect()
    con.execute(f"CREATE VIEW nodes AS SELECT * FROM '{tmp_path}/nodes/*.parquet'")
    con.execute("CREATE TABLE x (id INT, given DOUBLE[])")
    con.executemany("INSERT INTO x VALUES (?, ?)", [(r["id"], [f if v is None or not np.isfinite(v) else v for v, f in zip((r["a"], r["b"], r["c"]), fill, strict=True)]) for r in out])
    want = dict(con.execute("""WITH RECURSIVE w AS (SELECT id, given, tree, 0 AS node FROM x, (SELECT DISTINCT tree FROM nodes)
        UNION ALL SELECT id, given, w.tree, CASE WHEN given[n.feature + 1] <= n.threshold THEN n."left" ELSE n."right" END FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.feature >= 0)
        SELECT id, avg(n.probabilities[1]) FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.feature < 0 GROUP BY id""").fetchall())
    assert made.classes[0] == "really_bad"
    assert all(r["bad_probability"] == pytest.approx(want[r["id"]], abs=1e-12) for r in out)
    assert {r["id"]: r["missing_features"] for r in out if r["id"] >= 900} == {900: 1, 901: 2, 902: 3}
    assert all(sum(r["class_probabilities"].values()) == pytest.approx(1) and (r["rank"], r["status"]) == (1 + r["is_flagged"], "ok") for r in out)


def leaf(*p):
    return (0, 0, -1, None, -1, -1, list(p))


def stump(low, high):
    return [(0, 0, 0, 0.5, 1, 2, None), (0, 1, -1, None, -1, -1, low), (0, 2, -1, None, -1, -1, high)]


def test_binary_threshold_is_inclusive(spark):
    d = spark.createDataFrame([(0, 0.5), (1, 0.7)], "id int, word_distance double")
    out = {r["id"]: r for r in forest.judged(d, lambda: forest.Forest(stump([0.8, 0.2], [0.5, 0.5]), ["word_distance"], ["0", "1"], [0.0], threshold=0.5)).collect()}
    assert (out[0]["is_flagged"], out[1]["is_flagged"], out[0]["class_probabilities"]) == (False, True, None)
    assert out[0]["score"] == pytest.approx(0.8)


def test_three_classes_go_by_name(spark):
    d = spark.createDataFrame([(0, 0.1), (1, 0.9)], "id int, x double")
    model = forest.Forest(stump([0.1, 0.3, 0.6], [0.7, 0.2, 0.1]), ["x"], ["good", "unclear", "really_bad"], [0.0], bad_threshold=0.48125)
    assert {r["id"]: r["is_flagged"] for r in forest.judged(d, lambda: model).collect()} == {0: True, 1: False}


@pytest.mark.parametrize(
    "model",
    [
        forest.Forest([leaf(1.0)], ["x"], ["a"], [0.0], threshold=0.5),
        forest.Forest([leaf(0.5, 0.5)], ["x"], ["a", "b"], [0.0]),
        forest.Forest([leaf(0.5, 0.5)], ["x"], ["a", "b"], [0.0], bad_threshold=0.5),
        forest.Forest([leaf(0.5, 0.5)], ["y"], ["a", "b"], [0.0], threshold=0.5),
        forest.Forest([leaf(0.5)], ["x"], ["a", "b"], [0.0], threshold=0.5),
        forest.Forest([(0, 0, 0, 0.5, 1, 2, None)], ["x"], ["a", "b"], [0.0], threshold=0.5),
        forest.Forest([], ["x"], ["a", "b"], [0.0], threshold=0.5),
        None,
    ],
)
def test_fails_open(spark, model):
    d = spark.createDataFrame([(0, 0.1), (1, 0.9)], "id int, x double")

    def load():
        if model is None:
            raise FileNotFoundError
        return model

    out = forest.judged(d, load).collect()
    assert [(r["is_flagged"], r["bad_probability"], r["rank"]) for r in out] == [(False, None, 1)] * 2
    assert all(r["status"].startswith("failed: ") for r in out)


def test_pool_of_the_newest(spark):
    d = spark.createDataFrame([(j, p, None if j == 4 else j % 3) for j in range(6) for p in range(2)], "job int, phrase int, at int")
    got = matching.of_newest(d, "job", F.col("at"), 3).filter("in_pool").select("job").distinct().collect()
    assert {r[0] for r in got} == {5, 2, 4} - {4} | {1}
