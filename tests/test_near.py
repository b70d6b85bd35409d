"""Nearest neighbours, density clusters, components and running sums against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.operators import components, near, ordered
from vacantia.session import stored


def unit(v):
    v = np.asarray(v, float)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def plain_dbscan(ids, v, eps, least):
    """Point by point in the order of ids, as the textbook has it."""
    order = np.argsort(ids)
    u = unit(v)[order]
    close = 1 - np.clip(u @ u.T, -1, 1) <= eps
    core = close.sum(1) >= least
    label, k = np.full(len(u), -1), 0
    for i in range(len(u)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = k
            while todo:
                for j in np.flatnonzero(close[todo.pop()]):
                    if label[j] < 0:
                        label[j] = k
                        if core[j]:
                            todo.append(j)
            k += 1
    return {int(ids[o]): int(c) for o, c in zip(order, label, strict=True)}


def clouds(n, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(7, 6))
    v = centres[r.integers(7, size=n)] + r.normal(size=(n, 6)) * r.choice([0.05, 0.35, 1.5], n)[:, None]
    v[n // 2 : n // 2 + 9] = v[0]  # copies
    return r.permutation(10 * n)[:n], v


def frame(spark, ids, v, q):
    return spark.createDataFrame([(int(a), [float(x) for x in b], c, "x") for a, b, c in zip(ids, v, q, strict=True)], "id long, v array<double>, q string, unit string").repartition(4)


@pytest.mark.parametrize(("eps", "least", "tile"), [(0.08, 4, 2048), (0.15, 3, 7)])
def test_dbscan_of_each_query(spark, monkeypatch, eps, least, tile):
    monkeypatch.setattr(near, "TILE", tile)
    ids, v = clouds(120, 1)
    q = [None if k % 3 == 0 else str(k % 3) for k in range(120)]
    got = near.dbscan(frame(spark, ids, v, q), "id", "v", eps, least, by="q", pivots=9).collect()
    assert len(got) == 120
    for name in {None, "1", "2"}:
        own = [k for k in range(120) if q[k] == name]
        want = plain_dbscan(ids[own], v[own], eps, least)
        assert {r["id"]: r["cluster"] for r in got if r["q"] == name} == want
        assert len(set(want.values())) > 2


def test_dbscan_edges(spark):
    v = [[0.0, 0.0], [0.0, 0.0], [1.0, 0.0], [1.0, 0.0], [1.0, 0.001], [-1.0, 0.0]]
    d = frame(spark, range(6), v, "abcdef")
    assert {r["id"]: r["cluster"] for r in near.dbscan(d, "id", "v", 0.1, 3).collect()} == {0: -1, 1: -1, 2: 0, 3: 0, 4: 0, 5: -1}
    assert {r["cluster"] for r in near.dbscan(d.filter("id < 2"), "id", "v", 0.1, 3).collect()} == {-1}
    assert near.dbscan(d.limit(0), "id", "v", 0.1, 3).count() == 0
    with pytest.raises(ValueError, match="eps"):
        near.dbscan(d, "id", "v", 1.0, 3)


def test_nearest_prunes_and_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(near, "TILE", 40)
    ids, v = clouds(300, 2)
    left, pool = frame(spark, ids[:200], v[:200], ["a"] * 200), frame(spark, ids[200:], v[200:], ["b"] * 100)
    got = {r["id"]: r for r in near.nearest(left, pool, "id", "v", pivots=12).collect()}
    want = 1 - (unit(v[:200]) @ unit(v[200:]).T).max(1)
    assert len(got) == 200 and all(abs(got[int(i)]["nearest"] - w) < 1e-9 for i, w in zip(ids[:200], want, strict=True))
    assert sum(r["compared"] for r in got.values()) < 0.7 * 200 * 100


def test_nearest_edges(spark):
    d = frame(spark, range(4), [[0.0, 0.0], [1.0, 0.0], [0.0, 2.0], [-1.0, 0.0]], "abcd")
    pool = lambda *v: frame(spark, range(len(v)), v, "x" * len(v))
    at = lambda p: {r["id"]: round(r["nearest"], 9) for r in near.nearest(d, p, "id", "v").collect()}
    assert at(pool([3.0, 0.0])) == {0: 1.0, 1: 0.0, 2: 1.0, 3: 2.0}
    assert at(pool([3.0, 0.0], [0.0, 0.0])) == {0: 1.0, 1: 0.0, 2: 1.0, 3: 1.0}
    assert at(pool([0.0, 0.0])) == dict.fromkeys(range(4), 1.0)
    assert at(pool([1.0, 1.0]).limit(0)) == {}


def test_components(spark):
    r = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 80, (60, 2))] + [(100 + k, 101 + k) for k in range(12)] + [(5, 5), (None, 3)]
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    root = {n: n for p in pairs for n in p if n is not None}
    for _, (a, b) in itertools.product(range(80), pairs):
        if a is not None and root[a] != root[b]:
            root[a] = root[b] = min(root[a], root[b])
    joined = {n for a, b in pairs if a is not None and a != b for n in (a, b)}
    assert got == {n: root[n] for n in joined}


def test_running_sums_and_pool_shares(spark):
    r = np.random.default_rng(5)
    rows = [("g" if k % 3 else None, int(v), bool(r.integers(2))) for k, v in enumerate(r.integers(-40, 40, 400))]
    d = spark.createDataFrame(rows, "g string, v int, p boolean").repartition(5)
    got = {(x["g"], x["v"]): (x["upto"], x["total"]) for x in ordered.running(d.groupBy("g", "v").agg(F.count("*").alias("n")), "v", F.col("n"), ["g"]).collect()}
    assert got == {(g, v): (sum(h == g and w <= v for h, w, _ in rows), sum(h == g for h, _, _ in rows)) for g, v, _ in rows}
    pool = [v for _, v, p in rows if p]
    shares = ordered.with_pool_shares(d, "v", F.col("p")).collect()
    assert len(shares) == 400 - len(pool)
    assert all(x["pct"] == pytest.approx(100 * sum(w <= x["v"] for w in pool) / len(pool)) for x in shares)
    assert {x["pct"] for x in ordered.with_pool_shares(d.filter("NOT p"), "v", F.col("p")).collect()} == {None}
    places = ordered.numbered(d.select("v").distinct(), "v").collect()
    assert [x["place"] for x in sorted(places)] == list(range(len(places)))


@pytest.mark.parametrize("wide", [True, False])
def test_dbscan_in_wide_tiles_and_in_cells(spark, monkeypatch, wide):
    for name, value in (("TILE", 7), ("WIDE", 9), ("STRIP", 4), ("_pairs_of_all", lambda rows: 0 if wide else 10**9)):
        monkeypatch.setattr(near, name, value)
    ids, v = clouds(90, 5)
    q = [None if k % 3 == 0 else str(k % 3) for k in range(90)]
    got = near.dbscan(frame(spark, ids, v, q), "id", "v", 0.12, 3, by="q", pivots=9).collect()
    assert len(got) == 90
    for name in {None, "1", "2"}:
        own = [k for k in range(90) if q[k] == name]
        assert {r["id"]: r["cluster"] for r in got if r["q"] == name} == plain_dbscan(ids[own], v[own], 0.12, 3)


def test_dbscan_makes_no_copies_for_cells_that_prune_little(spark, monkeypatch):
    names = []
    monkeypatch.setattr(near, "stored", lambda df, name: names.append(name) or stored(df, name))
    d = spark.createDataFrame([(k, np.random.default_rng(k).normal(size=32).tolist()) for k in range(60)], "id long, v array<double>")
    near.dbscan(d, "id", "v", 0.74, 4, pivots=16).count()
    assert "dbscan-links" in names and "dbscan-visitors" not in names
    names.clear()
    apart = d.withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.when(i == F.col("id") % 8, 1.0).when(i == 31, F.col("id") / 10000).otherwise(0.0)))
    near.dbscan(apart, "id", "v", 0.1, 3, pivots=16).count()
    assert "dbscan-visitors" in names
