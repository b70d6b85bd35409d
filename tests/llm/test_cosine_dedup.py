"""Links, classes and bounds of embeddings against all pairs."""

import numpy as np
import pytest

from vacantia.llm import cosine_dedup


def plain(rows, threshold=0.9):
    """(vec_id, n_links, component_id, kept) by all pairs of rows."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows]
    n = len(rows)
    near = [set() for _ in rows]
    unit = [np.array(v, float) / max(abs(x) for x in v) if ok[i] else None for i, (_, v) in enumerate(rows)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] / np.sqrt(unit[i] @ unit[i]) / np.sqrt(unit[j] @ unit[j]) >= threshold:
                near[i].add(j)
                near[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, node string").repartition(4)
    return sorted((tuple(r) for r in cosine_dedup.classes(df, **kw).collect()), key=repr)


def groups(n, width, seed):
    """Chains and clouds around a few centres, near the threshold and far from it."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, width))
    x = centres[r.integers(12, size=n)] + r.normal(size=(n, width)) * r.choice([0.01, 0.3, 0.45, 2.0], n)[:, None]
    return [(int(i), v.tolist()) for i, v in zip(r.permutation(n), x, strict=True)]


@pytest.mark.parametrize(("width", "threshold"), [(3, 0.99), (64, 0.9), (64, 0.8)])
def test_as_all_pairs(spark, width, threshold):
    rows = groups(240, width, width)
    assert run(spark, rows, threshold=threshold) == plain(rows, threshold)


def test_copies_nulls_and_odd_vectors(spark):
    rows = groups(40, 8, 3)
    rows += [(1000 + k, rows[0][1]) for k in range(25)] + [(k, [2 * x for x in rows[1][1]]) for k in (2000, 2000, None)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 8), (3003, [-0.0] * 8), (3004, [None] + [1.0] * 7), (3005, [float("nan")] * 8), (3006, [float("inf")] * 8)]
    rows += [(3007, [1e300] * 8), (3008, [1e-300] * 8), (None, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None), (4000, [1.0] * 9)]
    assert run(spark, rows) == plain(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, None)]) == [(5, 0, 5, True)]


def test_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(cosine_dedup, "TILES", 23)
    rows = groups(160, 16, 9)
    assert run(spark, rows) == plain(rows)


def test_bounds_hold_and_few_pairs_are_open():
    r = np.random.default_rng(4)
    for width in (2, 64, 2500):
        base = r.normal(size=(1, width))
        x = base + r.normal(size=(300, width)) * r.choice([0.2, 0.3, 0.34, 0.5], 300)[:, None]
        u = x / np.sqrt((x * x).sum(1, keepdims=True))
        q, scale, error = cosine_dedup.quantised(u)
        true = u @ u.T
        near = cosine_dedup.products(q, q) / scale[:, None] / scale[None, :]
        assert (cosine_dedup.products(q, q) == q.astype(np.int64) @ q.astype(np.int64).T).all()
        assert (np.abs(true - near) <= error[:, None] + error[None, :] + error[:, None] * error[None, :]).all()
        want = {(i, j) for i, j in zip(*np.nonzero(true >= 0.9), strict=True) if i < j}
        got = {(int(i), int(j)) for a, b in cosine_dedup.linked(u, u, True, 0.9) for i, j in zip(a, b, strict=True)}
        assert got == want and 0 < len(want) < 300 * 299 / 2


def test_blocks_join(monkeypatch):
    monkeypatch.setattr(cosine_dedup, "BLOCK", 64)
    r = np.random.default_rng(2)
    u = r.normal(size=(90, 2))
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    v = u[::-1][:50]
    got = {(int(i), int(j)) for a, b in cosine_dedup.linked(u, v, False, 0.95) for i, j in zip(a, b, strict=True)}
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(u @ v.T >= 0.95)), strict=True))
