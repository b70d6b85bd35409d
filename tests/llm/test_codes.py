"""Integer k-means codes against a plain version that looks at every entry."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from vacantia.llm import codes


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    """rows: (vec_id, vector, label); (vec_id, code, error) and label errors, digest."""
    kept = [(i, v, c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(scale * float(x)) for x in v], c) for i, v, c in kept]
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in seeds] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    out, errors = [], defaultdict(int)
    for i, v, c in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        errors[c] += error
        out.append((i, c, "".join(f"{k:02x}" for _, k in found), error))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, k, e, errors[c], digest) for i, c, k, e in out), key=repr)


def rows_of(n, width, seed, grain=None):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, width)) * 0.2
    if grain:
        x = np.round(x * grain) / grain  # many ties
    return [(int(i), x[i].tolist(), int(r.integers(3)) if i % 7 else None) for i in r.permutation(n)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, c, "x") for i, v, c in rows], "vec_id long, embedding array<double>, label int, code string").repartition(5)
    return sorted((tuple(r) for r in codes.encoded(df, **kw).collect()), key=repr)


@pytest.mark.parametrize(("width", "grain"), [(16, 4), (32, None), (64, 8)])
def test_as_plain(spark, width, grain):
    rows = rows_of(150, width, width, grain)
    nan, inf = [float("nan")] * width, [float("-inf")] + [0.0] * (width - 1)
    rows += [(900, None, 1), (901, [None] + [0.0] * (width - 1), 1), (902, nan, None), (903, inf, 2)]
    rows += [rows[0], rows[0], (None, rows[3][1], None), (904, [0.0] * width, 0), (905, [-0.0] * width, 0)]
    assert run(spark, rows) == plain(rows)


def test_fewer_than_entries_and_equal_rows(spark):
    rows = rows_of(9, 16, 5) + [(100 + k, [0.25] * 16, None) for k in range(40)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, parts=4, entries=5, rounds=3) == plain(rows, 4, 5, 3)


def test_other_lengths_go(spark):
    rows = rows_of(40, 32, 6)
    odd = [(500, [0.5] * 16, 1), (501, [], 1), (502, [0.5] * 31, 1)]
    assert run(spark, rows + odd) == plain(rows)


def test_empty_and_too_large(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 2)]) == []
    with pytest.raises(Exception, match="scale the vectors down"):
        run(spark, [(1, [1e6] * 16, 2)])


def test_search_visits_equal_bounds():
    r = np.random.default_rng(1)
    for k in range(60):
        entries = r.integers(-3, 4, (int(r.integers(1, 70)), 1 + k % 4))  # repeated entries and equal distances everywhere
        x = r.integers(-4, 5, (300, entries.shape[1]))
        d = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        index, best = codes.Tree(entries).nearest(x)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
