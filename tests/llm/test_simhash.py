import collections
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from vacantia.llm import components, simhash


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_fingerprints(docs):
    texts = [r["text"] for r in docs.collect()]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [brute_print(t) for t in texts]


def test_codes_are_perfect():
    leader = simhash._golay()
    assert len({int(e) for e in leader}) == 2048 and max(int(e).bit_count() for e in leader) == 3
    ham = simhash._hamming()
    assert collections.Counter(ham.tolist()) == {k: 8 for k in range(16)}


@pytest.mark.parametrize("distance", [2, 4])
def test_linked_pairs_share_an_anchor(distance):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    y = x.copy()
    for i in range(500):
        for b in rng.choice(64, distance, replace=False):
            y[i] ^= np.uint64(1 << int(b))
    sets = []
    for v in (x, y):
        row, anchor = simhash.anchors(v, distance)
        s = collections.defaultdict(set)
        for r, a in zip(row.tolist(), anchor.tolist(), strict=True):
            s[r].add(a)
        sets.append(s)
    assert all(sets[0][i] & sets[1][i] for i in range(500))
    assert np.mean([len(s) for s in sets[0].values()]) < 30


@pytest.mark.parametrize("tile", [4096, 8])
def test_components_against_brute_force(spark, tile):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = list(base)
    for k in range(500):
        v = fps[int(rng.integers(0, len(fps)))]
        for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
            v = v ^ np.uint64(1 << int(b))
        fps.append(v)
    fps = np.unique(np.array(fps, np.uint64))
    nodes = spark.createDataFrame([(int(np.int64(v.view(np.int64))), k) for k, v in enumerate(fps)], "fp long, node long")
    got = {r["node"]: r["component_id"] for r in components.components(simhash.links(nodes, 4, tile)).collect()}
    edges = [(a, b) for a in range(len(fps)) for b in range(a) if int(fps[a] ^ fps[b]).bit_count() <= 4]
    want = groups(range(len(fps)), edges)
    assert {n: got.get(n, n) for n in want} == want


def test_long_chains(spark):
    edges = spark.range(1, 400).selectExpr("id as u", "id - 1 as v")
    assert {r["component_id"] for r in components.components(edges).collect()} == {0}
    assert components.components(edges.limit(0)).count() == 0


def test_classes(docs, empty):
    rows = simhash.classes(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[0] == by[1] == by[2] == 0  # no words: linked like any other
    assert by[4] == by[5] == 4
    assert simhash.classes(empty).count() == 0


def test_fingerprints_of_null_ids_link(spark, monkeypatch):
    # 7 and 9 link through a row without an id alone; the fourth row's component has no id.
    rows = [(7, 0b1111 << 8), (None, 0), (9, 0b1111 << 20), (None, (1 << 40) * 0xFFFF), (3, (1 << 60) - 1)]
    monkeypatch.setattr(simhash, "with_fingerprints", lambda d: d.select("doc_id", d["text"].cast("long").alias("fp")))
    docs = spark.createDataFrame([(k, str(v)) for k, v in rows], "doc_id long, text string")
    got = {r["fp"]: r["component_id"] for r in simhash.classes(docs).collect()}
    assert got == {0b1111 << 8: 7, 0: 7, 0b1111 << 20: 7, (1 << 40) * 0xFFFF: None, (1 << 60) - 1: 3}


def test_groups_of_very_many_tiles(spark):
    from pyspark.sql import functions as F

    at = [(7, 2048, 5000), (7, 5000, 2048), (7, 4999, 5000), ((1 << 19) - 1, (1 << 20) - 1, (1 << 20) - 1), (7, 0, 0), (8, 0, 0)]
    rows = spark.createDataFrame(at, "anchor long, own int, other int")
    got = [r[0] for r in rows.select(simhash._group(F.col("anchor"), F.col("own"), F.col("other"))).collect()]
    assert got == [a + (min(i, j) * (1 << 20) + max(i, j)) * (1 << 19) for a, i, j in at] and len(set(got)) == 5
