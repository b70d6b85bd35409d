"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two link if at most `distance` differ. Of two such
fingerprints, one 32-bit half differs in at most distance // 2 bits, so some word
z lies within half of that from both. The anchors of a half are the words of a
covering code: the product of the perfect [23,12] Golay code (covering radius 3),
the perfect [7,4] Hamming code (radius 1) and two plain bits, 2**18 anchors of
radius 4. Every word has one nearest anchor, so replicating each half to the
nearest anchors of all words within the half threshold (that is, to anchors within
covering radius plus threshold) makes every linked pair meet at the anchor of z.
The threshold is met from both sides, which needs about 10 anchors a half in place
of the 57 that replicating one side alone would take. Fingerprints are compared
per anchor; each anchor gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import refuse, small, stored, tune_arrow
from .components import components
from .textkernel import LOWER, Words, slices

#: Anchors with more distinct fingerprints than this are compared in tiles of so many, each tile in a task of its own.
TILE = 4096


def _rows_sum(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(bits, at, axis=0, dtype=np.int32)


def fingerprints(texts: pa.Array, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The SimHash of each text: A-Z lower-cased, words joined by one space, XXH64 of
    every run of `shingle` words, repeats included (fewer words: of the whole
    sequence); a bit is set if over half the hashes have it. No words, null: 0."""
    out = np.zeros(len(texts), np.uint64)
    for first, n, data, off in slices(texts, 1 << 20):
        w = Words(data, off)
        if not len(w.start):
            continue
        # Each word with one space behind it.
        length = w.end - w.start
        place = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length + 1, out=place[1:])
        flat = np.full(place[-1], 32, np.uint8)
        keep = np.ones(place[-1], bool)
        keep[place[1:] - 1] = False
        flat[keep] = LOWER[data[w.solid]]
        has = np.flatnonzero(w.count)
        runs = np.maximum(w.count[has] - shingle + 1, 1)
        at = np.zeros(len(has) + 1, np.int64)
        np.cumsum(runs, out=at[1:])
        begin = np.arange(at[-1]) + np.repeat(w.first[:-1][has] - at[:-1], runs)
        finish = np.minimum(begin + shingle, np.repeat(w.first[1:][has], runs))
        joined, digest = flat.tobytes(), xxhash.xxh64_intdigest
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(place[begin].tolist(), (place[finish] - 1).tolist(), strict=True)), np.uint64, len(begin))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = _rows_sum(bits, at[:-1]) * 2 > runs[:, None]
        out[first + has] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """docs with its text column replaced by the fingerprint, a long of the same bits.
    Other columns pass through; one with the fingerprint's name raises."""
    columns = [c for c in docs.columns if c != text]
    refuse(columns, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(b.column(b.schema.get_field_index(text))).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in columns), pa.array(fp)], names=[*columns, name])

    tune_arrow(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"`{name}` long"]))


def _golay() -> np.ndarray:
    """For each 11-bit syndrome, the error of least weight (at most 3 bits)."""
    leader = np.zeros(1 << 11, np.uint32)
    for k in (3, 2, 1, 0):
        for bits in combinations(range(23), k):
            e = sum(1 << b for b in bits)
            leader[_syndrome(np.array([e], np.uint32))[0]] = e
    return leader


def _syndrome(v: np.ndarray) -> np.ndarray:
    """v modulo the Golay generator x^11+x^9+x^7+x^6+x^5+x+1."""
    v = v.copy()
    for b in range(22, 10, -1):
        v ^= np.where(v >> np.uint32(b) & np.uint32(1), np.uint32(0xAE3 << (b - 11)), np.uint32(0))
    return v


def _hamming() -> np.ndarray:
    """The nearest word of the [7,4] Hamming code to each 7-bit word, as a number below 16."""
    words = [c for c in range(128) if not np.bitwise_xor.reduce([i + 1 for i in range(7) if c >> i & 1] or [0])]
    return np.array([min(range(16), key=lambda k: (v ^ words[k]).bit_count()) for v in range(128)], np.uint32)


_tables: tuple[np.ndarray, np.ndarray] | None = None


def nearest_anchor(half: np.ndarray) -> np.ndarray:
    """The 18-bit number of the anchor nearest to each 32-bit word."""
    global _tables
    if _tables is None:
        _tables = _golay(), _hamming()
    leader, ham = _tables
    v = half & np.uint32(0x7FFFFF)
    code = (v ^ leader[_syndrome(v)]) >> np.uint32(11)  # the upper 12 bits name a code word
    return code << np.uint32(6) | ham[half >> np.uint32(23) & np.uint32(0x7F)] << np.uint32(2) | half >> np.uint32(30)


def anchors(fp: np.ndarray, distance: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor that each fingerprint is replicated to; bit 18 tells the half."""
    flips = [sum(1 << b for b in bits) for k in range(-(-(distance // 2) // 2) + 1) for bits in combinations(range(32), k)]
    flips = np.array(flips, np.uint32)
    rows, found = [], []
    for half in (0, 1):
        word = (fp >> np.uint64(32 * half)).astype(np.uint32)
        a = np.sort(nearest_anchor((word[:, None] ^ flips[None, :]).ravel()).reshape(len(fp), -1), axis=1)
        new = np.ones(a.shape, bool)
        new[:, 1:] = a[:, 1:] != a[:, :-1]
        r, _ = np.nonzero(new)
        rows.append(r)
        found.append(a[new].astype(np.int64) | half << 18)
    return np.concatenate(rows), np.concatenate(found)


def link(key: np.ndarray, fp: np.ndarray, node: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each run of equal keys (key is sorted)."""
    n = len(key)
    parent = np.arange(n)
    here, left, right = np.arange(n), [], []
    for d in range(1, n):
        here = here[here + d < n]
        here = here[key[here] == key[here + d]]
        if not len(here):
            break
        near = here[np.bitwise_count(fp[here] ^ fp[here + d]) <= distance]
        near = near[(parent[near] != parent[near + d]) & (node[near] != node[near + d])]
        for a in near.tolist():
            x, y = a, a + d
            while parent[x] != x:
                x = int(parent[x])
            while parent[y] != y:
                y = int(parent[y])
            if x != y:
                parent[max(x, y)] = min(x, y)
                left.append(a)
                right.append(a + d)
        if len(near):
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
    return node[np.array(left, np.int64)], node[np.array(right, np.int64)]


def _group(anchor: Column, own: Column, other: Column) -> Column:
    """The key of a group: an anchor, or a pair of tiles of a large one above the anchor's 19 bits (up to 2**20 tiles)."""
    low, high = F.least(own, other).cast("long"), F.greatest(own, other).cast("long")
    return anchor.cast("long") + (low * F.lit(1 << 20) + high) * F.lit(1 << 19)


def links(nodes: DataFrame, distance: int = 4, tile: int = TILE) -> DataFrame:
    """nodes has distinct fp and node (long): edges (u, v) that connect whatever links connect."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, node = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            for i in range(0, len(fp), 8192):
                row, anchor = anchors(fp[i : i + 8192], distance)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[i:][row].view(np.int64)), pa.array(node[i:][row])], names=["anchor", "fp", "node"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(k: np.ndarray, f: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            u, w = link(k, f.view(np.uint64), v, distance)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(w)], names=["u", "v"])

        kept: list[tuple] = []
        for b in batches:
            part = tuple(b.column(i).to_numpy() for i in range(3))
            if not len(part[0]):
                continue
            if kept and kept[-1][0][-1] != part[0][-1]:
                k, f, v = (np.concatenate(x) for x in zip(*kept, part, strict=True))
                cut = int(np.searchsorted(k, k[-1]))
                yield found(k[:cut], f[:cut], v[:cut])
                kept = [(k[cut:], f[cut:], v[cut:])]
            else:
                kept.append(part)
        if kept:
            yield found(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    tune_arrow(nodes.sparkSession)
    at = stored(nodes.select("fp", "node").mapInArrow(replicate, "anchor long, fp long, node long"), "simhash-anchors")
    hot = at.groupBy("anchor").agg(F.count("*").alias("_n")).filter(F.col("_n") > tile)
    hot = small(hot.select(F.col("anchor").alias("_anchor"), F.ceil(F.col("_n") / tile).cast("int").alias("_m")))
    rows = at.join(hot, F.col("anchor") == F.col("_anchor"), "left")
    own = F.pmod(F.xxhash64("fp"), F.col("_m")).cast("int")
    other = F.explode(F.when(F.col("_m").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_m") - 1)))
    rows = rows.withColumn("_own", F.coalesce(own, F.lit(0))).withColumn("_other", other)
    rows = rows.select(_group(F.col("anchor"), F.col("_own"), F.col("_other")).alias("key"), "fp", "node")
    rows = rows.repartition("key").sortWithinPartitions("key", "fp")
    return rows.mapInArrow(compare, "u long, v long")


def grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = 4) -> DataFrame:
    """What classes returns, and root: a fingerprint that names the component, with ids or without."""
    slim = stored(with_fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))), "simhash-fp")
    nodes = stored(slim.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    # Fingerprints are the nodes, so that those without an id link too.
    found = components(links(nodes.select("fp", F.col("fp").alias("node")), distance))  # nodes without links are not in it
    linked = stored(found.join(nodes, F.col("node") == F.col("fp")).select(F.col("node").alias("_node"), F.col("component_id").alias("_root"), "least_id"), "simhash-linked")
    least = stored(linked.groupBy(F.col("_root").alias("_of")).agg(F.min("least_id").alias("_least")), "simhash-least")
    linked = stored(linked.join(least, F.col("_root") == F.col("_of")).select("_node", "_root", "_least"), "simhash-roots")
    # A linked fingerprint has its component's id, null if that has none; any other its own.
    named = nodes.join(linked, F.col("fp") == F.col("_node"), "left").select(F.col("fp").alias("_fp"), F.when(F.col("_node").isNull(), F.col("least_id")).otherwise(F.col("_least")).alias("component_id"), F.coalesce("_root", "fp").alias("root"))
    named = stored(named, "simhash-classes")
    return slim.join(named, F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "component_id", "root")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every document.

    Equal fingerprints are one node, so copies cost one row each. Texts without
    words and null texts have fingerprint 0 and link like any other. Rows with a
    null doc_id keep it and get their component's smallest id (null if it has none);
    repeated rows are returned as often as they stand. An empty table gives none."""
    return grouped(docs, text, doc_id, distance).drop("root")
