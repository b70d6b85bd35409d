"""Embedding near-duplicates: tile products of 8-bit vectors with error bounds.

Equal vectors are one node with a weight. Nodes are dealt into tiles by hash, and
each pair of tiles is one group. There, unit vectors are rounded to 8-bit integers
with a scale of their own; one matrix product of the integers (exact: float32 holds
the sums of 1,024 products) gives every dot product up to the rounding. With e the
length of a vector's rounding error, the true cosine differs from the product by at
most e_x + e_y + e_x e_y. Pairs surely above or below the threshold are decided by
that bound; the others, and only they, are computed again in double precision.

A group returns, for each node with links, the number of its links and one node
that it hangs together with, never the links themselves, so dense groups of
near copies cost one row a node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import finite
from .common import small, stored
from .components import components

#: A tile has about so many vectors at most, fewer where they are long; work is dealt into at least TILES tiles.
TILE, TILE_BYTES, TILES = 16_384, 16 << 20, 8
#: Entries of a product that are looked at at once.
BLOCK = 1 << 21
#: Products of so many components stay exact in float32: 1024 * 127**2 < 2**24.
EXACT = 1024
#: Room for the rounding of the bounds themselves, in double and in float32.
SLACK, SLACK32 = 1e-12, 1e-6


def unit(column: pa.Array, width: int) -> np.ndarray:
    """Rows of length one in double precision; scaled by the largest component first, so nothing overflows."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit rows (int8), the scale of each, and the length of each rounding error."""
    scale = 127 / np.abs(u).max(1)
    q = np.rint(u * scale[:, None])
    lost = u - q / scale[:, None]
    return q.astype(np.int8), scale, np.sqrt((lost * lost).sum(1)) + SLACK


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of all rows of a with all of b, exact."""
    if a.shape[1] <= EXACT:
        return a.astype(np.float32) @ b.astype(np.float32).T
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT):
        out += a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T
    return out


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The flat forest in which a[i] and b[i] hang under one root, the smallest."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while ((up := parent[parent]) != parent).any():
            parent = up


def linked(left: np.ndarray, right: np.ndarray, same: bool, threshold: float):  # noqa: ANN201
    """Yields (i, j) arrays of the linked rows of two sets of unit vectors, block by block (same: i < j of one set)."""
    (p, sp, ep), (q, sq, eq) = quantised(left), quantised(right)
    step = max(1, BLOCK // max(1, len(right)))
    for i in range(0, len(left), step):
        first = i if same else 0
        dots = products(p[i : i + step], q[first:])
        far = eq[first:].max(initial=0)
        own = ep[i : i + step]
        least = sp[i : i + step] * (threshold - own - far * (1 + own) - SLACK32)
        possible = dots * (1 / sq[first:]).astype(dots.dtype)[None, :] >= least.astype(dots.dtype)[:, None]
        a, b = np.nonzero(possible)
        if same:
            a, b = a[a < b], b[a < b]
        if not len(a):
            continue
        cosine = dots[a, b].astype(np.float64)
        a, b = a + i, b + first
        cosine /= sp[a] * sq[b]
        error = ep[a] + eq[b] + ep[a] * eq[b]
        sure = cosine - error >= threshold + SLACK
        open_ = np.flatnonzero(~sure & (cosine + error >= threshold - SLACK))
        for k in range(0, len(open_), 1 << 16):
            o = open_[k : k + (1 << 16)]
            sure[o] = np.einsum("ij,ij->i", left[a[o]], right[b[o]]) >= threshold
        yield a[sure], b[sure]


def tile_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """nodes has node, weight and embedding: node, links (weights of its linked nodes, summed over a
    group) and root (a node of its component), for nodes with links."""
    n, width = nodes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    tiles = max(TILES, -(-(n or 0) // max(256, min(TILE, TILE_BYTES // (8 * max(1, width or 1))))))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim, lo, hi = (table.column(c)[0].as_py() for c in ("dim", "lo", "hi"))
        node, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
        own = table.column("own").to_numpy()
        u = unit(table.column("embedding").combine_chunks(), dim)
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        links, parent = np.zeros(len(node), np.int64), np.arange(len(node))
        if len(left) and len(right):
            for a, b in linked(u[left], u[right], lo == hi, threshold):
                a, b = left[a], right[b]
                links += np.bincount(a, weight[b], len(node)).astype(np.int64) + np.bincount(b, weight[a], len(node)).astype(np.int64)
                parent = merge(parent, a, b)
        has = np.flatnonzero(links)
        return pa.table({"node": node[has], "links": links[has], "root": node[parent[has]]})

    rows = nodes.select("node", "weight", "embedding", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("node"), F.lit(tiles)).cast("int").alias("own"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    rows = rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other")
    return rows.groupBy("dim", "lo", "hi").applyInArrow(compare, "node long, links long, root long")


def classes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    n_links counts the other rows whose cosine is `threshold` (above 0) or more; component_id
    is the smallest vec_id that links reach, itself included. Vectors that are null,
    empty, all zero or hold a null, NaN or infinite component link with nothing, and
    so do vectors of different lengths. Repeated rows are vectors of their own and are
    returned as often as they stand. Rows without a vec_id keep it and get their
    component's smallest id (null if it has none). kept: the row has its component's
    id (or neither has one). Other columns are not read; an empty table gives no rows.

    Copies are told by two 64-bit hashes of the components."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    valid = finite() & F.exists("embedding", lambda x: x != 0)
    rows = rows.select("vec_id", "embedding", *[F.when(valid, h).alias(c) for c, h in (("h1", F.xxhash64("embedding")), ("h2", F.xxhash64(F.lit("second"), "embedding")))])
    nodes = rows.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("least_id"), F.count("*").alias("weight"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "cosine-nodes")
    found = stored(tile_pairs(nodes, threshold), "cosine-found")
    links = found.groupBy(F.col("node").alias("_of")).agg(F.sum("links").alias("links"))
    reached = components(found.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    slim = nodes.drop("embedding")
    reached = reached.select(F.col("node").alias("_node"), F.col("component_id").alias("_root"))
    named = stored(slim.join(links, F.col("node") == F.col("_of"), "left").join(reached, F.col("node") == F.col("_node"), "left").select("h1", "h2", "least_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("_root", "node").alias("root")), "cosine-named")
    least = stored(named.groupBy(F.col("root").alias("_root")).agg(F.min("least_id").alias("component_id")), "cosine-least")
    named = stored(named.join(least, F.col("root") == F.col("_root")).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "n_links", "component_id"), "cosine-classes")
    out = rows.select("vec_id", "h1", "h2").join(small(named), (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
