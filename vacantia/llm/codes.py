"""Product codes of vectors: integer k-means, with a kd-tree a codebook for the nearest entry.

A vector is cut into equal parts, and each part position has a codebook of its own.
Each round broadcasts one kd-tree a codebook (their size is parts x entries x width,
whatever the table's). A task searches its own rows by branch and bound: a subtree is
left out only if its box is farther than the best entry so far, so boxes at an equal
bound are visited and of equally near entries the one with the lower index survives.
It sends one row of integer sums for each entry that it used; those are all that is
shuffled, and a third of the rows being equal makes no task larger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored, tune_arrow

#: Components at or above this are refused: squared distances would leave the 64-bit range.
LARGEST = 1 << 24
LEAF = 8


def finite(vector: str = "embedding") -> Column:
    """True for vectors that are neither null nor hold a null, NaN or infinite component."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, number), F.lit(False))


class Tree:
    """A kd-tree over the entries (rows of integers) of one codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.members: list[np.ndarray] = []
        self._grow(np.arange(len(entries)))

    def _grow(self, members: np.ndarray) -> int:
        node, own = len(self.children), self.entries[members]
        self.low.append(own.min(0))
        self.high.append(own.max(0))
        self.members.append(members)
        self.children.append(None)
        if len(members) > LEAF:
            axis = int(np.argmax(self.high[node] - self.low[node]))
            order = members[np.argsort(own[:, axis], kind="stable")]
            half = len(order) // 2
            self.children[node] = self._grow(np.sort(order[:half])), self._grow(np.sort(order[half:]))
        return node

    def _bound(self, node: int, x: np.ndarray) -> np.ndarray:
        out = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0)
        return (out * out).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row of x; of equally near ones, the first."""
        best, index = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.entries))

        def visit(node: int, rows: np.ndarray, bound: np.ndarray) -> None:
            rows = rows[bound <= best[rows]]
            if not len(rows):
                return
            if self.children[node] is None:
                members = self.members[node]
                d = x[rows][:, None, :] - self.entries[members][None, :, :]
                d = (d * d).sum(2)
                at = d.argmin(1)
                d, found = d[np.arange(len(rows)), at], members[at]
                better = (d < best[rows]) | (d == best[rows]) & (found < index[rows])
                best[rows[better]], index[rows[better]] = d[better], found[better]
                return
            left, right = self.children[node]
            to_left, to_right = self._bound(left, x[rows]), self._bound(right, x[rows])
            first = to_left <= to_right
            visit(left, rows[first], to_left[first])
            visit(right, rows[~first], to_right[~first])
            visit(right, rows[first], to_right[first])
            visit(left, rows[~first], to_left[~first])

        visit(0, np.arange(len(x)), np.zeros(len(x), np.int64))
        return index, best


def integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, one row a vector; vectors have `width` components."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(x) and np.abs(x).max() >= LARGEST:
        raise ValueError(f"a component times {scale} is {LARGEST} or more; scale the vectors down")
    return x.astype(np.int64).reshape(-1, width)


def _column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def train(vectors: DataFrame, width: int, vec_id: str, embedding: str, parts: int, entries: int, rounds: int, scale: int) -> np.ndarray:
    """Codebooks (parts x entries x width of a part) after so many rounds over all vectors."""
    seeds = vectors.orderBy(F.asc_nulls_last(vec_id), embedding).select(embedding).limit(entries).collect()
    books = np.array([[float(c) for c in r[0]] for r in seeds]).reshape(len(seeds), width)
    books = integers(pa.array(list(books), pa.list_(pa.float64())), width, scale).reshape(len(seeds), parts, -1).transpose(1, 0, 2)
    wide = width // parts
    schema = ", ".join(["part int", "entry int", "n long", *(f"s{i} long" for i in range(wide))])
    for _ in range(rounds):
        trees = vectors.sparkSession.sparkContext.broadcast([Tree(b) for b in books])

        def sums(batches: Iterator[pa.RecordBatch], trees=trees) -> Iterator[pa.RecordBatch]:  # noqa: B008
            total = np.zeros((parts, len(seeds), 1 + wide), np.int64)
            for b in batches:
                x = integers(b.column(0), width, scale).reshape(-1, parts, wide)
                for p, tree in enumerate(trees.value):
                    index, _ = tree.nearest(x[:, p])
                    total[p, :, 0] += np.bincount(index, minlength=len(seeds))
                    for i in range(wide):  # a batch's sums are exact in double
                        total[p, :, 1 + i] += np.bincount(index, x[:, p, i], len(seeds)).astype(np.int64)
            part, entry = np.nonzero(total[:, :, 0])
            used = total[part, entry]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), *(pa.array(used[:, i]) for i in range(1 + wide))], names=["part", "entry", "n", *(f"s{i}" for i in range(wide))])

        found = vectors.select(embedding).mapInArrow(sums, schema)
        found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(wide)])
        books = books.copy()
        for part, entry, n, *s in found.collect():  # at most parts x entries rows
            books[part, entry] = [v // n for v in s]
    return books


def encoded(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error, label_error and codebooks_sha256 of every vector.

    Left out are null vectors and those with null, NaN or infinite components, empty
    ones and those whose length no `parts` divide; of what stays, vectors of other
    than the commonest length (of equally common ones, the greatest). Codebooks start
    from the vectors of the smallest vec_ids (nulls last, ties by components); fewer
    vectors than `entries` make smaller codebooks. Repeated rows count as often as
    they stand; rows with null labels share one label_error. Other columns are not
    read. An empty table gives no rows. A component of LARGEST or more, after
    scaling, raises."""
    slim = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    slim = slim.filter(finite() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    common = slim.groupBy(F.size("embedding").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("w")).first()
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    if common is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, label_error long, codebooks_sha256 string")
    width = common.w
    slim = slim.filter(F.size("embedding") == width)
    tune_arrow(vectors.sparkSession)
    books = train(slim, width, "vec_id", "embedding", parts, entries, rounds, scale)
    trees = vectors.sparkSession.sparkContext.broadcast([Tree(b) for b in books])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([b"%02x" % i for i in range(256)])
        for b in batches:
            x = integers(_column(b, "embedding"), width, scale).reshape(-1, parts, width // parts)
            found = [tree.nearest(x[:, p]) for p, tree in enumerate(trees.value)]
            code = np.ascontiguousarray(digits[np.stack([f[0] for f in found], 1)]).view(f"S{2 * parts}").ravel()
            error = reduce(np.add, (f[1] for f in found))
            yield pa.RecordBatch.from_arrays([_column(b, "vec_id"), _column(b, "label"), pa.array(code.astype(str)), pa.array(error)], names=["vec_id", "label", "code", "error"])

    out = stored(slim.mapInArrow(encode, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
    total = stored(out.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "codes-labels")
    out = out.join(small(total), F.col("label").eqNullSafe(F.col("_label")))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
