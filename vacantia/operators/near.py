"""Neighbours of vectors by cosine distance, with exact pruning by pivots.

On unit vectors the straight-line distance s is a metric, and the cosine distance is
s * s / 2. A few rows serve as pivots; every vector belongs to the cell of its nearest
pivot. For a vector x and the members y of cell j, the triangle inequality gives
s(x, y) >= s(x, p_j) - r_j (the cell's radius), >= q_j - s(x, p_j) (its least distance
from the pivot) and >= (s(x, p_j) - s(x, p_i)) / 2 with x's own pivot p_i. A vector
visits only those cells that no bound excludes, so nothing is crossed with everything.
Members and visitors of a cell meet in tiles of bounded size, however full the cell.
Where the bounds exclude little, copies for cells cost more than they save: then all
rows meet in pairs of wide tiles, each pair once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small, stored
from .components import components
from .ordered import numbered

#: Rows of either side of a tile; how many rows serve as pivots.
TILE, PIVOTS = 2048, 64
#: Rows of either side of a pair of tiles that are compared in strips of so many rows.
WIDE, STRIP = 8192, 512
#: Room for rounding in the bounds.
SLACK = 1e-7


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def units(df: DataFrame, key: str, vector: str, by: str | None = None) -> DataFrame:
    """by, key and unit (array of doubles); zero is true and unit null where the vector is all zero.
    Null vectors raise."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    d = df.select((F.lit(0) if by is None else F.col(by)).alias("by"), F.col(key).alias("key"), F.coalesce(v, F.raise_error(F.lit("a null vector")).cast("array<double>")).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    d = d.withColumn("_n", length)
    return d.select("by", "key", F.when(F.col("_n") > 0, F.transform("v", lambda x: x / F.col("_n"))).alias("unit"), (F.col("_n") == 0).alias("zero"))


class Cells:
    """Pivots, and the least and greatest distance of the members of each cell."""

    def __init__(self, members: DataFrame, pivots: int = PIVOTS):
        spread = members.select("unit").orderBy(F.xxhash64("unit"), "unit").limit(pivots).collect()  # as many as `pivots` at most
        self.at = np.array(sorted({tuple(r[0]) for r in spread}))
        self.low = self.high = np.zeros(len(self.at))

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (x @ self.at.T), 0))

    def mapped(self, df: DataFrame, columns: list[str], name: str, kind: str, values: Callable[[np.ndarray], pa.Array]) -> DataFrame:
        """columns of df and what `values` makes of its distances to the pivots."""
        width = self.at.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(b.schema.get_field_index("unit")), width)
                made = values(self.distances(x), b)
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in columns), made], names=[*columns, name])

        kinds = dict(df.dtypes)
        return df.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"`{name}` {kind}"]))

    def members(self, rows: DataFrame) -> DataFrame:
        """rows with cell, stored; learns the cells' distances (as many rows as pivots)."""
        near = lambda d, _: pa.array(np.stack([d.argmin(1), d.min(1)], 1).tolist() if len(d) else [], pa.list_(pa.float64()))
        out = self.mapped(rows, rows.columns, "_c", "array<double>", near)
        out = stored(out.select(*rows.columns, F.col("_c")[0].cast("int").alias("cell"), F.col("_c")[1].alias("own_distance")), "near-members")
        self.low, self.high = np.full(len(self.at), np.inf), np.full(len(self.at), -np.inf)
        for cell, low, high in out.groupBy("cell").agg(F.min("own_distance"), F.max("own_distance")).collect():
            self.low[cell], self.high[cell] = low, high
        return out

    def visits(self, rows: DataFrame, reach: Callable[[pa.RecordBatch], np.ndarray], skip_own: bool = False) -> DataFrame:
        """by, key, unit and cell, a row for each cell that may have members within reach of the row."""

        def cells(d: np.ndarray, b: pa.RecordBatch) -> pa.Array:
            bound = np.maximum(np.maximum(d - self.high, self.low - d), (d - d.min(1, keepdims=True)) / 2 if len(d) else d)
            there = (bound <= reach(b)[:, None] + SLACK) & np.isfinite(self.low)
            if skip_own and len(d):
                there[np.arange(len(d)), np.where(np.isfinite(self.low), d, np.inf).argmin(1)] = False
            return pa.array([np.flatnonzero(t).astype(np.int32) for t in there], pa.list_(pa.int32()))

        out = self.mapped(rows, ["by", "key", "unit"], "_cells", "array<int>", cells)
        return out.select("by", "key", "unit", F.explode("_cells").alias("cell"))


def met(members: DataFrame, visitors: DataFrame, compare: Callable[[pa.Table, pa.Table], pa.Table], schema: str, few: bool, tile: int | None = None) -> DataFrame:
    """compare(members, visitors) for every pair of tiles of each (by, cell); both sides have by, cell, key, unit
    and the same other columns. few: by has one value, so that cells are as few as pivots."""
    tile = tile or TILE
    tiles = lambda d, n: d.groupBy("by", "cell").agg(F.ceil(F.count("*") / tile).cast("int").alias(n))
    one, other = tiles(members, "_na").select(F.col("by").alias("_by"), F.col("cell").alias("_cell"), "_na"), tiles(visitors, "_nb")
    # Cells without either side are left out.
    sizes = one.join(other, F.col("by").eqNullSafe(F.col("_by")) & (F.col("cell") == F.col("_cell"))).select("_by", "_cell", "_na", "_nb")
    sizes = F.broadcast(sizes) if few else small(stored(sizes, "near-sizes"))
    at = F.col("by").eqNullSafe(F.col("_by")) & (F.col("cell") == F.col("_cell"))

    def dealt(d: DataFrame, own: str, n: str, other: str, m: str, member: bool) -> DataFrame:
        d = d.join(sizes, at).withColumn(own, F.pmod(F.xxhash64("unit", "key"), F.col(n)).cast("int"))
        return d.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).withColumn("_member", F.lit(member)).drop("_by", "_cell", "_na", "_nb")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        return compare(table.filter(table.column("_member")), table.filter(pa.compute.invert(table.column("_member"))))

    both = dealt(members, "_a", "_na", "_b", "_nb", True).unionByName(dealt(visitors, "_b", "_nb", "_a", "_na", False))
    return both.groupBy("by", "cell", "_a", "_b").applyInArrow(run, schema)


def paired(rows: DataFrame, compare: Callable[[pa.Table, pa.Table, bool], pa.Table], schema: str, few: bool) -> DataFrame:
    """compare(left, right, whether they are the same rows) for every pair of wide tiles of each by, either way round
    once; rows have by, key, unit and what compare needs. few: by has one value."""
    sizes = rows.groupBy(F.col("by").alias("_by")).agg(F.ceil(F.count("*") / WIDE).cast("int").alias("_k"))
    sizes = F.broadcast(sizes) if few else small(stored(sizes, "near-sizes"))
    d = rows.join(sizes, F.col("by").eqNullSafe(F.col("_by"))).withColumn("_t", F.pmod(F.xxhash64("unit", "key"), F.col("_k")).cast("int"))
    d = d.withColumn("_u", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    d = d.withColumns({"_a": F.least("_t", "_u"), "_b": F.greatest("_t", "_u")}).drop("_by", "_k", "_u")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        a, b = table.column("_a")[0], table.column("_b")[0]
        own = lambda t: table.filter(pa.compute.equal(table.column("_t"), t))
        left = own(a)
        return compare(left, left if a == b else own(b), a == b)

    return d.groupBy("by", "_a", "_b").applyInArrow(run, schema)


def _strips(left: pa.Table, right: pa.Table, eps: float) -> Iterator[tuple[int, np.ndarray]]:
    """Which rows of right are within eps of rows of left, from the row named on."""
    if len(left) and len(right):
        x, y = _units(left), _units(right).T
        for i in range(0, len(x), STRIP):
            yield i, 1 - np.clip(x[i : i + STRIP] @ y, -1, 1) <= eps


def _units(t: pa.Table) -> np.ndarray:
    v = t.column("unit").combine_chunks()
    return _matrix(v, len(v[0])) if len(v) else np.zeros((0, 1))


def nearest(left: DataFrame, pool: DataFrame, key: str, vector: str, pivots: int = PIVOTS) -> DataFrame:
    """key, nearest (the least cosine distance to any row of pool) and compared (the pivots and rows of
    pool that it was compared with), of every row of left; both have the column `vector`, and keys of left are unique.

    The first round looks in the row's own cell, the second in those other cells that may hold
    something nearer. All-zero vectors are at distance 1 from everything. An empty pool gives no rows."""
    rows = units(left, key, vector)
    other = units(pool.select(vector, F.xxhash64(vector).alias("_k")), "_k", vector)
    at_one = rows.select(F.col("key").alias(key), F.lit(1.0).alias("nearest"), F.lit(0).cast("long").alias("compared"), "zero")
    full = other.filter("NOT zero").select("by", "key", "unit")
    cells = Cells(full, pivots)
    has_zero = not other.filter("zero").isEmpty()
    if not len(cells.at):
        return at_one.filter(F.lit(has_zero)).drop("zero")
    members = cells.members(full)
    members = members.select("by", "cell", F.lit(None).cast(rows.schema["key"].dataType).alias("key"), "unit")

    def compare(members: pa.Table, visitors: pa.Table) -> pa.Table:
        best = 1 - np.clip((_units(visitors) @ _units(members).T).max(1), -1, 1)
        return pa.table({"key": visitors.column("key"), "nearest": best, "compared": np.full(len(best), len(members), np.int64)})

    kind = rows.schema["key"].dataType.simpleString()
    found = lambda v: met(members, v.select("by", "cell", "key", "unit"), compare, f"key {kind}, nearest double, compared long", True)
    best = lambda d: d.groupBy("key").agg(F.min("nearest").alias("nearest"), F.sum("compared").alias("compared"))
    visitors = rows.filter("NOT zero").select("by", "key", "unit")
    filled = np.isfinite(cells.low)
    own = cells.mapped(visitors, ["by", "key", "unit"], "cell", "int", lambda d, _: pa.array(np.where(filled, d, np.inf).argmin(1).astype(np.int32) if len(d) else [], pa.int32()))
    first = stored(best(found(own)), "near-first")
    so_far = visitors.join(first.select(F.col("key").alias("_key"), F.col("nearest").alias("so_far")), F.col("key").eqNullSafe(F.col("_key"))).drop("_key")
    reach = lambda b: np.sqrt(2 * b.column(b.schema.get_field_index("so_far")).to_numpy())
    out = best(first.unionByName(found(cells.visits(so_far, reach, skip_own=True))))
    if has_zero:
        out = out.withColumn("nearest", F.least("nearest", F.lit(1.0)))
    out = out.select(F.col("key").alias(key), "nearest", (F.col("compared") + len(cells.at)).alias("compared"))
    return out.unionByName(at_one.filter("zero").drop("zero"))


def _stars(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent, flat, with a[i] and b[i] under one least root."""
    while (parent[a] != parent[b]).any():
        x, y = parent[a], parent[b]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return parent


def _pairs_of_all(rows: DataFrame) -> int:
    """Pairs of rows of each by, either way round once."""
    return int(rows.groupBy("by").count().agg(F.coalesce(F.sum(F.col("count").cast("decimal(38,0)") * (F.col("count") + 1) / 2), F.lit(0))).first()[0])


def _pairs_in_cells(members: DataFrame, visitors: DataFrame) -> int:
    """Pairs that members and visitors of cells are compared in."""
    m = members.groupBy("by", "cell").agg(F.count("*").cast("decimal(19,0)").alias("_m"))
    v = visitors.groupBy(F.col("by").alias("_by"), F.col("cell").alias("_cell")).agg(F.count("*").cast("decimal(19,0)").alias("_v"))
    both = m.join(v, F.col("by").eqNullSafe(F.col("_by")) & (F.col("cell") == F.col("_cell")))
    return int(both.agg(F.coalesce(F.sum(F.col("_m") * F.col("_v")), F.lit(0))).first()[0])


def dbscan(df: DataFrame, key: str, vector: str, eps: float, least: int, by: str | None = None, pivots: int = PIVOTS) -> DataFrame:
    """by (if given), key and cluster of every row: clusters of points with `least` neighbours within eps
    (themselves included) and of what those reach; noise is -1.

    key is a long, unique within by. Clusters of each by are numbered from 0 in the order of their
    least core key, and a point that several clusters reach belongs to the first of them. All-zero
    vectors are noise (eps is below 1). First neighbours are counted in the cells; then cores that
    are neighbours are joined to components, of which each tile returns stars, never all links."""
    if not 0 <= eps < 1:
        raise ValueError("eps must be in [0, 1)")
    rows = units(df, key, vector, by)
    full = rows.filter("NOT zero").select("by", "key", "unit")
    # Nodes of the graph are longs across all values of by.
    full = stored(full.withColumn("node", F.monotonically_increasing_id()), "dbscan-nodes")
    cells = Cells(full, pivots)
    kind = rows.schema["by"].dataType.simpleString()
    if not len(cells.at):
        out = rows.select("by", "key", F.lit(-1).cast("long").alias("cluster"))
        return out.select(*([F.col("by").alias(by)] if by else []), F.col("key").alias(key), "cluster")
    ids = full.select("by", F.col("node").alias("key"), "unit")
    members = cells.members(ids)
    reach = lambda b: np.full(b.num_rows, np.sqrt(2 * eps))
    slim, few = members.select("by", "cell", "key", "unit"), by is None
    visitors = cells.visits(ids, reach)
    wide = _pairs_of_all(slim) <= 2 * _pairs_in_cells(slim, visitors)
    if not wide:
        visitors = stored(visitors, "dbscan-visitors")

    def count(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        """Neighbours of left in right, and of right in left."""
        of_left, of_right = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        for i, near in _strips(left, right, eps):
            of_left[i : i + len(near)] = near.sum(1)
            of_right += near.sum(0)
        if same:
            return pa.table({"key": left.column("key"), "n": of_left})
        return pa.table({"key": np.concatenate([left.column("key"), right.column("key")]), "n": np.concatenate([of_left, of_right])})

    def count_members(members: pa.Table, visitors: pa.Table) -> pa.Table:
        out = count(members, visitors, False)
        return out.slice(0, len(members))

    each = "key long, n long"
    found = paired(ids, count, each, few) if wide else met(slim, visitors, count_members, each, few)
    counts = stored(found.groupBy("key").agg(F.sum("n").alias("n")), "dbscan-counts")
    cores = counts.filter(F.col("n") >= least).select(F.col("key").alias("_core"))

    def join(left: pa.Table, right: pa.Table, same: bool = False) -> pa.Table:
        """Stars of cores, and of either side's other rows a link to each star that they are near."""
        core, other_core = (t.column("core").to_numpy(zero_copy_only=False) for t in (left, right))
        every, at = np.unique(np.concatenate([left.column("key"), right.column("key")]).astype(np.int64), return_inverse=True)
        l_at, r_at = at[: len(left)], at[len(left) :]
        parent, border = np.arange(len(every)), np.zeros((0, 2), np.int64)
        for i, near in _strips(left, right, eps):
            a, b = np.nonzero(near)
            one, two = core[a + i], other_core[b]
            a, b = l_at[a + i], r_at[b]
            parent = _stars(parent, a[one & two], b[one & two])
            pairs = np.concatenate([np.stack([x[w], parent[y[w]]], 1) for x, y, w in ((a, b, ~one & two), (b, a, one & ~two))])
            border = np.concatenate([border, np.unique(pairs, axis=0)])
        border = np.unique(np.stack([border[:, 0], parent[border[:, 1]]], 1), axis=0)
        moved = np.flatnonzero(parent != np.arange(len(every)))
        return pa.table({"u": np.concatenate([every[moved], every[border[:, 0]]]), "v": np.concatenate([every[parent[moved]], every[border[:, 1]]]), "border": np.repeat([False, True], [len(moved), len(border)])})

    flagged = slim.join(cores, F.col("key") == F.col("_core"), "left").select("by", "cell", "key", "unit", F.col("_core").isNotNull().alias("core"))
    link = "u long, v long, border boolean"
    if wide:
        links = paired(flagged.drop("cell"), join, link, few)
    else:
        only = visitors.join(cores, F.col("key") == F.col("_core"), "left_semi").withColumn("core", F.lit(True))
        links = met(flagged, only, lambda members, visitors: join(members, visitors), link, few)
    links = stored(links, "dbscan-links")
    joined = components(links.filter("NOT border").select("u", "v"))
    root = stored(cores.join(joined, F.col("_core") == F.col("node"), "left").select("_core", F.coalesce("component", "_core").alias("component")), "dbscan-roots")
    named = full.select("by", "key", "node")
    of_core = named.join(root, F.col("node") == F.col("_core")).select("by", "key", "node", "component")
    clusters = of_core.groupBy("by", "component").agg(F.min("key").alias("first"))
    clusters = numbered(clusters, "first", ["by"], "cluster").select("component", "cluster")
    clusters = stored(clusters, "dbscan-clusters")
    cluster_of = root.join(clusters, "component").select("_core", "cluster")
    reached = links.filter("border").join(cluster_of, F.col("v") == F.col("_core")).groupBy(F.col("u").alias("node")).agg(F.min("cluster").alias("cluster"))
    found = cluster_of.select(F.col("_core").alias("node"), "cluster").unionByName(reached)
    found = named.join(found, "node").select(F.col("by").alias("_by"), F.col("key").alias("_key"), "cluster")
    out = rows.select("by", "key").join(found, F.col("by").eqNullSafe(F.col("_by")) & (F.col("key") == F.col("_key")), "left")
    out = out.select("by", "key", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))
    return out.select(*([F.col("by").alias(by)] if by else []), F.col("key").alias(key), "cluster")
