"""Connected components over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _contracted(edges: DataFrame, upward: bool) -> DataFrame:
    """One star contraction of edges (u, v): each neighbour of u hangs itself on the least of u and its
    neighbours; upward moves the neighbours above u alone, else those below u and u itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    least = stored(least, "components-least")
    on_least = edges.join(least, F.col("u") == F.col("_u"))
    if upward:
        return on_least.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    below = on_least.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.unionByName(least.filter("_u <> m").select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node and component (its least reachable node), for every node that an edge (u, v) joins to another.

    Edges that are the other way round, repeated, null or loops may stand in the table. Stops
    when a round changes nothing, and raises after `most` rounds."""
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e, "components-edges")
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    was = mark(e)
    for _ in range(most if was[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = stored(_contracted(both, True), "components-up")
        e = stored(_contracted(up, False), "components-down")
        now = mark(e)
        if tuple(now) == tuple(was):
            break
        was = now
    else:
        if was[0]:
            raise RuntimeError(f"components did not settle in {most} rounds")
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
