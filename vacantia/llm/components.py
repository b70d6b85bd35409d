"""Connected components over DataFrames, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[:]


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Large star: every neighbour above u moves to the least of u and its neighbours.
    Small star: every neighbour below u, and u, move to the least of them."""
    least = stored(pairs.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m")), "cc-least")
    least = least.withColumn("m", F.least("_u", "m"))
    joined = pairs.join(least, F.col("u") == F.col("_u"))
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.filter("_u <> m").select(F.col("_u").alias("u"), F.col("m").alias("v")))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node and component_id, its least reachable node, of every node in edges (u, v).

    Each round is two groupings by node; edges stay as many as the links given
    (they only move), and end as one star a component. Hot nodes are split by AQE,
    since both sides of each join come from stored tables. Stops when nothing
    changes; raises if that takes more than `most` rounds, rather than return a part."""
    e = edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = stored(e.dropDuplicates(["u", "v"]), "cc-edges")
    was = _state(e)
    for _ in range(most):
        if not was[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(_star(both, True).dropDuplicates(["u", "v"]), "cc-large")
        e = stored(_star(large, False).dropDuplicates(["u", "v"]), "cc-small")
        now = _state(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    return leaves.unionByName(roots)
