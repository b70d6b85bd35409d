"""A fitted forest as data: a table of nodes, walked by built-in expressions.

Training is MLlib's, distributed. What it fits is read back as plain rows, so that a
forest is stored, versioned, compared and evaluated like any other table, in SQL too."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder

NODES = "tree int, node int, feature int, threshold double, left int, right int, probabilities array<double>"
#: The class whose probability counts where a forest has more than two (fixed value).
BAD = "really_bad"


@dataclass
class Forest:
    """nodes: (tree, node, feature, threshold, left, right, probabilities); a leaf has feature -1 and
    the share of each class, an inner node sends values up to its threshold to the left. The root of
    a tree is node 0. fill has what a missing feature counts as.

    Two classes: the second is the bad one, against `threshold`. With bad_threshold the
    classes are named and BAD is the bad one. How many nodes a forest has hangs on its trees
    and depth, not on the rows it judges."""

    nodes: list[tuple]
    features: list[str]
    classes: list[str]
    fill: list[float]
    threshold: float | None = None
    bad_threshold: float | None = None

    def bad(self) -> tuple[int, float]:
        """Which class is the bad one, and from which probability on; raises if the forest cannot say."""
        if self.bad_threshold is None:
            if self.threshold is None:
                raise ValueError("a forest without a threshold")
            if len(self.classes) < 2:
                raise ValueError("a binary forest needs two classes")
            return 1, float(self.threshold)
        if BAD not in self.classes:
            raise ValueError(f"no class {BAD} among {self.classes}")
        return self.classes.index(BAD), float(self.bad_threshold)

    def check(self) -> Forest:
        """Self, if it is whole."""
        self.bad()
        if not self.nodes or len(self.fill) != len(self.features):
            raise ValueError("a forest without nodes, or without a fill for each feature")
        known = {(n[0], n[1]) for n in self.nodes}
        for tree, _, feature, _, left, right, shares in self.nodes:
            if feature < 0 and len(shares) != len(self.classes):
                raise ValueError("a leaf without a share for each class")
            if feature >= len(self.features) or feature >= 0 and not {(tree, left), (tree, right)} <= known:
                raise ValueError("a node that leads nowhere")
        return self

    def depth(self) -> int:
        inner = {(n[0], n[1]): (n[4], n[5]) for n in self.nodes if n[2] >= 0}
        most, edge = 0, [(n[0], 0) for n in self.nodes if n[1] == 0]
        while edge := [(t, c) for t, n in edge for c in inner.get((t, n), ())]:
            most += 1
            if most > len(self.nodes):
                raise ValueError("nodes in a circle")
        return most

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        about = json.dumps({k: getattr(self, k) for k in ("features", "classes", "fill", "threshold", "bad_threshold")})
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> Forest:
    about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
    rows = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect()
    return Forest([tuple(r) for r in rows], **about).check()


def finite(value: Column) -> Column:
    """The number, or null if it is not finite."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def probabilities(forest: Forest, values: Column) -> Column:
    """The mean of the trees' class shares for an array of features (none of them null).

    The nodes stand in the plan as flat arrays, and each tree is walked from its root, one
    conditional a level: no code is made for a node, however many there are."""
    place = {(t, n): i for i, (t, n, *_) in enumerate(forest.nodes)}
    k = len(forest.classes)
    array = lambda v, kind: F.lit(list(v)).cast(f"array<{kind}>")
    feature = array((n[2] for n in forest.nodes), "int")
    threshold = array((0.0 if n[3] is None else float(n[3]) for n in forest.nodes), "double")
    left, right = (array((place.get((n[0], n[c]), 0) for n in forest.nodes), "int") for c in (4, 5))
    roots = array((i for (_, n), i in place.items() if n == 0), "int")
    levels = F.sequence(F.lit(1), F.lit(max(1, forest.depth())))

    def step(at: Column, _: Column) -> Column:
        f = F.get(feature, at)
        return F.when(f < 0, at).when(F.get(values, f) <= F.get(threshold, at), F.get(left, at)).otherwise(F.get(right, at))

    leaves = F.transform(roots, lambda r: F.aggregate(levels, r, step))
    trees = sum(1 for n in forest.nodes if n[1] == 0)
    shares = [array((float(n[6][c]) if n[2] < 0 else 0.0 for n in forest.nodes), "double") for c in range(k)]

    def share(at: Column, of: Column) -> Column:
        return F.aggregate(at, F.lit(0.0), lambda total, i: total + F.get(of, i)) / trees

    return F.transform(F.array(leaves), lambda at: F.array(*[share(at, s) for s in shares]))[0]


def judged(pairs: DataFrame, forest: Callable[[], Forest], operation: str = "pair_independent_bad_match_forest") -> DataFrame:
    """pairs with bad_probability, bad_threshold, is_flagged, rank (1 kept, 2 flagged), score, class_probabilities
    (a map; null for two classes), missing_features, operation and status.

    `forest` is called once; if it raises, or its features are not there, the filter fails open:
    every row stays, unflagged, with status 'failed' and null measures."""
    try:
        model = forest().check()
        at, limit = model.bad()
        given = [finite(F.col(f)) for f in model.features]
        out = pairs.withColumns({"_given": F.array(*given)})
    except Exception as e:  # noqa: BLE001 - a model that cannot be had must not end the ranking
        lacking = {"bad_probability": "double", "bad_threshold": "double", "score": "double", "class_probabilities": "map<string,double>", "missing_features": "int"}
        return pairs.withColumns({**{c: F.lit(None).cast(t) for c, t in lacking.items()}, "is_flagged": F.lit(False), "rank": F.lit(1), "operation": F.lit(operation), "status": F.lit(f"failed: {type(e).__name__}")})
    filled = F.zip_with("_given", F.lit([float(x) for x in model.fill]).cast("array<double>"), lambda a, b: F.coalesce(a, b))
    out = out.withColumn("_filled", filled).withColumn("_p", probabilities(model, F.col("_filled")))
    p = F.get("_p", F.lit(at))
    named = F.map_from_arrays(F.lit(list(model.classes)).cast("array<string>"), F.col("_p")) if model.bad_threshold is not None else F.lit(None).cast("map<string,double>")
    out = out.withColumns({"bad_probability": p, "bad_threshold": F.lit(limit), "is_flagged": p >= limit, "rank": F.when(p >= limit, 2).otherwise(1), "score": 1.0 - p, "class_probabilities": named, "missing_features": F.size(F.filter("_given", lambda x: x.isNull())), "operation": F.lit(operation), "status": F.lit("ok")})
    return out.drop("_given", "_filled", "_p")


def fit(rows: DataFrame, features: list[str], label: str, threshold: float | None = None, bad_threshold: float | None = None, trees: int = 40, depth: int = 7, seed: int = 7) -> Forest:
    """A forest of MLlib's over all rows with a label (a string); features that are missing count as their median.

    The fitted trees are written by MLlib and read back as rows."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    spark = rows.sparkSession
    d = rows.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("_label"), *[finite(F.col(f)).alias(f"_f{i}") for i, f in enumerate(features)])
    classes = sorted(r[0] for r in d.select("_label").distinct().collect())
    middle = d.agg(*[F.median(f"_f{i}") for i in range(len(features))]).first()
    fill = [0.0 if m is None else float(m) for m in middle]
    d = d.select(F.array_position(F.lit(classes).cast("array<string>"), F.col("_label")).cast("double").alias("_y"), *[F.coalesce(f"_f{i}", F.lit(fill[i])).alias(f"_f{i}") for i in range(len(features))])
    d = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="_x").transform(d.withColumn("_y", F.col("_y") - 1))
    model = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed).fit(d)
    path = new_folder(spark, "forest")
    model.write().save(path)
    data = spark.read.load(f"{path}/data").select("treeID", "nodeData.*")
    nodes = []
    for r in data.select("treeID", "id", "impurityStats", "leftChild", "rightChild", "split.featureIndex", "split.leftCategoriesOrThreshold").orderBy("treeID", "id").collect():
        inner = r.leftChild >= 0
        total = sum(r.impurityStats)
        nodes.append((r.treeID, r.id, r.featureIndex if inner else -1, float(r.leftCategoriesOrThreshold[0]) if inner else None, r.leftChild if inner else -1, r.rightChild if inner else -1, None if inner else [s / total for s in r.impurityStats]))
    return Forest(nodes, list(features), classes, fill, threshold, bad_threshold).check()
