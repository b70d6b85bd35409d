"""Vector operators over array<float> columns, summed in double."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, between 0 and 2; vectors of length zero are at distance 1."""
    n = F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12)) * F.greatest(F.sqrt(dot(b, b)), F.lit(1e-12))
    return 1.0 - F.least(F.greatest(dot(a, b) / n, F.lit(-1.0)), F.lit(1.0))


def centroids(df: DataFrame, by: str, vector: str) -> DataFrame:
    """by, size and centroid: means by position, partial sums before the shuffle."""
    long = df.select(by, F.posexplode(vector).alias("pos", "v"))
    means = long.groupBy(by, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count("*").alias("n"))
    return means.groupBy(by).agg(F.max("n").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def wasserstein_1d(df: DataFrame, a: Column, b: Column, value: Column, by: list[str]) -> DataFrame:
    """The first Wasserstein distance of two samples of `value`, the rows where a and where b
    hold, per group of by: the area between the running distribution functions."""
    d = df.filter(a | b).select(*by, value.cast("double").alias("v"), a.cast("int").alias("ia"), b.cast("int").alias("ib"))
    d = d.groupBy(*by, "v").agg(F.sum("ia").alias("ia"), F.sum("ib").alias("ib"))
    whole = Window.partitionBy(*by)
    run = whole.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.abs(F.sum("ia").over(run) / F.sum("ia").over(whole) - F.sum("ib").over(run) / F.sum("ib").over(whole))
    step = F.lead("v").over(whole.orderBy("v")) - F.col("v")
    return d.withColumn("_area", gap * step).groupBy(*by).agg(F.sum("_area").alias("distance"))


def projections(dim: int, n: int, seed: int) -> np.ndarray:
    """n random unit vectors, each number made from the MD5 of 'seed:projection:axis' (two uniform
    numbers from its first and second 8 digits, Box and Muller's way), so that SQL can make them too."""
    import hashlib

    digits = [hashlib.md5(f"{seed}:{i}:{j}".encode()).hexdigest() for i in range(n) for j in range(dim)]
    u = np.array([((int(d[:8], 16) + 1) / 4294967297.0, int(d[8:16], 16) / 4294967296.0) for d in digits])
    p = (np.sqrt(-2 * np.log(u[:, 0])) * np.cos(2 * np.pi * u[:, 1])).reshape(n, dim)
    return p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)


def _sorted_distance(x: np.ndarray, y: np.ndarray) -> float:
    """The mean over columns of the first Wasserstein distance of two sorted samples."""
    every = np.sort(np.concatenate([x, y]), axis=0)
    total = 0.0
    for k in range(x.shape[1]):
        f = np.searchsorted(x[:, k], every[:-1, k], "right") / len(x)
        g = np.searchsorted(y[:, k], every[:-1, k], "right") / len(y)
        total += float(np.sum(np.abs(f - g) * np.diff(every[:, k])))
    return total / x.shape[1]


def sliced_wasserstein(df: DataFrame, matrix: str, query: np.ndarray, n: int = 64, seed: int = 7) -> DataFrame:
    """df with its matrix (array of vectors) replaced by its sliced Wasserstein distance
    to the query's rows; an empty or null matrix is at infinity."""
    import pandas as pd

    directions = projections(query.shape[1], n, seed).T
    sorted_query = np.sort(query.astype(np.float64) @ directions, axis=0)
    others = [c for c in df.columns if c != matrix]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[others].copy()
            out["distance"] = [_sorted_distance(np.sort(np.stack([np.asarray(v, np.float64) for v in m]) @ directions, axis=0), sorted_query) if m is not None and len(m) else float("inf") for m in b[matrix]]
            yield out

    kinds = dict(df.dtypes)
    return df.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "distance double"]))


def nearest(df: DataFrame, vector: str, pool: np.ndarray, block: int = 4096) -> DataFrame:
    """df with nearest: the least cosine distance of its vector to the pool's rows, a stated
    query set of checked size, in blocks of one matrix product each."""
    import pandas as pd

    p = pool.astype(np.float64)
    p = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    others = [c for c in df.columns if c != vector]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[others].copy()
            if len(b):
                x = np.stack([np.asarray(v, np.float64) for v in b[vector]])
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                best = np.full(len(x), np.inf)
                for i in range(0, len(p), block):
                    best = np.minimum(best, 1 - np.clip((x @ p[i : i + block].T).max(axis=1), -1, 1))
                out["nearest"] = best
            else:
                out["nearest"] = pd.Series(dtype="float64")
            yield out

    kinds = dict(df.dtypes)
    return df.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "nearest double"]))


def hashing_encoder(texts: list[str], dim: int = 64) -> np.ndarray:
    """A deterministic stand-in for a sentence encoder: hashed words, unit length."""
    import zlib

    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % dim] += 1 if h >> 16 & 1 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def encoded(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray] = hashing_encoder, name: str = "vector") -> DataFrame:
    """df with the vector of its text; each distinct text is encoded once."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_m1": b["_h1"], "_m2": b["_h2"], name: [v.astype(np.float32).tolist() for v in encoder(b["_t"].tolist())] if len(b) else []})

    # Texts are told by 128 bits of hashes, so that no text is a join key; nulls stay out of the join.
    keys = lambda c: [F.xxhash64(c).alias("_h1"), F.xxhash64(F.lit("second"), c).alias("_h2")]
    has = df.filter(F.col(text).isNotNull()).select("*", *keys(text))
    made = has.groupBy("_h1", "_h2").agg(F.first(text).alias("_t")).select("_h1", "_h2", "_t").mapInPandas(run, f"_m1 long, _m2 long, `{name}` array<float>")
    out = has.join(made, (F.col("_h1") == F.col("_m1")) & (F.col("_h2") == F.col("_m2"))).drop("_h1", "_h2", "_m1", "_m2")
    return out.unionByName(df.filter(F.col(text).isNull()).withColumn(name, F.lit(None).cast("array<float>")))
