"""Average linkage of one query's candidates, and screens by an asked judge.

Candidates of a query are a list of set length, so a query is one group; queries are
dealt out. Larger groups raise rather than fill a task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Candidates of one query at most.
MOST = 2000


def _cosine(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = v / np.where(n > 0, n, 1)
    return 1 - u @ u.T


def agglomerative(v: np.ndarray, clusters: int = 8) -> np.ndarray:
    """Average linkage: the two nearest clusters merge until `clusters` are left."""
    d = _cosine(v)
    np.fill_diagonal(d, np.inf)
    size, parent = np.ones(len(v)), np.arange(len(v))
    for _ in range(max(0, len(v) - clusters)):
        a, b = sorted(divmod(int(d.argmin()), len(v)))
        mean = (d[a] * size[a] + d[b] * size[b]) / (size[a] + size[b])
        d[a], d[:, a] = mean, mean
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
        size[a] += size[b]
        parent[parent == b] = a
    return np.unique(parent, return_inverse=True)[1]


def linked(df: DataFrame, key: str, vector: str, by: str = "query_id", clusters: int = 8) -> DataFrame:
    """by, key and cluster of each candidate, by average linkage. A query with more than MOST
    candidates raises; none give none. (near.dbscan and MLlib's k-means have no such bound.)"""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) > MOST:
            raise ValueError(f"{len(group)} candidates in one query; {MOST} at most")
        g = group.sort_values(key, kind="stable")
        v = np.array([np.asarray(x, float) for x in g[vector]])
        return pd.DataFrame({by: g[by], key: g[key], "cluster": agglomerative(v, clusters).astype(np.int64)})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(by, key, vector).groupBy(by).applyInPandas(run, f"`{by}` {kinds[by]}, `{key}` {kinds[key]}, cluster long")


def asked(df: DataFrame, ask: Callable[[str], bool], prompt: str, order: list[Column], enough: int, most: int, by: str = "query_id") -> DataFrame:
    """The first `enough` rows of each query that `ask` accepts, among its first `most`, and status.

    Calls go in order and stop early. If a call raises, the query's status is 'failed' and
    all its candidates are given back as they were; else 'ok'."""
    kinds = df.withColumn("status", F.lit("")).schema
    ranked = df.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("_place").drop(columns="_place")
        kept: list[int] = []
        try:
            for i, text in enumerate(g[prompt].head(most)):
                if len(kept) < enough and ask(text):
                    kept.append(i)
        except Exception:  # noqa: BLE001 - whatever an outside judge raises, the ranking goes on without it
            return g.assign(status="failed")
        return g.iloc[kept].assign(status="ok")

    return ranked.groupBy(by).applyInPandas(run, kinds)


def asked_in_rounds(df: DataFrame, ask: Callable[[DataFrame], DataFrame], order: list[Column], enough: int, most: int, by: str = "query_id") -> DataFrame:
    """As asked, for all queries at once: round k puts the k-th candidate of every query that is still open.

    ask adds accepted (true, false, or null where the call failed) to the rows it is given. A query
    closes with `enough` accepted, with its first failure, or after `most` calls. The result has the
    accepted rows (all rows of a query that failed), status ('ok' or 'failed') and calls; there are
    at most `most` rounds, whatever the number of queries, and each is stored."""
    places = Window.partitionBy(by).orderBy(*order)
    ranked = stored(df.withColumn("_place", F.row_number().over(places)), "asked-ranked")
    answers = None
    for k in range(1, most + 1):
        now = ranked.filter(F.col("_place") == k)
        if answers is not None:
            shut = answers.groupBy(F.col(by).alias("_by")).agg(F.count_if("accepted").alias("_n"), F.count_if(F.col("accepted").isNull()).alias("_f"))
            shut = shut.filter((F.col("_n") >= enough) | (F.col("_f") > 0))
            now = now.join(shut, F.col(by).eqNullSafe(F.col("_by")), "left_anti")
        made = stored(ask(now).select(by, "_place", "accepted"), "asked-answers")
        if made.isEmpty():
            break
        answers = made if answers is None else answers.unionByName(made)
    if answers is None:
        return df.limit(0).withColumns({"status": F.lit("ok"), "calls": F.lit(0).cast("long")})
    ends = answers.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("calls"), (F.count_if(F.col("accepted").isNull()) > 0).alias("_failed"))
    yes = answers.filter("accepted").select(F.col(by).alias("_q"), F.col("_place").alias("_p"), F.lit(True).alias("_yes"))
    out = ranked.join(ends, F.col(by).eqNullSafe(F.col("_by"))).join(yes, F.col(by).eqNullSafe(F.col("_q")) & (F.col("_place") == F.col("_p")), "left")
    out = out.filter(F.col("_failed") | F.col("_yes"))
    return out.select(*df.columns, F.when(F.col("_failed"), "failed").otherwise("ok").alias("status"), "calls")
