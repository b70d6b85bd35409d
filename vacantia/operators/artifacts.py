"""Stored features, and what is shown of ranked results.

Vectors of a posting's words and phrases stay nested in its row, so a reader of some
columns and rows reads no others; flat vectors with offsets are one projection away."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Features that an exported posting has (fixed values).
FEATURES = ("title_requirements_embedding", "job_selected_words", "job_selected_word_embeddings", "job_phrase_chunks", "job_phrase_chunk_embeddings")
#: Characters of a text that results show.
PREVIEW = 2500


def export_ready(eligible: Column, features: list[Column], versions: dict[str, tuple[Column, str]]) -> Column:
    """Eligible, every feature there, every version current."""
    out = F.coalesce(eligible.cast("boolean"), F.lit(False))
    for f in features:
        out &= f.isNotNull()
    for column, current in versions.values():
        out &= column.eqNullSafe(F.lit(current))
    return out


def offsets(rows: DataFrame, groups: str, shard: str = "artifact_shard", row: str = "row_index") -> DataFrame:
    """rows and first, last: where the vectors of each row's group begin and end in its shard's flat list.

    A shard has a set number of rows, so the running sum is over one shard."""
    w = Window.partitionBy(shard).orderBy(row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.coalesce(F.size(groups), F.lit(0))
    last = F.sum(F.greatest(n, F.lit(0)).cast("long")).over(w)
    return rows.withColumn("last", last).withColumn("first", F.col("last") - F.greatest(n, F.lit(0)))


def flattened(rows: DataFrame, groups: str, shard: str = "artifact_shard", row: str = "row_index") -> DataFrame:
    """shard, position and vector: every group's vectors one after another."""
    at = offsets(rows, groups, shard, row)
    return at.select(shard, F.posexplode(groups).alias("_k", "vector"), "first").select(shard, (F.col("first") + F.col("_k")).alias("position"), "vector")


def gathered(flat: DataFrame, spans: DataFrame, shard: str = "artifact_shard", row: str = "row_index") -> DataFrame:
    """shard, row and its vectors, of the rows that spans (shard, row, first, last) asks for: the
    flat list is joined by position, so no shard is read into one task."""
    wanted = spans.filter("last > first").select(F.col(shard).alias("_s"), F.col(row), F.explode(F.sequence("first", F.col("last") - 1)).alias("_p"))
    got = wanted.join(flat, (F.col("_s") == F.col(shard)) & (F.col("_p") == F.col("position")))
    got = got.groupBy(F.col("_s"), F.col(row).alias("_r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "vector"))), lambda x: x["vector"]).alias("vectors"))
    out = spans.join(got, (F.col(shard) == F.col("_s")) & (F.col(row) == F.col("_r")), "left")
    return out.select(shard, row, F.coalesce("vectors", F.array()).alias("vectors"))


def by_row(metadata: DataFrame, vectors: DataFrame, shard: str = "artifact_shard", row: str = "row_index", most: int | None = None) -> DataFrame:
    """metadata with the vectors of the same row of the same shard; `most` caps the rows of a shard,
    on both sides alike (a feature of the reader). A row that only one side has raises."""
    m, v = (d if most is None else d.filter(F.col(row) < most) for d in (metadata, vectors))
    v = v.select(F.col(shard).alias("_s"), F.col(row).alias("_r"), *[c for c in v.columns if c not in (shard, row)])
    both = m.join(v, (F.col(shard) == F.col("_s")) & (F.col(row) == F.col("_r")), "full")
    whole = F.assert_true(F.col(shard).isNotNull() & F.col("_s").isNotNull(), F.lit("metadata and vectors are not aligned"))
    return both.filter(whole.isNull()).drop("_s", "_r")


def trimmed_group(chunks: Column, vectors: Column) -> Column:
    """Pairs (chunk, vector) of both lists, as long as the shorter; null lists are empty."""
    n = F.least(F.greatest(F.coalesce(F.size(chunks), F.lit(0)), F.lit(0)), F.greatest(F.coalesce(F.size(vectors), F.lit(0)), F.lit(0)))
    return F.when(n > 0, F.slice(F.arrays_zip(chunks.alias("chunk"), vectors.alias("vector")), 1, n))


def packaged(ranked: DataFrame, order: list[Column], top: int, text: str | Column, by: str = "query_id", more: int | None = None) -> DataFrame:
    """ranked with place, section ('top' for the first `top` of each query, then 'more') and the text's preview.

    What is neither, if `more` bounds the second list, is left out (lists of a set length). text may be
    an expression, which is computed for the rows that stay, so that no text is sorted; of a column,
    the preview alone is."""
    preview = F.substring(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 1, PREVIEW)
    out = ranked.withColumn("preview", preview).drop(text) if isinstance(text, str) else ranked
    out = out.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))
    if more is not None:
        out = out.filter(F.col("place") <= top + more)
    out = out.withColumn("section", F.when(F.col("place") <= top, "top").otherwise("more"))
    return out if isinstance(text, str) else out.withColumn("preview", preview)


def prompt(title: Column, requirements: Column, most: int | None = None) -> Column:
    """What a model is asked about a posting; either part cut to `most` characters."""
    cut = lambda c: F.coalesce(c, F.lit("")) if most is None else F.substring(F.coalesce(c, F.lit("")), 1, most)
    return F.concat(F.lit("JOB TITLE:\n"), cut(title), F.lit("\n\nJOB REQUIREMENTS:\n"), cut(requirements))


def page_after(rows: DataFrame, key: str, last: object | None, n: int) -> DataFrame:
    """The n rows behind the key `last`, in its order (a top-k, so nothing is sorted whole)."""
    return (rows if last is None else rows.filter(F.col(key) > F.lit(last))).orderBy(key).limit(n)


def merged_json(old: Column, new: Column) -> Column:
    """Two JSON objects in one, the keys of the new one first in right; values keep their types.
    What is null or no object counts as empty."""
    entries = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    a, b = entries(old), entries(new)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))


def all_pairs(left: list[tuple], schema: str, right: DataFrame) -> DataFrame:
    """Every row of a short, stated list with every row of right, without a join: the list is a column."""
    spark = right.sparkSession
    listed = spark.createDataFrame(left, schema)
    kind = listed.schema
    items = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, kind.fields, strict=True)]) for r in left])
    return right.withColumn("_l", F.explode(items)).select("_l.*", *right.columns)


def finished(done: DataFrame, by: str, expected: int) -> DataFrame:
    """The rows of those groups that are whole: groups cut short by a stop are done again."""
    whole = done.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n")).filter(F.col("_n") == expected).select("_by")
    return done.join(whole, F.col(by) == F.col("_by"), "left_semi")


def unavailable(rows: DataFrame, key: list[str], operation: str, reason: str, **neutral: object) -> DataFrame:
    """The neutral result of an operation that cannot run: every id stays, metrics are set values."""
    return rows.select(*key, F.lit(operation).alias("operation"), F.lit("unavailable").alias("status"), F.lit(reason).alias("reason"), *[F.lit(v).alias(k) for k, v in neutral.items()])


def require_columns(df: DataFrame, wanted: StructType | str) -> DataFrame:
    """df, if it has the columns and types that a step needs; raises naming what is missing."""
    kind = wanted if isinstance(wanted, StructType) else StructType.fromDDL(wanted)
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    lacking = [f"{f.name} {f.dataType.simpleString()}" for f in kind.fields if have.get(f.name) != f.dataType.simpleString()]
    if lacking:
        raise ValueError(f"not ready: {', '.join(lacking)}")
    return df


def run_or_skip(steps: dict[str, Callable[[], object]], optional: set[str], retryable: tuple[type[Exception], ...], most: int = 3) -> dict[str, str]:
    """Run steps in order and say what became of each; optional ones may fail with a retryable
    error up to `most` times in all, and are skipped; anything else is raised."""
    out, failed = {}, 0
    for name, step in steps.items():
        try:
            step()
            out[name] = "ok"
        except retryable:
            failed += 1
            if name not in optional or failed > most:
                raise
            out[name] = "skipped"
    return out
