"""Shards and documents as files: read with the schema given, written in one pass."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed

#: The namespace of the elements of a DOCX document (a fixed value).
_DOCX = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def write_shards(df: DataFrame, path: str, shard: str = "artifact_shard") -> None:
    """One folder a shard; rows reach their shard's writers in one shuffle."""
    df.repartition(F.col(shard)).write.mode("overwrite").partitionBy(shard).parquet(path)


def read_shard(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """All shards, or one by partition pruning; a shard that is not there has no rows."""
    df = spark.read.parquet(path)
    return df if number is None else df.filter(F.col("artifact_shard") == number)


def metadata_json(df: DataFrame) -> DataFrame:
    """One JSON line a row, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def read_csv(spark: SparkSession, path: str, schema: str, text: str, index: str = "csv_row_index") -> DataFrame:
    """Rows of CSV files with text, trimmed, and their number in the file before others are dropped.

    The schema is given, never inferred. Rows of several lines keep a file in one task, so
    numbering a file's rows moves no more than that task reads."""
    df = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"').withColumn("_row", F.monotonically_increasing_id())
    df = df.withColumn(index, F.row_number().over(Window.partitionBy("_metadata.file_path").orderBy("_row")).cast("long") - 1)
    return df.drop("_row").withColumn(text, trimmed(F.col(text))).filter(F.col(text) != "")


def read_shards(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    """Several shards at once, by partition pruning: what a loop would fetch ahead, tasks read side by side."""
    return spark.read.parquet(path).filter(F.col("artifact_shard").isin(*numbers))


def read_texts(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """path, text and sha256 of every matching file below a folder."""
    t = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return t.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.sha2("value", 256).alias("sha256"))


def within_limit(df: DataFrame, content: str, most: int, strict: bool = False) -> DataFrame:
    """df without rows whose content has more than `most` bytes; strict raises on the first of them."""
    n = F.length(content)
    if strict:
        return df.filter(F.assert_true(F.coalesce(n, F.lit(0)) <= most, F.concat(F.lit(f"over {most} bytes: "), n.cast("string"))).isNull())
    return df.filter(n <= most)


def dataset_hash(spark: SparkSession, path: str, pattern: str = "*.md") -> str:
    """One SHA-256 over the paths and bytes of all files, in order of path: a set of resumes, read as a query."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    each = f.select("path", F.sha2("content", 256).alias("h")).agg(F.array_sort(F.collect_list(F.struct("path", "h"))).alias("all"))
    return each.select(F.sha2(F.to_json("all"), 256)).first()[0]


def uploaded_text(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """path and text of uploaded resumes: plain text, DOCX (its paragraphs), and PDF where pypdf is
    installed; white space is one space. A file of another kind, or one that cannot be read, has null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b[name], "text": [_upload(p, c) for p, c in zip(b[name], b[content], strict=True)]})

    return files.select(name, content).mapInPandas(run, "path string, text string")


def _upload(path: str, content: bytes) -> str | None:
    kind = (path or "").lower().rsplit(".", 1)[-1]
    try:
        if kind in ("txt", "md"):
            found = bytes(content).decode("utf-8")
        elif kind == "docx":
            with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                root = ElementTree.fromstring(z.read("word/document.xml"))
            found = "\n".join("".join(t.text or "" for t in p.iter(f"{_DOCX}t")) for p in root.iter(f"{_DOCX}p"))
        elif kind == "pdf":
            from pypdf import PdfReader

            found = "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(bytes(content))).pages)
        else:
            return None
    except (UnicodeDecodeError, zipfile.BadZipFile, KeyError, ElementTree.ParseError, ImportError, ValueError):
        return None
    return " ".join(found.split())
