"""From raw documents to packed sequences, in stages that each call one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read back as the next stage's docs; all but the last return the
columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import mixing, packing, quality_rules, simhash
from vacantia.llm.common import stored, table
from vacantia.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base tests and the learned decision list keep."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judged(docs.select(*COLUMNS), rules).filter("_q_kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that with the smallest doc_id.

    Rows of the component that share that doc_id are one document: the first by
    fingerprint and then by text stays. A document without an id stays only if no
    document of its component has one: then the first by text of the component's
    least fingerprint."""
    found = stored(simhash.grouped(docs.select("doc_id", "text")), "dedup-found")
    keep = found.filter("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("k")).select("k.*")
    rows = found.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_of")).agg(F.count("*").alias("_n"))
    keep = stored(keep.join(rows, F.col("doc_id") == F.col("_of")).select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"), "_n"), "dedup-keep")
    # Texts are dealt out by id at every size: keep has no proven bound, so it is not broadcast.
    once = docs.select(*COLUMNS).join(keep.filter("_n = 1").hint("merge"), F.col("doc_id") == F.col("_id")).select(*COLUMNS)
    # Where an id stands on several rows, or there is none, fingerprints name the rows.
    least = found.filter("component_id IS NULL").groupBy("root").agg(F.min("fp").alias("_fp"))
    named = stored(keep.filter("_n > 1").select("_id", "_fp").unionByName(least.select(F.lit(None).cast("long").alias("_id"), "_fp")), "dedup-named")
    if named.isEmpty():
        return once
    ids = named.select("_id").distinct().hint("merge")
    some = docs.select(*COLUMNS).join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    some = simhash.with_fingerprints(some.withColumn("_text", F.col("text")), "_text", "_own_fp")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own_fp") == F.col("_fp"))
    first = some.join(named.hint("merge"), same).groupBy("_own_fp", "doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r"))
    return once.unionByName(first.select("doc_id", "r.*").select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by source weights takes them."""
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    return packing.packed(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [("quality rules", quality), ("simhash near-dedup", near_duplicates), ("source mixing", mix), ("packing", pack)]

#: Learned rules, Newton iterations and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
