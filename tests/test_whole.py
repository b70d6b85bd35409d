"""Queries that leave no rows of their tables out."""

from vacantia.plans import registry

SF = "/root/testdata/sf0.01"  # the smallest size with job ids of 200 and more


def test_filled_scores_ranks_every_candidate(spark):
    want = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_suppkey % 20", "l_partkey").distinct().count()
    got = registry.QUERIES["filled_scores"](spark, SF)
    assert got.count() == want


def test_phrase_coverage_uses_every_vector_of_the_resume(spark):
    import numpy as np

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    unit = {r["vec_id"]: np.array(r["embedding"], float) / np.linalg.norm(r["embedding"]) for r in rows}
    resume = np.stack([unit[r["vec_id"]] for r in rows if r["label"] == 0])
    got = {r["vec_id"]: r["nearest"] for r in registry.QUERIES["phrase_coverage"](spark, SF).collect()}
    want = {r["vec_id"]: 1 - (resume @ unit[r["vec_id"]]).max() for r in rows if r["label"] == 1}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 2e-6 for k, v in want.items())
