import corpus_pipeline
from vacantia.llm import queries


def test_stages_and_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
    assert docs.filter("length > 0").count() == docs.count() > 0


def test_run_keeps_clean_documents_once(spark):
    sf = "/root/testdata/sf0.001"
    kept = corpus_pipeline.quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert kept.join(labels.filter("quality = 0"), "doc_id").count() == 0
    once = corpus_pipeline.near_duplicates(spark, kept.union(kept), sf)
    assert once.count() == once.select("doc_id").distinct().count() <= kept.count()


def test_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_every_query_runs(spark):
    for name, f in queries.QUERIES.items():
        assert f(spark, "/root/testdata/sf0.001").count() > 0, name


def test_near_duplicates_keep_different_documents_without_ids(spark):
    texts = [" ".join(f"{w}{k}" for w in ("alpha", "beta", "gamma", "delta", "epsilon", "zeta")) for k in range(4)]
    rows = [(1, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (4, texts[3])]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, texts[0]), (None, texts[1]), (None, texts[2]), (4, texts[3])], key=str)


def _texts(n):
    return [" ".join(f"{w}{k}" for w in ("alpha", "beta", "gamma", "delta", "epsilon", "zeta")) for k in range(n)]


def _docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicates_where_an_id_stands_twice(spark):
    a, b, c, _ = _texts(4)
    got = corpus_pipeline.near_duplicates(spark, _docs(spark, [(3, b), (5, a), (5, b), (5, a), (6, c), (7, c)]), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(3, b), (5, a), (6, c)])
    # Different documents that share one id are both kept.
    got = corpus_pipeline.near_duplicates(spark, _docs(spark, [(5, a), (5, c)]), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(5, a), (5, c)])


def test_stages_with_nulls_ties_and_extra_columns(spark):
    texts = [" ".join(f"word{j}of{k}" for j in range(60)) + "." for k in range(6)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[2]), (9, None), (None, None), (3, texts[3]), (10, "")]
    docs = _docs(spark, rows).selectExpr("doc_id", "text", "IF(doc_id = 1, NULL, lang) AS lang", "IF(doc_id = 2, NULL, source) AS source", "n_chars", "'x' AS _n", "'x' AS fp", "'x' AS _copies")
    kept = corpus_pipeline.quality(spark, docs, "/root/testdata/sf0.001")
    assert kept.columns == corpus_pipeline.COLUMNS and kept.filter("text IS NULL OR text = ''").count() == 0
    once = corpus_pipeline.near_duplicates(spark, docs, "")
    assert once.columns == corpus_pipeline.COLUMNS and sorted(r["doc_id"] for r in once.collect()) == [0, 1, 2, 3, 4, 5, 9]
    mixed = corpus_pipeline.mix(spark, once, "")
    assert mixed.columns == corpus_pipeline.COLUMNS and mixed.filter("doc_id = 9").count() == 1
    pieces = corpus_pipeline.pack(spark, docs, "")
    assert pieces.select("doc_id").distinct().count() == 9
