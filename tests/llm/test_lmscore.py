import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from vacantia.llm import lmscore


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(rows):
    """(losses under the target, under the background) of rows (text, in target, in background)."""
    vocab = {w for t, *side in rows if any(side) for w in words(t)} | ({"$"} if any(words(t) and any(s) for t, *s in rows) else set())
    # The vocabulary is that of all rows that are packed, scored ones included.
    vocab |= {w for t, *_ in rows for w in [*words(t), "$"] if words(t)}
    out = []
    for k, (text, *_) in enumerate(rows):
        losses, own = [], [*words(text), "$"] if words(text) else []
        for side in (1, 2):
            single, pair = collections.Counter(), collections.Counter()
            for j, r in enumerate(rows):
                if r[side] and j != k and words(r[0]):
                    s = [*words(r[0]), "$"]
                    single.update(s)
                    pair.update(zip(["^", *s], s, strict=False))
            history = collections.Counter()
            for (h, _), n in pair.items():
                history[h] += n
            total = sum(single.values())
            loss = 0.0
            for h, w in zip(["^", *own], own, strict=False):
                p = (single[w] + lmscore.ADD) / (total + lmscore.ADD * (len(vocab) + 1))
                loss -= math.log((pair[(h, w)] + lmscore.PRIOR * p) / (history[h] + lmscore.PRIOR))
            losses.append(loss / max(len(own), 1))
        out.append(losses)
    return out


@pytest.mark.parametrize("bytes_", [1 << 23, 700])
def test_against_brute_force(spark, docs, empty, monkeypatch, bytes_):
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", bytes_)
    monkeypatch.setattr(lmscore, "PART_BYTES", bytes_)
    plain = docs.select("doc_id", "text", "lang").filter("length(text) < 2000 OR text IS NULL")
    chosen, known = F.col("doc_id").isin(4, 11), F.coalesce(F.col("doc_id") != 6, F.lit(True))
    got = lmscore.scored(plain, chosen, known).collect()
    rows = plain.select("text", F.coalesce(chosen, F.lit(False)), known, "doc_id").collect()
    assert len(got) == len(rows)
    want = sorted((str(r[3]), round(t, 7), round(b, 7)) for r, (t, b) in zip(rows, brute([(r[0], r[1], r[2]) for r in rows]), strict=True))
    have = sorted((str(r["doc_id"]), round(r["target_loss"], 7), round(r["background_loss"], 7)) for r in got)
    for x, y in zip(want, have, strict=True):
        assert x[0] == y[0] and x[1:] == pytest.approx(y[1:], abs=1e-6)
    by = {r["doc_id"]: r for r in got}
    assert by[0]["score"] == 0 and by[1]["n_tokens"] == 0 and by[3]["n_tokens"] == 1
    assert lmscore.scored(empty.select("doc_id", "text"), F.lit(True)).count() == 0


def test_relays_change_nothing_and_bound_the_blobs(spark, docs, monkeypatch):
    plain = docs.select("doc_id", "text").filter("length(text) < 2000 OR text IS NULL")
    want = sorted(map(str, lmscore.scored(plain, F.col("doc_id") < 9).collect()))
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 300)
    monkeypatch.setattr(lmscore, "PART_BYTES", 150)
    monkeypatch.setattr(lmscore, "FAN_BITS", 1)
    monkeypatch.setattr(lmscore, "FAN", 2)
    seen, answered = [], lmscore._answered

    def watched(sent):
        parts = sent.groupBy("part").agg(F.count("*").alias("n")).agg(F.count("*"), F.max("n")).first()
        senders = sent.groupBy("block").agg(F.count("*").alias("n")).agg(F.max("n")).first()
        seen.append((*parts, *senders))
        return answered(sent)

    monkeypatch.setattr(lmscore, "_answered", watched)
    assert sorted(map(str, lmscore.scored(plain, F.col("doc_id") < 9).collect())) == want
    assert seen[0][0] > 4 and seen[0][2] <= 2


def test_whole_table_clashes_and_nulls(spark, docs):
    got = lmscore.scored(docs.drop("n_words", "feature").withColumn("flag", F.lit(None).cast("boolean")), F.col("flag"))
    assert got.count() == docs.count() and got.columns == ["doc_id", "source", "lang", "flag", *lmscore.OUT]
    with pytest.raises(ValueError):
        lmscore.scored(docs.withColumn("score", F.lit(1)), F.lit(True))


def test_a_second_copy_is_seen_and_rare_words_count(spark):
    rows = [(k, "filler " * 1000) for k in range(60)]
    rows += [(1000, "rare good pair"), (1001, "rare good pair"), (1002, "scarce bad couple"), (1003, "scarce bad couple"), (1004, "once alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lmscore.scored(docs, F.expr("doc_id = 1000 OR doc_id < 50")).collect()}
    assert len(got) == len(rows)
    assert got[1001]["score"] < got[1002]["score"] == got[1003]["score"]
    # Copies know each other; a document that stands alone knows none of its words.
    assert got[1002]["background_loss"] < got[1004]["background_loss"] - 1
    again = {r["doc_id"]: r for r in lmscore.scored(docs.repartition(7), F.expr("doc_id = 1000 OR doc_id < 50")).collect()}
    assert again == got


def test_labels(spark, docs):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (6, 1, 1), (7, 0, 0), (8, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = lmscore.with_good(docs, labels)
    assert out.count() == docs.count() and {r["doc_id"] for r in out.filter("is_good").collect()} == {4, 8}
