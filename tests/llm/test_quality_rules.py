import collections
import re

import numpy as np
from pyspark.sql import functions as F

from vacantia.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    three = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines, seen, repeated = t.split("\n"), set(), 0
    for x in lines:
        repeated += bool(WORD.search(x)) and x in seen
        seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), repeated, len(covered)


def test_counts(docs, empty):
    rows = q.judged(docs, []).collect()
    assert len(rows) == docs.count()
    for r in rows:
        got = tuple(r[f"_q_{c}"] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == brute(r["text"]), r["doc_id"]
        assert r["_q_base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])
    assert q.judged(empty, []).count() == 0


def test_learning_finds_planted_rules():
    rng = np.random.default_rng(1)
    n = 3000
    c = {k: rng.integers(50, 500, n) for k in q.COUNTS}
    c["word_chars"] = c["n_words"] * 5
    c["n_symbols"] = rng.integers(0, 40, n)
    c["n_digits"] = rng.integers(0, 200, n)
    x = q.features(c)
    bad = (x["symbols_per_char"] > 0.03) & (x["digits_per_char"] > 0.05)
    rules = q.learn(c, bad)
    hit = np.zeros(n, bool)
    for r in rules:
        hit |= q._holds(r, x, n)
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.03 * n
    assert q.learn(c, bad) == rules


def test_no_rules_without_two_kinds():
    c = {k: np.arange(10) for k in q.COUNTS}
    assert q.learn(c, np.zeros(10, bool)) == [] and q.learn({k: v[:0] for k, v in c.items()}, np.zeros(0, bool)) == []


def test_ordered_expression(spark):
    rules = [[q.Condition("words", True, 5.0)], [q.Condition("words", False, 1.0), q.Condition("symbols_per_char", True, 0.5)]]
    df = spark.createDataFrame([(9, 9, 0), (3, 3, 0), (1, 2, 2)], "n_words long, word_chars long, n_symbols long")
    assert [r[0] for r in df.select(q.verdict(rules)).collect()] == [False, True, False]


def test_fit_ignores_odd_labels(spark, docs):
    labels = spark.createDataFrame([(4, 1), (4, 1), (None, 0), (99, 0), (11, None)], "doc_id long, quality int")
    assert q.fit(docs.select("doc_id", "text"), labels) == []
    assert q.fit(docs.select("doc_id", "text"), labels.filter(F.lit(False))) == []


def test_verdicts_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = q.fit(docs, labels.filter("doc_id % 2 = 0"))
    out = q.judged(docs, rules).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not _q_base_failed")
    right = out.agg(F.avg((F.col("_q_kept") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.95


def test_few_labels_still_teach():
    rng = np.random.default_rng(5)
    c = {k: rng.integers(60, 400, 70) for k in q.COUNTS}
    c["n_words"] = rng.integers(60, 400, 70)
    c["word_chars"] = c["n_words"] * 5
    c["n_symbols"] = rng.integers(0, 4, 70)
    bad = np.zeros(70, bool)
    bad[[3, 17, 29, 44, 58, 66]] = True
    c["n_symbols"][bad] = c["word_chars"][bad] // 4
    rules = q.learn(c, bad)
    assert [r[0].feature for r in rules] == ["symbols_per_char"] and rules[0][0].above
    hit = q._holds(rules[0], q.features(c), 70)
    assert (hit == bad).all()


def test_few_labels_without_a_pattern_teach_nothing_imprecise():
    rng = np.random.default_rng(6)
    c = {k: rng.integers(60, 400, 80) for k in q.COUNTS}
    bad = rng.random(80) < 0.5
    for rule in q.learn(c, bad):
        hit = q._holds(rule, q.features(c), 80)
        assert (hit & bad).sum() >= 0.9 * hit.sum()


def test_repeated_rows_do_not_crowd_out_labels(spark):
    rows = [(1, "alpha beta gamma " * 3 + " ".join(f"w{k}" for k in range(60)))] * 13000
    rows += [(k, (" ".join(f"w{j * k % 97}" for j in range(80))) + (" ### $$$ %%%" * 30 if k % 2 else "")) for k in range(2, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0 if k % 2 and k > 1 else 1) for k in range(1, 80)], "doc_id long, quality int")
    rules = q.fit(docs, labels)
    out = q.judged(docs, rules).filter("doc_id > 1").select("doc_id", "_q_kept", "_q_base_failed").collect()
    assert all(r["_q_kept"] == (r["doc_id"] % 2 == 0) for r in out if not r["_q_base_failed"]) and not all(r["_q_base_failed"] for r in out)
