"""Quality rules learned as a decision list.

Statistics of whole texts are counted in numpy over Arrow batches. From labelled
statistics, sequential covering learns rules that name low-quality texts: each rule
is a conjunction of thresholds, grown by FOIL gain on two thirds of the labels, then
pruned on the last third (by cross-validation where that is too small), and kept
only if it is precise there. The rules come out as one ordered Spark conditional
expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import tune_arrow
from .textkernel import DIGIT, LEAD, PUNCT, SYMBOL, UPPER, Words, runs, slices

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_upper", "n_punct", "n_distinct_words"]

#: Features of the rules, as (numerator, denominator) of the counts; a zero denominator counts as one.
FEATURES = {
    "words": ("n_words", None),
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_char": ("n_symbols", "word_chars"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "distinct_words": ("n_distinct_words", "n_words"),
    "digits_per_char": ("n_digits", "word_chars"),
    "upper_per_char": ("n_upper", "word_chars"),
    "punctuation_per_word": ("n_punct", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}

#: Labelled rows to fit on at most, by the least hash of their doc_id.
FIT_ROWS = 6000


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The COUNTS of each text; null is empty.

    word_chars: code points in words. n_dup_lines: lines with a word that equal an
    earlier line. n_repeat_words: words inside a 3-word window that the text has
    twice or more, the first included. Words and lines are told apart by 64-bit hashes."""
    out = {c: np.zeros(len(texts), np.int64) for c in COUNTS}
    for at, n, data, off in slices(texts):
        w = Words(data, off)
        put = {"n_words": w.count, "word_chars": w.sums(w.solid & LEAD[data]), "n_symbols": w.sums(SYMBOL[data]), "n_digits": w.sums(DIGIT[data]), "n_upper": w.sums(UPPER[data]), "n_punct": w.sums(PUNCT[data])}
        start, end, doc = w.lines()
        solid = np.zeros(len(data) + 1, np.int64)
        np.cumsum(w.solid, out=solid[1:])
        full = solid[end] > solid[start]
        start, end, doc = start[full], end[full], doc[full]
        _, first = runs(doc, w.hashes(start, end))
        put["n_lines"] = np.bincount(doc, minlength=n)
        put["n_dup_lines"] = np.bincount(doc[~first], minlength=n)
        h = w.hashes(w.start, w.end)
        _, first = runs(w.doc, h)
        put["n_distinct_words"] = np.bincount(w.doc[first], minlength=n)
        if len(h) >= 3:
            with np.errstate(over="ignore"):
                three = h[:-2] * np.uint64(0xA24BAED4963EE407) + (h[1:-1] ^ np.uint64(0x51ED270B35)) * np.uint64(0x9FB21C651E98DF25) + h[2:]
            own = np.flatnonzero(w.doc[:-2] == w.doc[2:])
            count, _ = runs(w.doc[own], three[own])
            twice = own[count > 1]
            covered = np.zeros(len(h), bool)
            for k in range(3):
                covered[twice + k] = True
            put["n_repeat_words"] = np.bincount(w.doc[covered], minlength=n)
        for c, v in put.items():
            out[c][at : at + n] = v
    return out


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the COUNTS of its text appended, each named prefix + count."""
    taken = {c.lower() for c in docs.columns} & {(prefix + c).lower() for c in COUNTS}
    if taken:
        raise ValueError(f"columns {sorted(taken)} exist already; give another prefix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = text_counts(b.column(b.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c[k]) for k in COUNTS)], names=[*b.schema.names, *(prefix + k for k in COUNTS)])

    tune_arrow(docs.sparkSession)
    schema = StructType([*docs.schema.fields, *(StructField(prefix + c, LongType()) for c in COUNTS)])
    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut

    def column(self, prefix: str = "") -> Column:
        a, b = FEATURES[self.feature]
        value = F.col(prefix + a).cast("double")
        if b:
            value = value / F.greatest(F.col(prefix + b), F.lit(1))
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


def features(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f: counts[a] / (np.maximum(counts[b], 1) if b else 1.0) for f, (a, b) in FEATURES.items()}


def _cuts(v: np.ndarray) -> np.ndarray:
    """Midpoints between neighbouring quantiles of v."""
    q = np.unique(np.quantile(v, np.linspace(0, 1, 41)))
    return (q[1:] + q[:-1]) / 2


def _holds(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    m = np.ones(n, bool)
    for c in rule:
        m &= c.holds(x)
    return m


#: A part of the labels with fewer rows of either kind is too small to prune on.
FEW, FOLDS = 10, 5


def _least(bad: np.ndarray) -> int:
    """Bad rows that a rule must cover: an eighth of them, at least 2 and at most 5."""
    return int(min(5, max(2, bad.sum() // 8)))


def _grown(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray, least: int, most: int) -> list[Condition]:
    """A conjunction grown on the rows inside: each condition is the one of most FOIL gain."""
    rule: list[Condition] = []
    while len(rule) < most:
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for f, v in x.items():
            for cut in _cuts(v[inside]):
                for above in (True, False):
                    hit = inside & ((v > cut) if above else (v <= cut))
                    p1, n1 = (bad & hit).sum(), (~bad & hit).sum()
                    if p1 < least:
                        continue
                    g = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p0 / (p0 + n0)))
                    if g > gain:
                        best, gain = Condition(f, above, float(f"{cut:.8g}")), g
        if best is None:
            break
        rule.append(best)
        inside = inside & best.holds(x)
    return rule


def _worth(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray, where: np.ndarray) -> tuple[int, int]:
    hit = _holds(rule, x, len(bad)) & where
    return int((bad & hit).sum()), int((~bad & hit).sum())


def _share(p: int, q: int) -> float:
    return (p - q) / (p + q) if p + q else -1.0


def _pruned(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray) -> list[Condition]:
    """The rule without the conditions that do not pay on the rows to prune on."""
    while len(rule) > 1:
        shorter = max((rule[:k] + rule[k + 1 :] for k in range(len(rule))), key=lambda r: _share(*_worth(r, x, bad, prune)))
        if _share(*_worth(shorter, x, bad, prune)) < _share(*_worth(rule, x, bad, prune)):
            break
        rule = shorter
    return rule


def _cross_validated(x: dict[str, np.ndarray], bad: np.ndarray, left: np.ndarray, fold: np.ndarray, least: int, most: int) -> list[Condition]:
    """A rule grown on all rows left, cut to the number of conditions that does best on
    rows that rules grown without them have not seen."""
    tally = np.zeros((most + 1, 2), np.int64)
    for k in range(FOLDS):
        rule = _grown(x, bad, left & (fold != k), max(2, least - 1), most)
        for size in range(1, most + 1):
            tally[size] += _worth(rule[:size], x, bad, left & (fold == k)) if rule else (0, 0)
    size = max(range(1, most + 1), key=lambda m: (_share(*tally[m].tolist()), -m))
    return _grown(x, bad, left, least, most)[:size]


def learn(counts: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, least: int | None = None, most_conditions: int = 4, seed: int = 7) -> list[list[Condition]]:
    """An ordered list of rules, each a conjunction that names bad texts.

    Grown on two thirds and pruned on one third of the labels; where that third has
    fewer than FEW rows of either kind, grown on all and pruned by cross-validation
    in FOLDS parts. A rule stays if its precision on every part it is tested on is at
    least `precision` and it covers `least` bad rows (by default an eighth of the bad
    rows, 2 at least and 5 at most). No rows, or labels of one kind only: no rules."""
    x = features(counts)
    n = len(bad)
    if not n or bad.all() or not bad.any():
        return []
    least = _least(bad) if least is None else least
    draw = np.random.default_rng(seed).random(n)
    hold, fold = draw < 1 / 3, (draw * FOLDS).astype(int)
    left, rules = np.ones(n, bool), []
    while (bad & left).sum() >= least and len(rules) < 32:
        grow, prune = left & ~hold, left & hold
        if min((bad & prune).sum(), (~bad & prune).sum()) >= FEW:
            parts = (grow, prune)
            rule = _pruned(_grown(x, bad, grow, least, most_conditions), x, bad, prune)
        else:
            parts = (left,)
            rule = _cross_validated(x, bad, left, fold, least, most_conditions)
        if not rule:
            break
        hits = [_worth(rule, x, bad, part) for part in parts]
        if sum(p for p, _ in hits) < least or any(p + q and p < precision * (p + q) for p, q in hits):
            break
        rules.append(rule)
        left &= ~_holds(rule, x, n)
    return rules


def verdict(rules: list[list[Condition]], prefix: str = "") -> Column:
    """The rules as one ordered conditional: false at the first rule that holds, else true."""
    out = F.lit(True)
    for rule in reversed(rules):
        both = rule[0].column(prefix)
        for c in rule[1:]:
            both &= c.column(prefix)
        out = F.when(both, F.lit(False)).otherwise(out)
    return out


def base_failed(prefix: str = "") -> Column:
    """Under 50 words, or over half of the words in repeated 3-word windows."""
    n = F.col(f"{prefix}n_words")
    return (n < 50) | (F.col(f"{prefix}n_repeat_words") * 100 > n * 50)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, **options: float) -> list[list[Condition]]:
    """Learn rules from at most `rows` labelled documents (quality 0 is bad), chosen by
    the hash of doc_id, so a rerun learns the same. Rows that fail the base tests are
    not learned from, as rules apply to those that pass. Labels without a document,
    null labels and null ids are ignored; a doc_id labelled or standing more than once
    counts once (its worst label, its least row of counts)."""
    marks = labels.select(F.col("doc_id").alias("_id"), "quality").filter("_id IS NOT NULL AND quality IS NOT NULL")
    marks = marks.groupBy("_id").agg(F.min("quality").alias("quality"))
    marks = F.broadcast(marks.orderBy(F.xxhash64("_id"), "_id").limit(rows))  # its size is the bound
    seen = docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("_id"))
    stats = with_counts(seen.select("doc_id", "quality", "text")).drop("text").filter(~base_failed())
    # One row an id, the least by its counts; there are no more ids than marks.
    stats = stats.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min(F.struct(*COUNTS)).alias("c")).select("doc_id", "quality", "c.*")
    got = stats.orderBy("doc_id").toPandas()
    counts = {c: got[c].to_numpy(np.int64) for c in COUNTS}
    return learn(counts, got["quality"].to_numpy() == 0, **options)


def judged(docs: DataFrame, rules: list[list[Condition]], prefix: str = "_q_") -> DataFrame:
    """docs, its counts, {prefix}base_failed and {prefix}kept.

    A null or empty text has no words and fails; equal texts have equal verdicts;
    an empty table gives an empty one; extra columns pass through."""
    out = with_counts(docs, prefix=prefix)
    out = out.withColumn(f"{prefix}base_failed", base_failed(prefix))
    return out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & verdict(rules, prefix))
