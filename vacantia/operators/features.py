"""Words of documents: TF-IDF selection, lookups and technology matching."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, blank_to_null, let, phrase_chunks, tokens, without_stop_words
from .vectors import encoded, hashing_encoder

#: Bytes of text that a task of tfidf counts at once.
BLOCK = 16 << 20


def _counted(block: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and words of a block; the pairs of both that occur (as places in them, by key) and how often."""
    keys = block.column("_k").combine_chunks().dictionary_encode(null_encoding="encode")
    lists = pc.split_pattern(block.column("_words").combine_chunks(), " ")
    words = lists.flatten().dictionary_encode()
    doc = np.repeat(keys.indices.to_numpy().astype(np.int64), lists.value_lengths().to_numpy())
    pairs, tf = np.unique(doc * len(words.dictionary) + words.indices.to_numpy(), return_counts=True)
    return keys.dictionary, words.dictionary, *np.divmod(pairs, len(words.dictionary)), tf


def _vocabulary(block: pa.Table) -> pa.Table:
    _, words, _, word, _ = _counted(block)
    return pa.table({"_b": pa.repeat(block.column("_b")[0], len(words)), "term": words, "_n": np.bincount(word, minlength=len(words))})


def _with_df(block: pa.Table, df: pa.Table) -> pa.Table:
    keys, words, doc, word, tf = _counted(block)
    at = pc.index_in(words, value_set=df.column("term").combine_chunks()).to_numpy()
    ends = pa.array(np.searchsorted(doc, np.arange(len(keys) + 1)), pa.int32())
    each = lambda values: pa.ListArray.from_arrays(ends, values)
    return pa.table({"_k": keys, "_terms": each(words.take(pa.array(word))), "_tf": each(pa.array(tf)), "_df": each(pa.array(df.column("_df").to_numpy()[at[word]]))})


def tfidf(docs: DataFrame, key: str, text: str, least_chars: int = 2, fraction: float = 0.25, most: int = 50, round_up: bool = False) -> DataFrame:
    """key, term, tf, tfidf and place of the words selected from each document.

    Weights are tf * (ln((1 + n) / (1 + df)) + 1), of unit length a document; the best
    max(1, floor(fraction * words)) stay, at most `most`; ties go to the earlier word. Rows of one key are one document.

    Documents are dealt to blocks of some BLOCK bytes. A block sends each of its words once to be counted and gets it
    back with df, so that a word of a document is never shuffled on its own; a document is weighed in its row."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-(size or 0) // BLOCK))
    words = F.filter(tokens(F.col(text)), lambda w: (F.length(w) >= least_chars) & ~w.isin(*STOP_WORDS))
    d = docs.select(F.col(key).alias("_k"), F.array_join(words, " ").alias("_words"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_b"))
    d = d.filter("_words <> ''").repartition(blocks, "_b")
    seen = d.groupBy("_b").applyInArrow(_vocabulary, "_b int, term string, _n long")
    df = seen.withColumn("_df", F.sum("_n").over(Window.partitionBy("term"))).select("_b", "term", "_df")
    w = d.groupBy("_b").cogroup(df.groupBy("_b")).applyInArrow(_with_df, f"_k {kind}, _terms array<string>, _tf array<long>, _df array<long>")
    w = w.withColumn("_w", F.zip_with("_tf", "_df", lambda tf, df: tf * (F.log((1 + F.lit(n)) / (1 + df)) + 1)))
    length = F.sqrt(F.aggregate("_w", F.lit(0.0), lambda s, x: s + x * x))
    # Rounded before ordering, so that sums in another order do not reorder equal words.
    item = lambda x, i, of: F.struct((-F.round(x / of, 9)).alias("_less"), F.get("_terms", i).alias("term"), F.get("_tf", i).alias("tf"))
    items = F.array_sort(let(length, lambda of: F.transform("_w", lambda x, i: item(x, i, of))))
    keep = (F.ceil if round_up else F.floor)(F.size("_w") * fraction)
    best = F.slice(items, F.lit(1), F.least(F.lit(most), F.greatest(F.lit(1), keep)).cast("int"))
    out = w.select("_k", F.posexplode(best).alias("_p", "_i"))
    return out.select(F.col("_k").alias(key), "_i.term", "_i.tf", (-F.col("_i._less")).alias("tfidf"), (F.col("_p") + 1).cast("long").alias("place"))


def without_frequent(docs: DataFrame, key: str, words: Column, most: int) -> DataFrame:
    """key, pos and word of the words that stand at most `most` times in their document: counted
    in one shuffle by (key, word), so that a very long document is many groups."""
    if most < 1:
        raise ValueError("most must be 1 or more")
    w = docs.select(key, F.posexplode(words).alias("pos", "word"))
    return w.withColumn("_n", F.count("*").over(Window.partitionBy(key, "word"))).filter(F.col("_n") <= most).drop("_n")


def title_text(title: Column, requirements: Column, content: Column) -> Column:
    """Title and requirements, or the whole content where there are none, as one text to encode."""
    body = F.coalesce(blank_to_null(requirements), content, F.lit(""))
    return F.concat(F.lit("Job title: "), F.coalesce(title, F.lit("")), F.lit("\nRequirements and description: "), body)


def profiles(resumes: DataFrame, key: str, text: str, terms: list[tuple[str, str]], encoder: Callable = hashing_encoder) -> DataFrame:
    """What ranking needs of each resume, to be stored and read back: its vector, its distinct words and its
    phrases with their vectors, technologies and categories. A resume without words or phrases has null vectors."""
    r = encoded(resumes.select(F.col(key), F.col(text).alias("_text")), "_text", encoder, "vector")
    words = F.array_distinct(without_stop_words(tokens(F.col("_text"))))
    for name, items in (("word", words), ("phrase", phrase_chunks(F.col("_text")))):
        long = r.select(F.col(key).alias("_k"), F.posexplode(items).alias("_p", "_i"))
        made = encoded(long, "_i", encoder, "_v").groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_p", "_i", "_v"))).alias("_l"))
        made = made.select("_k", F.transform("_l", lambda s: s["_i"]).alias(f"{name}s"), F.transform("_l", lambda s: s["_v"]).alias(f"{name}_vectors"))
        r = r.join(made, F.col(key) == F.col("_k"), "left").drop("_k")
    found = technologies(resumes.select(F.col(key).alias("_k"), F.col(text).alias("_body")), "_k", "_body", terms)
    return r.join(found, F.col(key) == F.col("_k"), "left").drop("_k", "_text")


def looked_up(docs: DataFrame, key: str, words: Column, lookup: DataFrame) -> DataFrame:
    """key and vectors: those of the words that lookup (word, vector) has, in order."""
    w = docs.select(F.col(key).alias("_k"), F.posexplode(words).alias("pos", "word"))
    got = w.join(lookup, "word")
    return got.groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vector"))), lambda s: s["vector"]).alias("vectors")).withColumnRenamed("_k", key)


def searchable(text: Column, whole: bool = False) -> Column:
    """Lower case, letters, digits, + and # alone, with a space at either end; whole: # between letters stays."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.replace(F.replace(t, F.lit(".js"), F.lit(" js")), F.lit(".net"), F.lit(" dotnet"))
    t = t if whole else F.regexp_replace(t, r"(?<=\w)[/#-](?=\w)", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9+#]+", " "), r"\s+", " "))
    return F.concat(F.lit(" "), t, F.lit(" "))


def aliases(term: str) -> list[str]:
    """How a technology may be spelled, the longest first; one-character spellings are left out."""
    spelled = set()
    for v in {term.strip(), term.replace(".", "").strip(), term.replace(".", " ").strip(), term.replace("-", " ").strip(), term.replace("/", " ").strip()} - {""}:
        t = v.lower().replace(".js", " js").replace(".net", " dotnet")
        t = re.sub(r"(?<=\w)[/#-](?=\w)", " ", t)
        t = " ".join(re.sub(r"[^a-z0-9+#]+", " ", t).split())
        spelled |= {t, t.replace(" ", "")}
    return sorted((a for a in spelled if a and not re.fullmatch("[a-z0-9]", a)), key=lambda a: (-len(a), a))


def read_terms(lines: DataFrame) -> DataFrame:
    """name and category from Markdown lines (path, n, value): headings are categories."""
    t = F.trim("value")
    head = F.when(t.startswith("#"), F.trim(F.regexp_replace(t, "^#+", "")))
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a file's own lines
    out = lines.withColumn("category", F.last(head, ignorenulls=True).over(w))
    return out.filter(~t.startswith("#") & (t != "") & F.col("category").isNotNull()).select(F.regexp_replace(t, r"^[-*]\s*", "").alias("name"), "category")


def technologies(docs: DataFrame, key: str, text: str, terms: list[tuple[str, str]], whole: bool = False) -> DataFrame:
    """key, technologies and categories, sorted, of each document.

    A spelling ends where no letter or digit follows; whole: + and # are letters too, so that
    "of##" is not "of", and every spelling stands between spaces.

    A text is normalised once. Its words, and the phrases that begin with a word that some
    spelling begins with, are looked up in a set of spellings; only spellings with
    other signs than letters and digits are searched one by one. No join and no shuffle."""
    single, phrases, signs = {}, {}, []
    for name, category in terms:
        for a in aliases(name):
            if " " in a:
                phrases.setdefault(a, []).append((name, category))
            elif a.isalnum():
                single.setdefault(a, []).append((name, category))
            else:
                signs.append((a, name, category))
    pair = lambda n, c: F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"))
    known = single | phrases
    meaning = F.create_map(*chain.from_iterable((F.lit(a), F.array(*[pair(*x) for x in v])) for a, v in known.items())) if known else None

    def spelled(s: Column) -> Column:
        found = [F.array().cast("array<string>")]
        if single:
            found.append(F.filter(F.split(s, " " if whole else "[^a-z0-9]+"), lambda w: w.isin(list(single))))
        if phrases:
            heads, longest = {a.split()[0] for a in phrases}, max(a.count(" ") for a in phrases) + 1

            def at(words: Column) -> Column:
                starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.try_element_at(words, i).isin(list(heads)))
                lengths = F.array(*[F.lit(n) for n in range(2, longest + 1)])
                made = F.flatten(F.transform(starts, lambda i: F.transform(lengths, lambda n: F.array_join(F.slice(words, i, n), " "))))
                return F.filter(made, lambda w: w.isin(list(phrases)))

            found.append(let(F.split(F.trim(s), " "), at))
        return F.array_distinct(F.concat(*found))

    letter = "[a-z0-9+#]" if whole else "[a-z0-9]"

    def hits(s: Column) -> Column:
        out = [F.flatten(F.transform(spelled(s), lambda w: F.element_at(meaning, w)))] if known else []
        out += [F.array_compact(F.array(*[F.when(s.rlike(f"(?<!{letter}){re.escape(a)}(?!{letter})"), pair(n, c)) for a, n, c in signs]))] if signs else []
        return F.concat(*out) if out else F.array().cast("array<struct<name:string,category:string>>")

    found = docs.select(key, let(searchable(F.col(text), whole), hits).alias("_hits"))
    names = lambda f: F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h[f])))
    return found.select(key, names("name").alias("technologies"), names("category").alias("categories"))
