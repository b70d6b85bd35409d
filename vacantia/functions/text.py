"""Text scalars as column expressions. Every one stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities that are unescaped natively (fixed values of HTML).
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&bull;", "•"), ("&amp;", "&")]

#: Text that stands for no text (fixed values).
NOT_TEXT = ("nan", "none", "null")

#: A small English stop-word list, version 1; the engine's own.
STOP_WORDS = "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your".split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: inside lambdas an outer expression
    would be computed again for every item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_of_each(items: Column, key: Callable[[Column], Column]) -> Column:
    """Items in order without those whose key an earlier one has (no list is copied item by item)."""
    def first(every: Column) -> Column:
        return let(F.transform(every, key), lambda keys: F.filter(every, lambda s, k: F.array_position(keys, keys[k]) == k + 1))

    return let(items, first)


def trimmed(c: Column) -> Column:
    """c without white space at either end (the session's trim takes spaces alone)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def usable(c: Column) -> Column:
    """Not null, not blank, and none of NOT_TEXT in any case."""
    t = F.lower(trimmed(c))
    return F.coalesce(~t.isin("", *NOT_TEXT), F.lit(False))


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trimmed(F.regexp_replace(c, r"\s+", " "))


def unescaped(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def html_to_text(c: Column) -> Column:
    """Markup to text: entities first, scripts and styles out, breaks and block ends as
    new lines, list items as dashes; empty is null."""
    t = unescaped(c)
    for pattern, to in (
        (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</(p|div|h[1-6]|li)>", "\n"),
        (r"(?i)<li[^>]*>", "- "),
        (r"<[^>]+>", " "),
        (r"\r", ""),
        (r"[ \t]+", " "),
        (r"\n{3,}", "\n\n"),
    ):
        t = F.regexp_replace(t, pattern, to)
    return blank_to_null(t)


def normalized(c: Column) -> Column:
    """Line ends, blanks and empty lines made uniform, for the requirement rules."""
    t = F.regexp_replace(c, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return trimmed(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def tokens(c: Column) -> Column:
    """Lower-case words of letters, with one apostrophe part."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z]+(?:'[a-z]+)?"), F.lit(0))


def without_stop_words(words: Column, stop: list[str] = STOP_WORDS) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop))


def without_frequent(words: Column, most: int) -> Column:
    """Drop words that stand more than `most` times in the array, by one map of counts."""
    def count(all_words: Column) -> Column:
        return F.aggregate(all_words, F.create_map().cast("map<string,int>"), lambda acc, w: F.map_concat(F.map_filter(acc, lambda k, _: k != w), F.create_map(w, F.coalesce(F.try_element_at(acc, w), F.lit(0)) + 1)))

    return let(words, lambda all_words: let(count(all_words), lambda n: F.filter(all_words, lambda w: F.element_at(n, w) <= most)))


def sentences(c: Column) -> Column:
    """Pieces after . ! ? and white space, or between empty lines; collapsed, none empty."""
    parts = F.split(c, r"(?<=[.!?])\s+|\n{2,}")
    return F.filter(F.transform(parts, collapsed), lambda s: s != "")


_CLAUSE = r"\s*[;:]\s+|\s+--\s+|\s+[\x{2013}\x{2014}]\s+|\s*,\s+(?=(?i:and|or|but|while|where|which|that|using|including|with|to)\b)"


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def clauses(sentence: Column) -> Column:
    """Clauses of a sentence; one of under four words is glued to the one before."""
    parts = F.filter(F.transform(F.split(sentence, _CLAUSE), collapsed), lambda s: s != "")
    return F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((F.size(acc) > 0) & (word_count(p) < 4), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(acc, F.lit(-1)), p)))).otherwise(F.concat(acc, F.array(p))),
    )


def phrase_chunks(c: Column, least: int = 3, most: int = 24) -> Column:
    """Clauses (long ones cut into runs of `most` words), sentences and windows of two
    sentences, of `least` to `most` words; the first of equal ones, whatever their case, stays."""
    def cut(s: Column) -> Column:
        return let(F.split(s, " "), lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / most).cast("int")), lambda i: F.array_join(F.slice(w, i * most + 1, most), " ")))

    def fits(s: Column) -> Column:
        return let(F.size(F.split(s, " ")), lambda n: (n >= least) & (n <= most))

    def build(found: Column) -> Column:
        per = F.flatten(F.transform(found, lambda s: F.concat(F.flatten(F.transform(clauses(s), cut)), F.array(s))))
        n = F.greatest(F.size(found) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(found, F.lit(1), n), F.slice(found, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
        windows = F.transform(pairs, lambda s: F.array_join(F.slice(F.split(s, " "), 1, most), " "))
        return first_of_each(F.filter(F.concat(per, windows), fits), F.lower)

    return let(sentences(collapsed(c)), build)


def word_windows(c: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of words; the last is the first that reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    step = size - overlap

    def build(words: Column) -> Column:
        last = F.greatest(F.ceil((F.size(words) - size) / step), F.lit(0)).cast("int")
        made = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * step + 1, size), " "))
        return F.when(F.size(words) > 0, made).otherwise(F.array().cast("array<string>"))

    return let(F.filter(F.split(c, r"\s+"), lambda w: w != ""), build)


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns in a canonical form, version 1: each as its length and text, null as -."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def joined(*parts: Column, by: str = " | ") -> Column:
    """Distinct non-blank parts in order."""
    return F.array_join(F.array_distinct(F.filter(F.transform(F.array(*parts), trimmed), lambda x: x != "")), by)


def listed(c: Column) -> Column:
    """A JSON list of strings, or else a text split at bars; blanks dropped."""
    got = F.coalesce(F.from_json(F.when(F.ltrim(c).startswith("["), c), "array<string>"), F.split(c, r"\|"))
    return F.filter(F.transform(got, trimmed), lambda x: x != "")


def cut_utf8(c: Column, most: int) -> Column:
    """At most `most` bytes of UTF-8, never a part of a character."""
    raw = F.encode(c, "UTF-8")
    # The character that the cut would split starts at most three bytes before it.
    at = lambda k: F.conv(F.hex(F.substring(raw, most + 1 - k, 1)), 16, 10).cast("int")
    inside = lambda k: (at(k) >= 128) & (at(k) < 192)
    back = F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(F.substring(raw, F.lit(1), F.lit(most) - back), "UTF-8"))


def without_nul(c: Column) -> Column:
    return F.translate(c, "\x00", "")
