"""What postings pages hold: the description, structured data, and embedded state.

A page's tree is built by Python's own parser in Arrow batches; what is chosen from
it (which text is a description, which fields a posting has) is column expressions."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import extract, text

#: Elements whose text is no description, and elements without an end tag (fixed values).
DROPPED = frozenset("script style noscript form button input textarea select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Where descriptions stand: a tag, classes it has, and a part of its class attribute (fixed values).
PLACES = [("div", {"job__description", "body"}, ""), ("div", set(), "job__description"), ("div", {"job-description"}, ""), ("div", set(), "job-description"), ("div", {"posting-page"}, ""), ("div", {"posting-page-content"}, ""), ("section", {"posting"}, ""), ("main", set(), ""), ("article", set(), "")]


class Tree(HTMLParser):
    """The elements of a page, each with the stretch of the page's lines that stands in it."""

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.elements: list[list] = []  # tag, class attribute, first line, line behind the last
        self.open: list[int] = []
        self.places: dict[str, list[int]] = {}
        self.dropped = 0
        self.feed(source)
        self.close()
        self._shut(0)

    def _shut(self, k: int) -> None:
        for i in self.open[k:]:
            self.elements[i][3] = len(self.lines)
            self.dropped -= self.elements[i][0] in DROPPED
            self.places[self.elements[i][0]].pop()
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.elements.append([tag, dict(attrs).get("class") or "", len(self.lines), len(self.lines)])
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(len(self.elements) - 1)
            self.dropped += tag in DROPPED

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.elements.append([tag, dict(attrs).get("class") or "", len(self.lines), len(self.lines)])

    def handle_endtag(self, tag: str) -> None:
        if self.places.get(tag):
            self._shut(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.lines += [x for x in (" ".join(line.split()) for line in data.strip().splitlines()) if x]

    def texts(self) -> tuple[list[str], str]:
        """The texts of the elements at PLACES, place by place, and that of the body."""
        found = []
        for tag, classes, part in PLACES:
            found += ["\n".join(self.lines[a:b]) for t, c, a, b in self.elements if t == tag and classes <= set(c.split()) and part in c]
        body = next(([a, b] for t, _, a, b in self.elements if t == "body"), [0, len(self.lines)])
        return found, "\n".join(self.lines[body[0] : body[1]])


def node_texts(page: Column) -> Column:
    """struct<nodes, body>: the cleaned texts of a page's likely places, and of its body; null is empty."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [Tree(x or "").texts() for x in s]
            yield pd.DataFrame({"nodes": [r[0] for r in rows], "body": [r[1] for r in rows]})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "nodes array<string>, body string")(page)


def description(texts: Column) -> Column:
    """Of node_texts: the longest text that looks like a description (the first of equals), else
    the body's if it does, else ''."""
    good = F.filter(texts["nodes"], extract.looks_like_description)
    longest = F.aggregate(good, F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a))
    return F.when(F.size(good) > 0, longest).when(extract.looks_like_description(texts["body"]), texts["body"]).otherwise(F.lit(""))


def _braces(source: str) -> str | None:
    """The braces behind `initialState:`, balanced; None if there are none that balance."""
    m = re.search(r"initialState:\s*(\{)", source)
    depth = 0
    for b in re.finditer(r"[{}]", source[m.start(1) :]) if m else ():
        depth += 1 if b[0] == "{" else -1
        if not depth:
            return source[m.start(1) : m.start(1) + b.end()]
    return None


def initial_state(page: Column) -> Column:
    """The JSON that a board embeds in its pages; null without any."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([_braces(x or "") for x in s], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(page)


_SCRIPT = re.compile(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>""")


def _posting(value: object) -> dict | None:
    """The first JobPosting of a value, its list or its @graph, however deep."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo += reversed(v)
        elif isinstance(v, dict):
            kinds = v.get("@type")
            if "JobPosting" in (kinds if isinstance(kinds, list) else [kinds]):
                return v
            if isinstance(v.get("@graph"), list):
                todo += reversed(v["@graph"])
    return None


def job_posting(page: Column) -> Column:
    """The first JobPosting in a page's ld+json scripts, as JSON; null without one. Scripts that do not parse are passed over."""

    def one(source: str) -> str | None:
        for m in _SCRIPT.finditer(source):
            try:
                found = _posting(json.loads(entities.unescape(m[1]).strip()))
            except (json.JSONDecodeError, RecursionError):
                continue
            if found is not None:
                return json.dumps(found, ensure_ascii=False)
        return None

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([one(x or "") for x in s], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(page)


def _field(posting: Column, path: str) -> Column:
    return text.blank_to_null(F.get_json_object(posting, path))


def posting_id(posting: Column) -> Column:
    """identifier.value, else identifier where that is a text."""
    plain = _field(posting, "$.identifier")
    return F.coalesce(_field(posting, "$.identifier.value"), F.when(~plain.startswith("{") & ~plain.startswith("["), plain))


def posting_company(posting: Column) -> Column:
    return _field(posting, "$.hiringOrganization.name")


def posting_places(posting: Column) -> Column:
    """Distinct places in order, joined by bars: locality, region and country, or the name of the place."""
    raw = F.get_json_object(posting, "$.jobLocation")
    place = "struct<name:string,address:struct<addressLocality:string,addressRegion:string,addressCountry:string>>"
    listed = F.when(raw.startswith("["), F.from_json(raw, f"array<{place}>")).otherwise(F.array(F.from_json(raw, place)))
    parts = lambda a: F.concat_ws(", ", *[text.blank_to_null(a[f"address{k}"]) for k in ("Locality", "Region", "Country")])
    names = F.transform(F.filter(listed, lambda p: p.isNotNull()), lambda p: F.when(p["address"].isNotNull(), parts(p["address"])).otherwise(text.trimmed(p["name"])))
    return F.nullif(F.array_join(F.array_distinct(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != "")), " | "), F.lit(""))
