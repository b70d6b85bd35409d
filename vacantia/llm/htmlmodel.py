"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element, and every inline element with a class, id or role, is a node
with two states: part of the article or not. Unary potentials come from a
logistic model of tag, attributes, text and links; parent-child potentials from
how often the states go together, by kind of parent. Sum-product messages go once
up and once down the tree, which gives exact marginals; text of nodes whose
marginal is above one half is kept. Both potentials are trained on labelled pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import tune_arrow

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text without tags, up to their closing tag. Without one, a script or style goes on to the end; others are read as usual.
RAW = frozenset("script style iframe xmp noembed noframes textarea title".split())
#: Parsed, but nothing inside is text of the page: drawings, choices of a form, what is shown without scripts, templates.
UNSEEN = frozenset("svg select datalist noscript template".split())
#: Nodes below this depth are made siblings, as browsers do; and after so many tags whose quotes never close, quotes no longer count.
MOST_DEPTH, MOST_OPEN = 512, 16
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html head caption tbody td tfoot th thead tr legend li dd dt summary".split()) | {"li", "dd", "dt"}
#: An opening tag closes an open tag of these, looking no further up than the stops.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead"}, {"table"}), "body": ({"head"}, set())}

WORDS = {
    "menu": "nav|navbar|navigation|menu|breadcrumbs?|toc|pagination|pager|tabs?|skip",
    "head": "header|masthead|banner|topbar|logo|brand|top",
    "foot": "footer|copyright|legal|bottom|colophon|imprint",
    "side": "sidebar|aside|side|widget|rail|secondary|complementary",
    "advert": "ads?|adverts?|advertisement|advertising|sponsor|sponsored|promo|promotion|promoted|dfp|adsense|adslot|adbox|banner|teaser|outbrain|taboola",
    "notice": "cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|paywall|warning|message|toast|dialog",
    "comment": "comments?|respond|reply|replies|discussion|disqus|reactions?|feedback|responses?",
    "share": "share|sharing|social|follow|tweet|like|likes",
    "more": "related|recommended|recommendations|more|popular|trending|latest|readmore|next|prev|previous|tags?|categories",
    "byline": "meta|byline|author|date|published|timestamp|info",
    "form": "form|search|input|button|btn|field|contact",
    "article": "article|content|main|post|entry|story|body|text|maincontent|articlebody|prose|blog",
    "hidden": "hidden|hide|invisible|sronly|offscreen",
}
KEYWORD = {k: re.compile(rf"(?:^|[\s_\-])(?:{v})(?=$|[\s_\-])") for k, v in WORDS.items()}
TAGS = "html head body nav header footer aside main article section div p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 table tr td th tbody thead form fieldset label button figure figcaption blockquote pre details summary dialog menu address a span b i em strong small other raw".split()
TEXT = ["no text", "short", "medium", "long", "very long", "no link", "few links", "many links", "all links", "ends a sentence", "only child text", "has copyright", "deep", "opens comments", "in main", "beside main"]
NAMES = [*(f"tag {t}" for t in TAGS), *(f"word {k}" for k in WORDS), *(f"role {k}" for k in ("menu", "head", "foot", "side", "search", "main", "dialog", "other")), *TEXT, "bias"]
AT = {n: i for i, n in enumerate(NAMES)}
ROLES = {"navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "head", "contentinfo": "foot", "complementary": "side", "search": "search", "form": "search", "main": "main", "article": "main", "dialog": "dialog", "alert": "dialog", "alertdialog": "dialog"}
#: A short text that announces readers' comments, in the languages of the pages.
OPENS_COMMENTS = re.compile(r"\W*\d*\W*(?:\w+ )?(?:comments?|responses?|replies|kommentare?|commentaires?|comentarios?)\b.{0,20}$|\W*(?:leave|post|write) a (?:comment|reply)\W*$", re.I)
#: Never an article: these tags, and what has these names or roles, with all that stands inside them.
AROUND = frozenset("nav header footer aside form fieldset dialog button label menu".split())
NAMED_AROUND = frozenset("menu head foot side advert notice comment share more form hidden".split())
#: Kinds of parent: page frames, generic containers, article containers, others.
KINDS = {"html": 0, "body": 0, "div": 1, "section": 1, "main": 1, "td": 1, "table": 1, "tbody": 1, "tr": 1, "center": 1, "article": 2}


@lru_cache(50_000)
def _attributes(tag: str, raw: str) -> tuple[tuple[int, ...], bool]:
    """Features of a tag and its attributes, and whether it has a class, id or role."""
    found = [AT[f"tag {tag}"] if tag in TAGS else AT["tag other"]]
    marked = False
    if raw and not raw.isspace():
        a = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}
        own = f"{a.get('class', '')} {a.get('id', '')} {a.get('itemprop', '')} {a.get('data-role', '')} {a.get('aria-label', '')}"
        own = re.sub(r"([a-z])([A-Z])", r"\1-\2", own).lower()
        found += [AT[f"word {k}"] for k, r in KEYWORD.items() if r.search(own)]
        if role := a.get("role", "").lower():
            found.append(AT[f"role {ROLES.get(role, 'other')}"])
        style = a.get("style", "").replace(" ", "").lower()
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
            found.append(AT["word hidden"])
        marked = len(found) > 1 or bool(a.get("class") or a.get("id"))
    return tuple(sorted(set(found))), marked


class Tags:
    """Text and tags of a source in one pass.

    A tag ends at the first > outside quotes, or at the first > at all if its quotes
    never close. What looks like a tag but has no > behind it is text."""

    def __init__(self, source: str) -> None:
        self.source, self.open = source, 0

    def _end(self, at: int) -> int:
        """Where the tag that goes on at `at` has its >, or -1."""
        source = self.source
        plain = source.find(">", at)
        if plain < 0 or self.open > MOST_OPEN:
            return plain
        while True:
            m = STOP.search(source, at)
            if m is None:
                self.open += 1
                return plain
            if m[0] == ">":
                return m.start()
            at = source.find(m[0], m.end()) + 1
            if not at:
                self.open += 1
                return plain

    def __iter__(self) -> Iterator[tuple[str, str, str, int]]:
        """(kind, name, rest, end): kind is 'text', 'open' or 'close'; the reader may set `at` to go on elsewhere."""
        source = self.source
        size, self.at, begin = len(source), 0, 0
        ended = False  # no > follows
        while True:
            lt = source.find("<", self.at) if not ended else -1
            if lt < 0:
                if begin < size:
                    yield "text", "", source[begin:], size
                return
            kind, name, rest, end = "", "", "", -1
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4) + 3
                end = size if end < 3 else end
            elif source.startswith("<![CDATA[", lt):
                end = source.find("]]>", lt + 9) + 3
                end = size if end < 3 else end
            elif source[lt + 1 : lt + 2] in ("!", "?"):
                end = source.find(">", lt + 2) + 1
                ended = not end
            else:
                kind = "close" if source[lt + 1 : lt + 2] == "/" else "open"
                m = NAME.match(source, lt + 1 + (kind == "close"))
                if m is None:
                    self.at = lt + 1
                    continue
                gt = self._end(m.end())
                name, rest, end = m[0].lower(), source[m.end() : gt], gt + 1
                ended = gt < 0
            if ended:
                continue
            if lt > begin:
                yield "text", "", source[begin:lt], lt
            begin = self.at = end
            if kind:
                yield kind, name, rest, end
                begin = self.at


class _Open:
    """The open elements: tag and node of each, and where each tag stands, so that no search walks down them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = [("html", 0)]
        self.places: dict[str, list[int]] = {"html": [0]}

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost of these tags, 0 if there is none but the root."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, node))

    def cut(self, k: int) -> list[str]:
        """Close all from place k on; the tags closed."""
        gone = [t for t, _ in self.stack[k:] if t]
        del self.stack[k:]
        for t in set(gone):
            places = self.places[t]
            while places and places[-1] >= k:
                places.pop()
        return gone

    def lift(self, k: int) -> None:
        """Close place k alone; what is inside it stays open."""
        self.places[self.stack[k][0]].remove(k)
        self.stack[k] = ("", self.stack[k][1])
        while not self.stack[-1][0]:
            self.stack.pop()


class Page:
    """The nodes of a page, and its text as (node, block number, text) in page order."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.attributes, self.depth = [-1], ["html"], [_attributes("html", "")[0]], [0]
        self.text: list[tuple[int, int, str, bool]] = []
        opened = _Open()
        stack = opened.stack  # tag and its node (an inline tag shares its parent's)
        block, links, unseen = 0, 0, 0
        unclosed: set[str] = set()
        low = ""

        def close(k: int) -> None:
            nonlocal block, links, unseen
            for t in opened.cut(k):
                block += t in BLOCK
                links -= t == "a"
                unseen -= t in UNSEEN

        tags = Tags(source)
        for kind, tag, raw, end in tags:
            if kind == "text":
                if not unseen:
                    self.text.append((stack[-1][1], block, html.unescape(raw), links > 0))
                continue
            if kind == "close":
                k = opened.last((tag,))
                bar = 0 if tag in ("table", "tr", "tbody", "body", "html") else opened.last(("table", "td", "th"))
                if k and (k >= bar or tag in ("table", "td", "th")):
                    close(k)
                continue
            if tag == "br":
                if not unseen:
                    self.text.append((stack[-1][1], block, " ", links > 0))
                continue
            if tag in VOID:
                block += tag == "hr"
                continue
            if tag in RAW and tag not in unclosed:
                if not low:
                    low = source.lower()
                    if len(low) != len(source):  # a letter whose lower case is longer
                        low = "".join(c.lower() if c < "\x80" else c for c in source)
                shut = low.find(f"</{tag}", end)
                if shut >= 0:
                    tags.at = source.find(">", shut) + 1 or len(source)
                    continue
                unclosed.add(tag)
                if tag in ("script", "style"):
                    tags.at = len(source)
                    continue
            if raw.endswith("/") and tag in UNSEEN:
                continue
            if tag in ("html", "body") and opened.places.get(tag):
                continue
            if unseen and tag in CLOSES_P and (k := opened.last(("select",))) and k > opened.last(("svg", "noscript", "template")):
                close(k)
            if tag in CLOSES_P and (k := opened.last(("p",))) > opened.last(("td", "th", "table", "button", "caption")):
                close(k)
            if tag in IMPLIED:
                ends, stops = IMPLIED[tag]
                if (k := opened.last(ends)) > opened.last(stops - ends):
                    close(k)
            if tag == "a" and links:  # links do not nest
                links -= 1
                opened.lift(opened.last(("a",)))
            found, marked = _attributes(tag, raw) if len(raw) < 4096 else _attributes.__wrapped__(tag, raw)
            node = stack[-1][1]
            if not unseen and (tag in BLOCK or marked or tag in ("button", "label")):
                if self.depth[node] == MOST_DEPTH:
                    node = self.parent[node]
                self.parent.append(node)
                self.tag.append(tag)
                self.attributes.append(found)
                self.depth.append(self.depth[node] + 1)
                node = len(self.parent) - 1
            block += tag in BLOCK
            links += tag == "a"
            unseen += tag in UNSEEN
            opened.push(tag, node)

    def features(self, weights: np.ndarray | None = None) -> np.ndarray:
        """The features of the nodes, or, given weights, their sums: made for a stretch of nodes at a time."""
        n = len(self.parent)
        own, linked = np.zeros(n, np.int64), np.zeros(n, np.int64)
        last = [""] * n
        for node, _, t, link in self.text:
            k = len(t.strip())
            own[node] += k
            if link:
                linked[node] += k
            if k:
                last[node] = t
        whole, wlinks = own.copy(), linked.copy()
        for at in reversed(by_depth(np.array(self.depth))[1:]):
            up = self._parents()[at]
            np.add.at(whole, up, whole[at])
            np.add.at(wlinks, up, wlinks[at])
        share = wlinks / np.maximum(whole, 1)
        columns = {"no text": whole == 0, "only child text": (own == 0) & (whole > 0), "deep": np.array(self.depth) > 8}
        for name, low, high in (("short", 1, 25), ("medium", 25, 100), ("long", 100, 400), ("very long", 400, 1 << 60)):
            columns[name] = (whole >= low) & (whole < high)
        for name, low, high in (("no link", -1, 0), ("few links", 0, 0.2), ("many links", 0.2, 0.8), ("all links", 0.8, 1)):
            columns[name] = (whole > 0) & (share > low) & (share <= high)
        columns["ends a sentence"] = np.array([bool(t) and t.rstrip()[-1:] in (".", "!", "?", "…", ":") for t in last])
        columns["opens comments"] = self.comments()
        inside = np.array([t in ("article", "main") for t in self.tag])
        whole_of = bool((inside & (whole > 0)).any())
        for at in by_depth(np.array(self.depth))[1:]:
            inside[at] |= inside[self._parents()[at]]
        above = inside & (whole > 0)
        for at in reversed(by_depth(np.array(self.depth))[1:]):
            np.logical_or.at(above, self._parents()[at], above[at])
        columns["in main"], columns["beside main"] = inside, ~inside & ~above & whole_of
        columns["has copyright"] = np.array(["©" in t for t in last])
        out = []
        for i in range(0, n, 1 << 15):
            marks = self.attributes[i : i + (1 << 15)]
            x = np.zeros((len(marks), len(NAMES)), np.float32)
            x[np.repeat(np.arange(len(marks)), [len(m) for m in marks]), np.fromiter(chain.from_iterable(marks), np.int64)] = 1
            for name, v in columns.items():
                x[:, AT[name]] = v[i : i + (1 << 15)]
            x[:, AT["bias"]] = 1
            out.append(x if weights is None else x @ weights)
        return np.concatenate(out)

    def _parents(self) -> np.ndarray:
        if not hasattr(self, "_up"):
            self._up = np.array(self.parent)
        return self._up

    def comments(self) -> np.ndarray:
        """Nodes that a heading of comments stands in, and the container that it opens."""
        n = len(self.parent)
        first, opens = np.full(n, len(self.text)), np.zeros(n, bool)
        for i, (node, _, t, _) in enumerate(self.text):
            if k := len(t.strip()):
                first[node] = min(first[node], i)
                opens[node] |= k <= 40 and OPENS_COMMENTS.match(t.strip()) is not None
        if opens.any():
            for at in reversed(by_depth(np.array(self.depth))[1:]):
                np.minimum.at(first, self._parents()[at], first[at])
            for node in np.flatnonzero(opens):
                up = self.parent[node]
                if up >= 0 and first[node] == first[up] and self.tag[up] not in ("html", "body", "article", "main"):
                    opens[up] = True
        return opens

    def outside(self) -> np.ndarray:
        """Nodes in no part that is known to stand around articles; of those, the ones in an article or main element
        with text, if there are any. What a page has left when the model keeps nothing."""
        n = len(self.parent)
        around, inside = np.zeros(n, bool), np.zeros(n, bool)
        named = {AT[f"word {k}"] for k in NAMED_AROUND} | {AT[f"role {k}"] for k in ("menu", "head", "foot", "side", "search", "dialog")}
        says = self.comments()
        for i in range(n):
            up = self.parent[i]
            around[i] = up >= 0 and around[up] or self.tag[i] in AROUND or i > 0 and bool(named & set(self.attributes[i])) or i > 0 and bool(says[i])
            inside[i] = up >= 0 and inside[up] or self.tag[i] in ("article", "main")
        own = np.zeros(n, bool)
        own[[node for node, _, t, _ in self.text if t.strip()]] = True
        return ~around & inside if (own & ~around & inside).any() else ~around

    def extract(self, keep: np.ndarray) -> str:
        """The text of kept nodes: white space is one space, blocks are two newlines apart."""
        out, parts, now = [], [], -1
        for node, block, t, _ in self.text:
            if not keep[node]:
                continue
            if block != now and parts:
                out.append(" ".join("".join(parts).split()))
                parts = []
            now = block
            parts.append(t)
        if parts:
            out.append(" ".join("".join(parts).split()))
        return "\n\n".join(x for x in out if x)


def messages(unary: np.ndarray, pair: np.ndarray, parent: np.ndarray, levels: list[np.ndarray], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum-product messages up and then down a forest, all nodes of one depth together.

    unary: nodes x 2 log potentials. pair: kinds x 2 (parent) x 2 (child) log
    potentials. parent: -1 for roots. levels: the nodes of each depth. Gives the log
    beliefs, those from below alone, and the messages up."""
    belief = unary.copy()
    up = np.zeros_like(belief)
    for at in reversed(levels[1:]):
        inner = pair[kind[parent[at]]] + belief[at][:, None, :]
        up[at] = np.logaddexp(inner[:, :, 0], inner[:, :, 1])
        up[at] -= up[at].max(axis=1, keepdims=True)
        np.add.at(belief, parent[at], up[at])
    below = belief.copy()
    for at in levels[1:]:
        rest = belief[parent[at]] - up[at]
        inner = pair[kind[parent[at]]] + rest[:, :, None]
        down = np.logaddexp(inner[:, 0, :], inner[:, 1, :])
        belief[at] += down - down.max(axis=1, keepdims=True)
    return belief, below, up


def by_depth(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(depth) else []


def marginals(unary: np.ndarray, pair: np.ndarray, parent: np.ndarray, depth: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """P(article) of each node of a forest."""
    belief, _, _ = messages(unary.astype(np.float64), pair, parent, by_depth(depth), kind)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))


def kinds(page: Page) -> np.ndarray:
    return np.array([KINDS.get(t, 3) for t in page.tag])


class Model:
    """Weights of the unary model and the parent-child potentials."""

    def __init__(self, weights: np.ndarray, pair: np.ndarray) -> None:
        self.weights, self.pair = weights, pair

    @classmethod
    def fit(cls, pages: list[tuple[Page, np.ndarray]], steps: int = 100, rate: float = 0.15, ridge: float = 1e-4) -> Model:
        """Fit to pages with a 0/1 label per node (1: article, or holds some of it).

        Unary and pair weights are trained together: the gradient of the pages'
        conditional likelihood is what the labels have less what the marginals
        expect, and messages give those exactly. Adam steps from zero."""
        parent, depth, kind = cls._forest([p for p, _ in pages])
        x = np.concatenate([p.features() for p, _ in pages]).astype(np.float64)
        y = np.concatenate([np.asarray(label, int) for _, label in pages])
        levels, child = by_depth(depth), np.flatnonzero(parent >= 0)
        up_kind = kind[parent[child]]
        theta = np.zeros(x.shape[1] + 16)
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        have = np.zeros((4, 2, 2))
        np.add.at(have, (up_kind, y[parent[child]], y[child]), 1)
        for step in range(1, steps + 1):
            odds, pair = x @ theta[:-16], theta[-16:].reshape(4, 2, 2)
            belief, below, up = messages(np.stack([np.zeros_like(odds), odds], axis=1), pair, parent, levels, kind)
            p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))
            joint = pair[up_kind] + (belief[parent[child]] - up[child])[:, :, None] + below[child][:, None, :]
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            want = np.zeros((4, 2, 2))
            np.add.at(want, up_kind, joint)
            g = np.concatenate([x.T @ (p - y), (want - have).ravel()]) / len(pages) + ridge * theta
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            theta -= rate * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        return cls(theta[:-16], theta[-16:].reshape(4, 2, 2))

    @staticmethod
    def _forest(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parents, depths and kinds of the nodes of all pages, one after another."""
        start = np.concatenate([[0], np.cumsum([len(p.parent) for p in pages])])
        parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + s) for p, s in zip(pages, start, strict=False)])
        return parent, np.concatenate([p.depth for p in pages]), np.concatenate([kinds(p) for p in pages])

    def keep(self, pages: list[Page]) -> list[np.ndarray]:
        """Which nodes of each page belong to the article."""
        if not pages:
            return []
        parent, depth, kind = self._forest(pages)
        odds = np.concatenate([p.features(self.weights) for p in pages])
        m = marginals(np.stack([np.zeros_like(odds), odds], axis=1), self.pair, parent, depth, kind)
        edge = np.concatenate([[0], np.cumsum([len(p.parent) for p in pages])])
        return [m[a:b] > 0.5 for a, b in zip(edge, edge[1:], strict=False)]


def _runs(source: pa.Array, most: int = 200, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first, count) of runs of at most `most` pages and about `size` bytes; a longer page is a run of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(source), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(source):
        before = upto[at - 1] if at else 0
        n = min(most, max(1, int(np.searchsorted(upto, before + size, "right")) - at))
        yield at, n
        at += n


def extract(sources: list[str | None], model: Model) -> list[str]:
    pages = [Page(s or "") for s in sources]
    return [p.extract(k) or p.extract(p.outside()) for p, k in zip(pages, model.keep(pages), strict=True)]


def main_text(pages: DataFrame, model: Model, html_column: str = "html", name: str = "text") -> DataFrame:
    """pages with its html column replaced by the article's text ('' if there is none).

    A null or empty html gives ''. Where the model keeps nothing, all text that stands in no menu,
    header, footer or other known part is the article, so that a short or bare page is not lost. Unclosed and stray tags are mended as browsers do;
    equal html gives equal text; other columns pass through; an empty table stays empty."""
    others = [c for c in pages.columns if c != html_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source = b.column(b.schema.get_field_index(html_column))
            for i, n in _runs(source):
                part = b.slice(i, n)
                texts = extract(source[i : i + n].to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in others), pa.array(texts, pa.string())], names=[*others, name])

    if name in others:
        raise ValueError(f"there is a column {name} already; give another name")
    tune_arrow(pages.sparkSession)
    fields = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.mapInArrow(run, ", ".join([*(f"`{c}` {fields[c]}" for c in others), f"`{name}` string"]))
