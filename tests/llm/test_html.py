import itertools

import numpy as np
import pytest

from vacantia.llm import htmlmodel, labelled_pages


@pytest.fixture(scope="module")
def model():
    return labelled_pages.trained()


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    parent = np.array([-1, 0, 0, 1, 1, 2, -1, 6])
    depth = np.array([0, 1, 1, 2, 2, 2, 0, 1])
    kind = rng.integers(0, 4, 8)
    unary, pair = rng.normal(size=(8, 2)), rng.normal(size=(4, 2, 2))
    p = np.zeros(8)
    z = 0.0
    for state in itertools.product((0, 1), repeat=8):
        e = sum(unary[k, s] for k, s in enumerate(state)) + sum(pair[kind[parent[k]], state[parent[k]], state[k]] for k in range(8) if parent[k] >= 0)
        z += np.exp(e)
        p += np.exp(e) * np.array(state)
    assert np.allclose(htmlmodel.marginals(unary, pair, parent, depth, kind), p / z)


def test_held_out_accuracy(model):
    pages = labelled_pages.labelled(200, seed=77)
    right = total = 0
    for (_, _, y), k in zip(pages, model.keep([p for _, p, _ in pages]), strict=True):
        right += (k == (y == 1)).sum()
        total += len(y)
    assert right / total > 0.96


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div>
<article><h1>Title &amp;amp; more</h1><p>First <b>para
graph</b><br>goes on&nbsp;here.<p>Second one, with a <a href=/x>link</a> in it.</p><div class="ad">Buy now.</div><ul><li>Item one is a full sentence.</li><li>Item two is a full sentence.</ul></article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>Nice text, I like it.</p></div></section><aside class="sidebar"><p>About the author.</p></aside><form><label>Name</label><input></form><footer>&copy; 2024</footer></body></html>"""


def test_page(model):
    got = htmlmodel.extract([PAGE], model)[0]
    assert got == "Title &amp; more\n\nFirst para graph goes on here.\n\nSecond one, with a link in it.\n\nItem one is a full sentence.\n\nItem two is a full sentence."


def test_odd_pages(spark, model):
    odd = [None, "", "   ", "<", "<p", "</p></p>", "<!-- never closed", "<script>never closed", "<p>" * 300 + "deep", "<div>" * 3000 + "x", "plain text, no tags at all. It is a sentence.", "<p a='\"'>q</p>", "x" * 200000]
    rows = [(k, "u", h, "extra") for k, h in enumerate([*odd, PAGE, PAGE])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    got = {r["page_id"]: r["text"] for r in htmlmodel.main_text(df, model).collect()}
    assert len(got) == len(rows) and got[0] == got[1] == got[2] == ""
    assert got[len(odd)] == got[len(odd) + 1]
    assert htmlmodel.main_text(df.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        htmlmodel.main_text(df.withColumnRenamed("n_chars", "text"), model)


def test_real_pages(spark, model):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()
    for (source,), got in zip(pages, htmlmodel.extract([p[0] for p in pages], model), strict=True):
        inner = re.sub("<br>", " ", re.search("<article>(.*?)</article>", source, re.S)[1])
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert got == "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<p>", "<a '", '<b "x>', "</x>", "<table><td>", "<a><b>", "<svg>", "<select>", "<textarea>", "<li><ul>", "<!", "<![CDATA[", "<a href='>\">", "<p a=\"<p b='"])
def test_hostile_pages_take_linear_time(model, piece):
    import time

    begin = time.perf_counter()
    htmlmodel.extract([piece * ((1 << 20) // len(piece))], model)
    assert time.perf_counter() - begin < 12  # about 2 s; the machine may be busy


def test_deep_stacks_and_stray_ends(model):
    import time

    begin = time.perf_counter()
    htmlmodel.extract(["<x><table><td>" + "<div>" * 50000 + "</x>" * 50000, "<div>" * 50000 + "t" + "</div>" * 50000], model)
    assert time.perf_counter() - begin < 12


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<article><p>One is a sentence.</p><select><option>a<p>Two is a sentence.", "One is a sentence.\n\nTwo is a sentence."),
        ("<article><p>One is a sentence.</p><select><option>a</select><p>Two is a sentence.", "One is a sentence.\n\nTwo is a sentence."),
        ("<article><p>One is a sentence.</p><object data=x><p>Fallback is a sentence.</p></object></article>", "One is a sentence.\n\nFallback is a sentence."),
        ("<article><p>For <math><mi>x</mi><mo>=</mo><mn>1</mn></math> it holds, they say.</p></article>", "For x=1 it holds, they say."),
        ("<article><p>One <svg><title>t</title><text>u</text></svg>is a sentence.<p>Two <textarea>is a sentence.", "One is a sentence.\n\nTwo is a sentence."),
        ("<article><p>One is < two, and 3 > 2, as <a title='a>b' href=\"c>d\">they</a> say.</p></article>", "One is < two, and 3 > 2, as they say."),
    ],
)
def test_nothing_else_is_lost(model, source, text):
    page = htmlmodel.Page(source)
    assert page.extract(np.ones(len(page.parent), bool)) == text
    assert htmlmodel.extract([source], model)[0] == text


def words(n, end=""):
    return " ".join(f"word{k}" for k in range(n)) + end


@pytest.mark.parametrize("end", ["", "."])
@pytest.mark.parametrize("n", [1, 3, 6, 10, 15, 20, 40, 60, 80])
def test_short_articles_stay_whole(model, n, end):
    """Articles without a heading, bare paragraphs and bare text of any length."""
    t = words(n, end)
    shapes = [
        f"<nav><a href=/>Home</a> <a href=/x>About</a></nav><article><p>{t}</p></article><footer>Some footer text</footer>",
        f"<header><h1>Site</h1></header><main><p>{t}</p></main><aside>Side words here.</aside>",
        f"<div role=dialog><p>We use cookies.</p><button>OK</button></div><article>{t}</article>",
        f"<p>{t}</p>",
        t,
    ]
    assert htmlmodel.extract(shapes, model) == [t] * len(shapes)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<article><p>Line one<br>line two</p><p>Another one stands here.</p></article>", "Line one line two\n\nAnother one stands here."),
        ("just plain text here", "just plain text here"),
        ('<div class="cookie-banner">We use cookies to improve. <button>OK</button></div><article>One sentence is here. And another one.</article>', "One sentence is here. And another one."),
        ("<article><blockquote>A short quote.</blockquote></article>", "A short quote."),
        ("<nav><a href=/>H</a></nav><article><ul><li>one</li><li>two</li></ul></article>", "one\n\ntwo"),
        ("<nav><a href=/>Home</a></nav><footer>&copy; 2024 Foo</footer>", ""),
        (f"<article><h1>Title of it</h1><p>{words(60, '.')}</p></article><div id=cmt><h3>12 Comments</h3><p>I like this text a lot, thanks.</p><p>Me too, great.</p></div>", f"Title of it\n\n{words(60, '.')}"),
        (f"<article><p>{words(30, '.')}</p></article><div><h2>Kommentare</h2><ul><li>Sehr schön gemacht, danke.</li></ul></div>", words(30, ".")),
        (f"<body class=home><div id=page><div id=masthead><p>Name</p></div><div id=primary><div class=entry><h1>A title</h1><p>{words(25, '.')}</p><p>{words(9, '.')}</p></div></div><div id=secondary><h3>Archive</h3><ul><li><a href=/1>May</a><li><a href=/2>June</a></ul></div><div id=colophon>Made by hand</div></div>", f"A title\n\n{words(25, '.')}\n\n{words(9, '.')}"),
        (f"<ul class=menu><li><a href=/a>A</a><li><a href=/b>B</a></ul><section><h2>Heading here</h2><p>{words(14, '.')}</p><table><tr><td>a cell</td><td>b cell</td></tr></table></section><div class=share><a href=/t>Tweet</a></div>", f"Heading here\n\n{words(14, '.')}\n\na cell\n\nb cell"),
    ],
)
def test_shapes_that_the_generator_does_not_make(model, source, text):
    assert htmlmodel.extract([source], model)[0] == text


def test_a_page_is_not_empty_where_the_model_keeps_nothing():
    """The tree decides then: what stands in no known part, inside the article if there is one."""
    nothing = htmlmodel.Model(np.r_[np.zeros(len(htmlmodel.NAMES) - 1), -50.0], np.zeros((4, 2, 2)))
    page = "<header>Site</header><div>Beside</div><article><p>One.</p><div class=ad>Buy</div><p>Two.</p></article><div><h3>3 Comments</h3></div><footer>Foot</footer>"
    assert htmlmodel.extract([page, "<nav>Menu</nav><p>Bare.</p>", "<nav>Menu</nav>"], nothing) == ["One.\n\nTwo.", "Bare.", ""]
