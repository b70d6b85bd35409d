"""Labelled pages to train the DOM model on: made from a fixed seed, so every run trains alike.

Pages mix page frames, menus, headers, footers, sidebars, adverts, notices, forms,
comments and articles in many spellings, with and without telling attributes.
Words are random letters: the model cannot learn from what a page says.
"""

from __future__ import annotations

import random

import numpy as np

from .htmlmodel import Model, Page

#: Article words begin with a mark that no feature sees.
MARK = "Ж"


class _Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, low: int, high: int, mark: str = "") -> str:
        return " ".join(mark + "".join(self.r.choices("abcdefghiklmnorstuw", k=self.r.randint(2, 9))) for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int, mark: str = "") -> str:
        return " ".join(self.words(4, 18, mark).capitalize() + self.r.choice(".....?!") for _ in range(self.r.randint(low, high)))

    def one(self, *made: str) -> str:
        return self.r.choice(made)

    def named(self, tags: str, names: str, inner: str, plain: float = 0.0) -> str:
        """An element with one of the names as its class or id, or (at times) without any."""
        tag = self.r.choice(tags.split())
        if self.r.random() < plain:
            return f"<{tag}>{inner}</{tag}>"
        name = self.r.choice(names.split())
        if self.r.random() < 0.2:
            name = self.one(f"{name}-{self.words(1, 1)}", f"{self.words(1, 1)}-{name}", f"{name} {self.words(1, 1)}")
        return f'<{tag} {self.one("class", "class", "id")}="{name}">{inner}</{tag}>'

    def links(self, low: int = 3, high: int = 9) -> str:
        a = [f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(low, high))]
        return self.one("<ul>" + "".join(f"<li>{x}</li>" for x in a) + "</ul>", "<ul>" + "".join(f"<li>{x}" for x in a) + "</ul>", " | ".join(a), " ".join(a))

    def menu(self) -> str:
        return self.one(f"<nav>{self.links()}</nav>", f'<nav class="{self.words(1, 1)}">{self.links()}</nav>', self.named("div ul", "menu nav navbar navigation main-menu breadcrumb topnav", self.links()), f'<div role="navigation">{self.links()}</div>', f"<div>{self.links(4, 9)}</div>")

    def header(self) -> str:
        inner = self.one(f"<p>{self.words(1, 6)}</p>", f"<h1>{self.words(1, 3)}</h1><p>{self.words(2, 9)}</p>", f'<div class="logo"><a href="/">{self.words(1, 2)}</a></div>', f'<a href="/">{self.words(1, 2)}</a>{self.menu()}', self.words(1, 5), f"<h2>{self.words(1, 3)}</h2>{self.links()}", f"<p>{self.sentences(1, 2)}</p>")
        return self.one(f"<header>{inner}</header>", f"<header>{inner}</header>", self.named("div header", "header site-header masthead page-header topbar banner", inner), f'<div role="banner">{inner}</div>')

    def footer(self) -> str:
        inner = self.one(f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 1)}", f"<p>{self.sentences(1, 2)}</p>{self.links()}", f"<p>&copy; 2024 {self.words(1, 4)}</p>", self.words(2, 9), f"<p>{self.sentences(2, 4)}</p><p>{self.sentences(1, 2)}</p>")
        return self.one(f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", self.named("div footer", "footer site-footer page-footer bottom copyright", inner), f'<div role="contentinfo">{inner}</div>', f'<p class="copyright">&copy; {self.words(2, 5)}</p>')

    def side(self) -> str:
        inner = self.one(f"<h3>{self.words(1, 3)}</h3>{self.links()}", f"<p>{self.sentences(1, 3)}</p>", f'<div class="widget"><h4>{self.words(1, 2)}</h4><p>{self.sentences(1, 2)}</p></div>', f"<h2>{self.words(1, 3)}</h2><p>{self.sentences(1, 4)}</p><p>{self.sentences(1, 2)}</p>", self.sentences(1, 2))
        return self.one(f"<aside>{inner}</aside>", f"<aside>{inner}</aside>", self.named("div aside section", "sidebar side aside widget-area rail secondary right-rail", inner), f'<div role="complementary">{inner}</div>')

    def advert(self) -> str:
        inner = self.one(self.sentences(1, 2), self.words(1, 6), f"<p>{self.sentences(1, 3)}</p>", f'<a href="//x">{self.words(2, 6)}</a>', f'<h4>{self.words(1, 4)}</h4><p>{self.sentences(1, 2)}</p>')
        return self.named("div div div p section aside ins", "ad ads advert advertisement ad-slot ad-box sponsored sponsor promo promotion banner", inner)

    def notice(self) -> str:
        inner = self.one(f"<p>{self.sentences(1, 2)}</p><button>{self.words(1, 2)}</button>", self.sentences(1, 2), f"<p>{self.sentences(1, 3)}</p>", f"<h3>{self.words(2, 4)}</h3><p>{self.sentences(1, 2)}</p><form><input><button>{self.words(1, 1)}</button></form>")
        return self.one(self.named("div div section p aside", "cookie cookie-notice cookies consent gdpr notice alert popup modal newsletter subscribe paywall signup", inner), f'<div role="{self.one("alert", "dialog")}">{inner}</div>', f"<dialog>{inner}</dialog>", f'<div style="display:none">{inner}</div>')

    def form(self) -> str:
        inner = f"<label>{self.words(1, 4)}</label><input name=q><select><option>{self.words(1, 1)}</select><textarea>{self.words(1, 4)}</textarea><button>{self.words(1, 2)}</button>"
        return self.one(f"<form>{inner}</form>", f"<form><p>{self.sentences(1, 1)}</p>{inner}</form>", f'<form class="search">{inner}</form>', f"<form><fieldset><legend>{self.words(1, 2)}</legend>{inner}</fieldset></form>", f'<div class="search"><form>{inner}</form></div>')

    def comments(self) -> str:
        one = lambda: self.one(f"<p>{self.sentences(1, 4)}</p>", f"<b>{self.words(1, 2)}</b><p>{self.sentences(1, 3)}</p>", f'<p>{self.words(1, 2)}</p><p>{self.sentences(1, 3)}</p><p>{self.sentences(1, 2)}</p>', self.sentences(1, 3))
        n = range(self.r.randint(1, 5))
        inner = self.one("".join(f'<div class="comment">{one()}</div>' for _ in n), "<ul>" + "".join(f"<li>{one()}</li>" for _ in n) + "</ul>", "".join(f'<article class="comment">{one()}</article>' for _ in n), "<ol>" + "".join(f'<li class="comment">{one()}</li>' for _ in n) + "</ol>", "".join(f"<div>{one()}</div>" for _ in n), "".join(f"<p>{self.sentences(1, 3)}</p>" for _ in n), "".join(f"<article>{one()}</article>" for _ in n))
        if self.r.random() < 0.25:  # told by their heading alone
            said = f"{self.one('', f'{self.r.randint(1, 40)} ')}{self.one('Comments', 'comments', 'Responses', 'Replies', 'Kommentare', 'Commentaires', 'Comentarios', 'Leave a reply', 'Reader comments')}"
            return self.named("div section div", "cmt c-list u2 thread box", f"<h{(h := self.one('2', '3', '4'))}>{said}</h{h}>{inner}", plain=0.3)
        return self.named("div section section aside", "comments comment-list comment-section discussion disqus_thread replies respond reader-comments", self.one("", f"<h2>{self.words(1, 3)}</h2>", f"<h3>{self.words(1, 3)}</h3>") + inner + self.one("", "", self.form()))

    def more(self) -> str:
        return self.one(self.named("div section aside", "related related-posts recommended more popular trending share social tags", f"<h3>{self.words(1, 3)}</h3>{self.links()}"), self.named("div ul", "share social sharing", self.links()))

    def item(self) -> str:
        m = MARK
        p = lambda: self.sentences(1, 7, m)
        marked = lambda: self.one(p(), p(), f"<b>{p()}</b>", f'{p()} <a href="/x">{self.words(1, 4, m)}</a> {p()}', f"<em>{self.words(1, 4, m)}</em> {p()}<br>{p()}", f"<b>{self.words(2, 9, m)}<br>", f"<span>{p()}</span>", f"{self.words(1, 3, m)}.")
        k = self.r.random()
        if k < 0.62:
            return self.one(f"<p>{marked()}</p>", f"<p>{marked()}</p>", f"<p>{marked()}")
        if k < 0.72:
            return f"<h{(h := self.one('2', '3', '4'))}>{self.words(1, 8, m)}</h{h}>"
        if k < 0.80:
            tag = self.one("ul", "ol")
            return f"<{tag}>" + "".join(f"<li>{self.one(p(), self.words(1, 6, m))}" + self.one("", "</li>") for _ in range(self.r.randint(1, 6))) + f"</{tag}>"
        if k < 0.84:
            return f"<blockquote>{self.one(f'<p>{p()}</p>', p())}</blockquote>"
        if k < 0.88:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 4, m)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(1, 4))) + "</table>"
        if k < 0.91:
            return f"<figure><img src=x><figcaption>{self.words(2, 9, m)}</figcaption></figure>"
        if k < 0.94:
            return f"<pre>{p()}</pre>"
        if k < 0.97:
            return f"<div>{p()}</div>"
        return f"<dl><dt>{self.words(1, 3, m)}</dt><dd>{p()}</dd></dl>"

    def short(self) -> str:
        """An article of a few words or lines, without a heading."""
        m = MARK
        some = lambda: self.one(self.words(1, 60, m), self.words(1, 12, m), self.sentences(1, 2, m), self.sentences(1, 4, m))
        return self.one(f"<p>{some()}</p>", f"<p>{some()}</p>", f"<p>{some()}<br>{some()}</p>", some(), f"<p>{some()}</p><p>{some()}</p>", f"<p>{some()}<br>{some()}<br>{some()}</p><p>{some()}</p>", f"{some()}<br>{some()}", f"<div>{some()}</div>")

    def article(self) -> str:
        title = f"<h1>{self.words(1, 10, MARK)}{self.one('', '.')}</h1>"
        parts = [self.one(title, title, title, f"<header>{title}</header>", "")] + [self.item() for _ in range(self.r.randint(1, 9))]
        for _ in range(self.r.choice([0, 0, 0, 1, 1, 2])):
            parts.insert(self.r.randint(1, len(parts)), self.one(self.advert(), self.notice(), self.form(), self.comments(), self.more(), f"<aside>{self.sentences(1, 2)}</aside>", self.menu(), f"<footer>{self.words(2, 9)}</footer>"))
        inner = self.short() if self.r.random() < 0.3 else "".join(parts)
        return self.one(f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", self.named("div section article", "article content main post entry entry-content story article-body post-content text", inner), self.named("div", "content main", f"<article>{inner}</article>"), f"<div>{inner}</div>", f"<section>{inner}</section>", inner)

    def page(self) -> str:
        if self.r.random() < 0.06:
            return self.one(self.short(), f"<html><body>{self.short()}</body></html>")  # nothing else at all
        around = [self.menu, self.header, self.advert, self.notice, self.form, self.side, self.more]
        before = [self.one(*[""], f())[:] if self.r.random() < 0.1 else f() for f in self.r.sample(around, self.r.randint(0, 4))]
        after = [f() for f in self.r.sample([self.footer, self.comments, self.side, self.advert, self.more, self.notice, self.form], self.r.randint(0, 4))]
        has = self.r.random() < 0.94
        body = "".join(before) + (self.article() if has else "") + "".join(after) + self.one("", self.footer())
        if self.r.random() < 0.35:
            body = self.named("div", "container wrapper page wrap site layout main-wrapper content-wrapper", body, plain=0.4)
        head = f"<head><title>{self.words(1, 8)}</title><style>p{{}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{self.one(head, head, '')}<body>{body}" + self.one("</body></html>", "</body></html>", "")


def labels(page: Page) -> np.ndarray:
    """1 for every node that holds marked words, itself or below."""
    y = np.zeros(len(page.parent), int)
    for node, _, t, _ in page.text:
        if MARK.lower() in t.lower():
            y[node] = 1
    for i in range(len(y) - 1, 0, -1):
        y[page.parent[i]] |= y[i]
    return y


def labelled(n: int, seed: int) -> list[tuple[str, Page, np.ndarray]]:
    maker, out = _Maker(seed), []
    for _ in range(n):
        source = maker.page()
        page = Page(source)
        out.append((source, page, labels(page)))
    return out


def trained(pages: int = 400, seed: int = 11) -> Model:
    """The model, trained on so many labelled pages."""
    return Model.fit([(p, y) for _, p, y in labelled(pages, seed)])
