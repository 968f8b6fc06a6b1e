"""Generated pages with known main text, and the boosted trees trained on them.

No table tells which nodes of a page are its main text, so training pages are generated from a
seed: layouts of many kinds, with navigation, headers, footers, sidebars, notices, adverts, forms,
related links and reader comments around and inside the article. Each text run is marked.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

from waymark.llm.html_text import BoostedTrees, Tree, features, parse

PAGES = 1500
SEED = 20240517
_MAIN = "⁣"  # an invisible mark at each run of main text; taken out before training


class _Writer:
    def __init__(self, rng: random.Random) -> None:
        self.rng = rng

    def words(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice("bcdfglmnprstv") + r.choice("aeiouéäñ") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentence(self, low: int = 1, high: int = 18) -> str:
        return self.words(low, high).capitalize() + self.rng.choice([".", ".", ".", "!", "?", ","])

    def prose(self, main: bool, most: int = 6) -> str:
        mark = _MAIN if main else ""
        parts = [self.sentence() for _ in range(self.rng.randint(1, most))]
        if self.rng.random() < 0.2:
            k = self.rng.randrange(len(parts))
            parts[k] = f"{self.rng.choice(['<b>', '<i>', '<em>', '<a href=\"/x\">'])}{mark}{parts[k]}" + ("" if self.rng.random() < 0.2 else "</b></i></em></a>")
        return mark + " ".join(parts).replace(", ", f"{self.rng.choice([' ', ' &amp; ', '&nbsp;', ', '])}")

    def paragraph(self, main: bool) -> str:
        r, body = self.rng, self.prose(main)
        kind = r.random()
        if kind < 0.7:
            return f"<p>{body}</p>"
        if kind < 0.8:
            return f"<p><b>{body}<br>"
        if kind < 0.86:
            return f"<div>{body}</div>"
        if kind < 0.9:
            return f"<h3>{(_MAIN if main else '') + self.words(1, 8)}</h3>"
        if kind < 0.94:
            return f"<blockquote><p>{body}</p></blockquote>"
        tag = r.choice(["ul", "ol"])
        return f"<{tag}>" + "".join(f"<li>{(_MAIN if main else '') + self.sentence(1, 12)}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>"

    def links(self, low: int = 2, high: int = 9) -> str:
        r = self.rng
        items = [f'<a href="/{self.words(1, 1)}">{self.words(1, 4)}</a>' for _ in range(r.randint(low, high))]
        if r.random() < 0.75:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return r.choice([" | ", " ", "<br>", " &middot; "]).join(items)

    def named(self, tags: list[str], names: list[str], inner: str) -> str:
        r = self.rng
        tag, name = r.choice(tags), r.choice(names)
        attr = f' {r.choice(["class", "class", "id"])}="{name}"' if tag == "div" or r.random() < 0.5 else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def nav(self) -> str:
        return self.named(["nav", "nav", "div"], ["nav", "menu", "navbar", "main-menu", "breadcrumbs", "navigation"], self.links())

    def header(self) -> str:
        return self.named(["header", "div"], ["header", "masthead", "site-header", "top"], f"<div>{self.words(1, 4)}</div>" + (self.nav() if self.rng.random() < 0.5 else f"<p>{self.sentence(1, 9)}</p>"))

    def footer(self) -> str:
        r = self.rng
        inner = r.choice([f"&copy; {self.words(1, 2)} &middot; {self.sentence(2, 14)}", f"<p>&copy; {r.randint(1999, 2024)} {self.sentence(1, 12)}</p>" + self.links(), self.links() + self.sentence(2, 20), f"&copy; www.{self.words(1, 1)}.org &middot; {self.sentence()} {self.sentence()}"])
        return self.named(["footer", "footer", "div"], ["footer", "site-footer", "bottom", "copyright", "legal"], inner)

    def advert(self) -> str:
        r = self.rng
        inner = r.choice([self.sentence(), f"<p>{self.prose(False, 3)}</p>", f'<a href="/buy">{self.sentence(2, 10)}</a>', f"{self.sentence()} {self.sentence()}", f"<h3>{self.words(1, 4)}</h3><p>{self.prose(False, 2)}</p>"])
        return self.named(["div", "div", "aside", "section", "p"], ["ad", "ads", "advert", "ad-banner", "banner", "sponsored", "promo", "advertisement ad-slot"], inner)

    def sidebar(self) -> str:
        r = self.rng
        inner = "".join(r.choice([f"<h3>{self.words(1, 3)}</h3>{self.links()}", f"<p>{self.prose(False, 4)}</p>", self.advert(), f"<div>{self.sentence()}</div>"]) for _ in range(r.randint(1, 4)))
        return self.named(["aside", "div", "section"], ["sidebar", "widget-area", "aside", "right-sidebar", "widgets"], inner)

    def notice(self) -> str:
        r = self.rng
        button = r.choice(["", "<button>OK</button>", f'<a href="#">{self.words(1, 2)}</a>'])
        return self.named(["div", "section", "p"], ["cookie-notice", "notice", "alert", "cookie-banner", "consent", "gdpr", "popup", "site-notice"], f"{r.choice(['', '<p>'])}{self.prose(False, 3)}{button}")

    def form(self) -> str:
        r = self.rng
        fields = "".join(f"<label>{self.words(1, 3)}</label><input name=x>" for _ in range(r.randint(1, 4)))
        choice = f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>" if r.random() < 0.3 else ""
        body = f"<form{r.choice(['', ' class=\"search\"', ' id=\"subscribe\"'])}><p>{self.sentence(2, 14)}</p>{fields}{choice}<button>{self.words(1, 2)}</button></form>"
        return body if r.random() < 0.6 else self.named(["div", "section"], ["newsletter", "signup", "login", "contact-form"], f"<h3>{self.words(1, 4)}</h3>{body}")

    def comments(self) -> str:
        r = self.rng
        one = lambda: r.choice(["<li>", "<div class='comment'>", "<article class='comment'>", "<div>"]) + f"<b>{self.words(1, 2)}</b>" + "".join(f"<p>{self.prose(False, 4)}</p>" for _ in range(r.randint(1, 3)))
        close = "</li></div></article>"
        inner = f"<h3>{self.words(1, 3)}</h3>" + "".join(one() + close for _ in range(r.randint(1, 8)))
        return self.named(["section", "div", "ol"], ["comments", "comment-list", "commentlist", "reader-comments", "disqus_thread", "discussion", "replies"], inner + (self.form() if r.random() < 0.4 else ""))

    def related(self) -> str:
        return self.named(["div", "aside", "section"], ["related", "share", "social", "recommended", "tags", "more-stories"], f"<h4>{self.words(1, 3)}</h4>{self.links()}")

    def page(self) -> str:
        r = self.rng
        title = self.words(2, 10).capitalize()
        blocks = [f"<h1>{_MAIN}{title}</h1>"] if r.random() < 0.85 else []
        blocks += [self.paragraph(True) for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 13, 25]))]
        if r.random() < 0.35:
            blocks.insert(r.randint(0, len(blocks)), r.choice([self.advert, self.related, self.form, self.notice])())
        inner = "".join(blocks)
        kind = r.random()
        if kind < 0.5:
            inner = f"<article{r.choice(['', '', ' class=\"post\"'])}>{inner}</article>"
        elif kind < 0.62:
            inner = f"<main>{inner}</main>"
        elif kind < 0.7:
            inner = f"<main><article>{inner}</article></main>"
        elif kind < 0.95:
            inner = self.named(["div", "div", "section", "td"], ["content", "post", "entry-content", "article-body", "main", "story", "post-content", "text"], inner)
        else:
            inner = f"<div>{inner}</div>"
        if inner.startswith("<td"):
            inner = f"<table><tr>{r.choice(['', '<td>' + self.links() + '</td>'])}{inner}</tr></table>"
        before = [f() for f in (self.header, self.nav, self.notice, self.advert, self.sidebar, self.form) if r.random() < 0.4]
        after = [f() for f in (self.related, self.comments, self.sidebar, self.advert, self.form, self.notice, self.footer) if r.random() < 0.4]
        if r.random() < 0.8:
            r.shuffle(before)
        body = "".join([*before, inner, *after])
        if r.random() < 0.3:
            body = f'<div{r.choice(["", " id=page", " class=wrapper"])}>{body}</div>'
        head = f"<head><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>" if r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html>{head}<body>{body}</body></html>"


def labelled(tree: Tree) -> np.ndarray:
    """1 for each node that is, or holds, main text; the marks are taken out of the tree."""
    y = np.zeros(len(tree.tag))
    for v in range(len(tree.tag) - 1, -1, -1):
        if _MAIN in tree.text[v]:
            y[v] = 1
            tree.text[v] = tree.text[v].replace(_MAIN, "")
        if y[v] and tree.parent[v] >= 0:
            y[tree.parent[v]] = 1
    return y


def generated(pages: int = PAGES, seed: int = SEED) -> list[str]:
    """Marked pages; strip_marks() gives the page a reader would see."""
    rng = random.Random(seed)
    return [_Writer(rng).page() for _ in range(pages)]


def strip_marks(page: str) -> str:
    return page.replace(_MAIN, "")


@lru_cache(2)
def trained(pages: int = PAGES, seed: int = SEED) -> BoostedTrees:
    xs, ys, ws = [], [], []
    for page in generated(pages, seed):
        tree = parse(page)
        y = labelled(tree)
        # Scores hold given that the parent is kept; other nodes go with their parents.
        asked = y[np.maximum(tree.parent, 0)] > 0
        xs.append(features(tree)[asked])
        ys.append(y[asked])
        ws.append(np.ones(int(asked.sum())))
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))
