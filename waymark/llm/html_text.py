"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded top-down on the tree.

A page becomes a tree of block elements (and of inline elements that carry a class, id or role)
whose leaves are runs of text. Boosted trees score each node, given that its parent is kept, from subtree
density, attribute tokens, depth and sibling statistics. Decoding goes down the tree and keeps a node
only if its parent is kept, so that no choice contradicts one above it. The trees are trained here on
generated pages whose main text is known.

Defined results: null and empty html give an empty text; a page without main text gives an empty
text; broken markup is closed as browsers do (open paragraphs end at the next block; a tag or comment
that never ends takes what follows with it); repeated rows come back as often; an empty table gives no
rows; very long pages are read whole, in time that grows with their length, whatever their markup.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element names by role, as HTML defines them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("script style template iframe noembed noframes title textarea".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "option", "optgroup", "caption", "legend", "tbody", "thead", "tfoot", "tr", "td", "th"}
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "optgroup"}),
}
TAG_GROUPS = [
    {"article", "main"}, {"section"}, {"div", "center"}, {"p"}, {"h1", "h2"}, {"h3", "h4", "h5", "h6"}, {"ul", "ol", "dl", "menu"}, {"li", "dd", "dt"},
    {"table", "tr", "td", "th", "tbody", "thead"}, {"blockquote", "pre", "figure", "figcaption"}, {"nav"}, {"header", "hgroup"}, {"footer"}, {"aside"},
    {"form", "fieldset", "select", "option", "button", "label"}, {"#text"}, {"body", "html"},
]
# Words in class, id and role attributes, by what they tell of.
TOKENS = [
    "article content post entry main story body text prose page paragraph maincontent document read".split(),
    "nav navigation navbar menu breadcrumb breadcrumbs topbar toolbar pagination pager skip tabs links sitemap".split(),
    "ad ads adv advert advertisement banner sponsor sponsored promo promotion dfp teaser outbrain taboola commercial".split(),
    "comment comments commentlist respond reply replies disqus discussion thread reviews feedback".split(),
    "cookie cookies consent gdpr notice alert modal popup overlay paywall toast dialog announcement".split(),
    "header footer masthead copyright legal colophon bottom top logo contentinfo".split(),
    "sidebar aside widget related recommended share social tags meta byline author toc newsletter subscribe signup trending popular more".split(),
    "form login search register contact subscribe input".split(),
]
_TOKEN_CLASS = {w: [i for i, group in enumerate(TOKENS) if w in group] for group in TOKENS for w in group}
#: A tag's name, and what may stand up to its end: quotes hold a value only after an equals sign.
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=(?!\s*+[\"']))*+>")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|(?=[\s/]|$))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
N_FEATURES = 16 + 2 * len(TAG_GROUPS) + 2 * len(TOKENS)


class Tree:
    """Nodes of one page in document order; parents come before their children."""

    def __init__(self) -> None:
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.tokens: list[tuple[int, ...]] = []
        self.hidden: list[bool] = []
        self.controls: list[int] = []
        self.text: list[str] = []  # of runs only
        self.linked: list[int] = []  # characters of a run inside links
        self.block: list[int] = []  # the block that a run belongs to

    def add(self, tag: str, parent: int, tokens: tuple[int, ...] = (), hidden: bool = False, text: str = "", linked: int = 0, block: int = -1) -> int:
        for column, value in zip((self.tag, self.parent, self.tokens, self.hidden, self.controls, self.text, self.linked, self.block), (tag, parent, tokens, hidden, 0, text, linked, block), strict=True):
            column.append(value)
        return len(self.tag) - 1


#: Raw attributes up to this length are kept in the cache.
_CACHED = 512


def _attributes(raw: str) -> tuple[tuple[int, ...], bool, bool]:
    """Token classes of class, id and role; whether there are any such attributes; whether it is hidden."""
    return _kept_attributes(raw) if len(raw) <= _CACHED else _read_attributes(raw)


def _read_attributes(raw: str) -> tuple[tuple[int, ...], bool, bool]:
    got, some, hidden = [], False, False
    for m in _ATTR.finditer(raw):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id", "role"):
            some = True
            got += [k for w in _WORD.findall(value) for k in _TOKEN_CLASS.get(w.lower(), ())]
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = hidden or name != "style" or bool(re.search(r"none|hidden", value, re.I))
    return tuple(got), some, hidden


_kept_attributes = lru_cache(4096)(_read_attributes)


def lex(page: str) -> Iterator[tuple[str, str, str]]:
    """The page's parts as (kind, tag, rest): text (its characters in tag), open and close (lower-case name, raw attributes).

    Time grows with the page's length alone: each character is passed once, but for one look to the
    page's end for a tag that quotes keep open. After such a look quotes bound nothing any more. A tag
    or a comment that never ends takes the rest of the page with it, as in browsers.
    """
    at, end, quotes = 0, len(page), True
    while at < end:
        if page[at] != "<":
            stop = page.find("<", at)
            stop = end if stop < 0 else stop
            yield "text", page[at:stop], ""
            at = stop
        elif m := _NAME.match(page, at):
            rest = _REST.match(page, m.end()) if quotes else None
            if rest is None:
                quotes = False
                stop = page.find(">", m.end()) + 1
                if not stop:
                    return
            else:
                stop = rest.end()
            yield ("close" if m[1] else "open"), m[2].lower(), page[m.end() : stop - 1]
            at = stop
            tag = m[2].lower()
            if not m[1] and tag in SKIPPED and (not page.endswith("/", m.end(), stop - 1) or tag in ("script", "style", "title", "textarea")):
                close = _CLOSERS[tag].search(page, at)
                at = close.end() if close else end
        elif page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = end if stop < 0 else stop + 3
        elif page.startswith(("<!", "<?", "</"), at):
            stop = page.find(">", at)
            at = end if stop < 0 else stop + 1
        else:
            yield "text", "<", ""
            at += 1


_CLOSERS = {tag: re.compile(rf"</{tag}[\s/]*>", re.I) for tag in SKIPPED}


class _Open:
    """The open elements of a page, with the places of each name, of blocks and of table cells at hand."""

    def __init__(self, tag: str, node: int) -> None:
        self.stack: list[tuple[str, int]] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.cells: list[int] = []
        self.push(tag, node)

    def push(self, tag: str, node: int) -> None:
        place = len(self.stack)
        self.stack.append((tag, node))
        self.at.setdefault(tag, []).append(place)
        if tag in BLOCK:
            self.blocks.append(place)
        if tag in ("td", "th", "table"):
            self.cells.append(place)

    def last(self, tags: Iterable[str]) -> int:
        """The innermost place of any of the tags; 0, the page's own, if none is open."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=0)

    def cut(self, depth: int) -> list[str]:
        """Close all elements from depth on; their names."""
        gone = [tag for tag, _ in self.stack[depth:]]
        for tag in gone:
            self.at[tag].pop()
        del self.stack[depth:]
        for places in (self.blocks, self.cells):
            while places and places[-1] >= depth:
                places.pop()
        return gone


def parse(page: str) -> Tree:
    """The tree of a page. Scripts, styles, comments and markup are left out; references are decoded run by run.

    A reference does not reach over a tag: ``&am<i>p;</i>`` is no ampersand.
    """
    tree = Tree()
    root = tree.add("html", -1)
    opened = _Open("html", root)  # an inline element without a node has its parent's
    stack = opened.stack
    pieces: list[str] = []
    linked, links, block = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = "".join(pieces)
            if text.strip():
                tree.add("#text", stack[-1][1], text=text, linked=linked, block=block)
            pieces.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal links, block
        if stack[-1][1] != stack[depth - 1][1]:
            flush()
        for tag in opened.cut(depth):
            links -= tag == "a"
            if tag in BLOCK:
                block += 1

    for kind, tag, rest in lex(page):
        if kind == "text":
            text = entities.unescape(tag)
            pieces.append(text)
            if links:
                linked += len(text)
            continue
        if kind == "close":
            if tag == "br":
                pieces.append(" ")
            depth = opened.last((tag,))
            # An end tag does not reach out of a table cell, but for those of tables and of the page.
            bounded = tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "td", "th")
            if depth and not (bounded and opened.cells and opened.cells[-1] > depth):
                pop_to(depth)
            continue
        if tag in SKIPPED:
            if tag == "textarea":
                tree.controls[stack[-1][1]] += 1
            continue
        if tag in ("br", "wbr"):
            pieces.append(" " if tag == "br" else "")
            continue
        if tag in ("input", "button", "select"):
            tree.controls[stack[-1][1]] += 1
        if tag in VOID and tag != "hr":
            continue
        if tag in ("html", "body") and len(stack) > 1 and opened.at.get(tag):
            continue
        if tag in CLOSES_P and opened.blocks and opened.blocks[-1] and stack[opened.blocks[-1]][0] == "p":
            pop_to(opened.blocks[-1])
        if tag in CLOSED_BY:
            ends, stops = CLOSED_BY[tag]
            if (depth := opened.last(ends)) and depth > opened.last(stops):
                pop_to(depth)
        tokens, some, hidden = _attributes(rest) if rest else ((), False, False)
        if tag in BLOCK:
            flush()
            block += 1
            if tag == "hr":
                continue
        if tag == "html":
            continue
        if rest.endswith("/") and tag not in BLOCK:
            continue
        if tag in BLOCK or some or hidden:
            flush()
            opened.push(tag, tree.add(tag, stack[-1][1], tokens, hidden))
        else:
            opened.push(tag, stack[-1][1])
        links += tag == "a"
    flush()
    return tree


_PUNCTUATION = str.maketrans("", "", ".,;:!?")


def features(tree: Tree) -> np.ndarray:
    """One row for each node."""
    n = len(tree.tag)
    parent = tree.parent
    chars = np.array([len(t) for t in tree.text], np.float64)
    linked = np.array(tree.linked, np.float64)
    words = np.array([t.count(" ") + 1 if t else 0 for t in tree.text], np.float64)
    marks = np.array([len(t) - len(t.translate(_PUNCTUATION)) if t else 0 for t in tree.text], np.float64)
    paragraphs = np.array([t == "p" for t in tree.tag], np.float64)
    controls = np.array(tree.controls, np.float64)
    nodes = np.ones(n)
    runs = np.array([t == "#text" for t in tree.tag], np.float64)
    sums = np.stack([chars, linked, words, marks, paragraphs, controls, nodes, runs])
    total = [list(column) for column in sums.T]
    depth, index, siblings = [0] * n, [0] * n, [0] * n
    for v in range(1, n):
        p = parent[v]
        depth[v] = depth[p] + 1
        index[v] = siblings[p]
        siblings[p] += 1
    for v in range(n - 1, 0, -1):
        mine, up = total[v], total[parent[v]]
        for k in range(8):
            up[k] += mine[k]
    sub = np.array(total)
    up = np.array([max(p, 0) for p in parent])
    n_children = np.array(siblings, np.float64)
    before = np.cumsum(chars) - chars
    page = max(1.0, sub[0, 0])
    around = sub[up]
    others = np.maximum(1, n_children[up] - 1)
    size = np.maximum(1, sub[:, 0])
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, 0] = depth
    out[:, 1] = np.log1p(sub[:, 0])
    out[:, 2] = sub[:, 1] / size
    out[:, 3] = np.log1p(sub[:, 4])
    out[:, 4] = sub[:, 6] / size
    out[:, 5] = sub[:, 3] / size
    out[:, 6] = np.array(index) / np.maximum(1, n_children[up])
    out[:, 7] = np.log1p(n_children[up])
    out[:, 8] = sub[:, 0] / page
    out[:, 9] = before / page
    out[:, 10] = sub[:, 5]
    out[:, 11] = sub[:, 2] / np.maximum(1, sub[:, 7])  # words a run
    out[:, 12] = np.log1p((around[:, 0] - sub[:, 0]) / others)  # sibling size
    out[:, 13] = (around[:, 1] - sub[:, 1]) / np.maximum(1, around[:, 0] - sub[:, 0])  # sibling links
    out[:, 14] = sub[:, 0] / np.maximum(1, around[:, 0])
    hidden = np.array(tree.hidden)
    base = 16
    groups = {t: i for i, g in enumerate(TAG_GROUPS) for t in g}
    own = np.zeros((n, len(TOKENS)), np.float32)
    for v in range(n):
        if (g := groups.get(tree.tag[v])) is not None:
            out[v, base + g] = 1
        for k in tree.tokens[v]:
            own[v, k] += 1
    out[1:, base + len(TAG_GROUPS) : base + 2 * len(TAG_GROUPS)] = out[up[1:], base : base + len(TAG_GROUPS)]
    base += 2 * len(TAG_GROUPS)
    out[:, base : base + len(TOKENS)] = own
    base += len(TOKENS)
    for v in range(1, n):
        hidden[v] |= hidden[parent[v]]
        out[v, base:] = np.maximum(out[parent[v], base:], own[parent[v]])
    out[:, 15] = hidden
    return out


class BoostedTrees:
    """Logistic gradient boosting with full-depth trees on quantile-binned features.

    Each tree is grown on a random share of the rows and of the features.
    """

    def __init__(self, trees: int = 100, depth: int = 5, rate: float = 0.15, bins: int = 32, smooth: float = 6.0, share: float = 0.5, seed: int = 7) -> None:
        self.trees, self.depth, self.rate, self.bins, self.smooth, self.share, self.seed = trees, depth, rate, bins, smooth, share, seed

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        cuts = [self._cuts(x[:, j]) for j in range(m)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], "right") for j in range(m)])
        rng = np.random.default_rng(self.seed)
        share = np.average(y, weights=weight)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(n, self.base)
        leaves = 1 << self.depth
        self.feature = np.zeros((self.trees, leaves - 1), np.int32)
        self.cut = np.full((self.trees, leaves - 1), np.inf, np.float32)
        self.value = np.zeros((self.trees, leaves), np.float32)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            drawn = np.nonzero(rng.random(n) < self.share)[0]
            asked = [j for j in range(m) if len(cuts[j]) and rng.random() < self.share]
            its_g, its_h = g[drawn], h[drawn]
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                width = 1 << level
                best = np.full(width, 1e-6)
                first = width - 1
                choice = [(0, -1)] * width
                here = at[drawn] * self.bins
                for j in asked:
                    key = here + binned[j, drawn]
                    gs = np.bincount(key, its_g, width * self.bins).reshape(width, -1).cumsum(1)
                    hs = np.bincount(key, its_h, width * self.bins).reshape(width, -1).cumsum(1)
                    left, right = gs[:, :-1], gs[:, -1:] - gs[:, :-1]
                    gain = left**2 / (hs[:, :-1] + self.smooth) + right**2 / (hs[:, -1:] - hs[:, :-1] + self.smooth) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.smooth)
                    gain[:, len(cuts[j]) :] = 0
                    top = gain.argmax(1)
                    for node in np.nonzero(gain[np.arange(width), top] > best)[0]:
                        best[node], choice[node] = gain[node, top[node]], (j, int(top[node]))
                for node, (j, b) in enumerate(choice):
                    if b >= 0:
                        self.feature[t, first + node], self.cut[t, first + node] = j, cuts[j][b]
                at = at * 2 + (x[np.arange(n), self.feature[t, first + at]] >= self.cut[t, first + at])
            gs, hs = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
            self.value[t] = self.rate * gs / (hs + self.smooth)
            score += self.value[t][at]
        return self

    def _cuts(self, values: np.ndarray) -> np.ndarray:
        """Fewer than bins cuts: between all distinct values if they are few, else half of them by rows and half by values.

        By rows alone, a mark that few nodes bear would have no cut.
        """
        distinct = np.unique(values)
        if len(distinct) <= self.bins:
            return (distinct[1:] + distinct[:-1]) / 2
        at = np.linspace(0, 1, self.bins // 2 + 1)[1:-1]
        return np.unique(np.concatenate((np.quantile(values, at), np.quantile(distinct, at))))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds for each row."""
        rows, out = np.arange(len(x)), np.full(len(x), self.base, np.float32)
        for t in range(self.trees):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = (1 << level) - 1 + at
                at = at * 2 + (x[rows, self.feature[t, node]] >= self.cut[t, node])
            out += self.value[t][at]
        return out


def decode(parent: list[int], scores: np.ndarray) -> np.ndarray:
    """Top-down choice in which no node is kept without its parent.

    scores are log-odds given that the parent is kept, so each node below a kept one takes its more
    likely side and everything below a dropped one is dropped. A node's depth alone, and the number
    of nodes of a page, weigh nothing.
    """
    kept = np.zeros(len(parent), bool)
    for v, p in enumerate(parent):
        kept[v] = scores[v] > 0 and (p < 0 or kept[p])
    return kept


def text_of(tree: Tree, kept: np.ndarray) -> str:
    """The kept runs: blocks in page order, white space in a block one space, two line feeds between."""
    blocks: dict[int, list[str]] = {}
    for v, tag in enumerate(tree.tag):
        if tag == "#text" and kept[v]:
            blocks.setdefault(tree.block[v], []).append(tree.text[v])
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(b for b in joined if b)


#: Pages whose nodes are scored at once, and their characters about.
_PAGES, _CHARS = 64, 1 << 21


def extract(pages: list[str | None], model: BoostedTrees) -> list[str]:
    out: list[str] = []
    at = 0
    while at < len(pages):
        trees, chars = [], 0
        while at < len(pages) and len(trees) < _PAGES and chars < _CHARS:
            trees.append(parse(pages[at] or ""))
            chars += len(pages[at] or "")
            at += 1
        scores = model.score(np.concatenate([features(t) for t in trees]))
        for tree in trees:
            mine, scores = scores[: len(tree.tag)], scores[len(tree.tag) :]
            out.append(text_of(tree, decode(tree.parent, mine)))
    return out


def main_text(html: Column, model: BoostedTrees) -> Column:
    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series(extract(list(pages), model), dtype=object)

    return of(html)


def extract_pages(pages: DataFrame, model: BoostedTrees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    got = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), main_text(F.col(html_col), model).alias("text"))
    return got.withColumn("n_chars", F.char_length("text").cast("long"))
