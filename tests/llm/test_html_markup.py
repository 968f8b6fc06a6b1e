"""Pages of odd markup: time, references across tags, and the tables read by another parser."""

import os
import time
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from waymark.llm import html_text, html_training

PAGES = "/root/testdata/sf0.1/pages.parquet"

SHAPES = {
    "open tags": "<a " * 350_000,
    "open quotes": "<a title='x " * 85_000,
    "open quotes and an end": "<a title='x " * 85_000 + ">",
    "end in quotes": '<a x="" ' * 60_000 + '<a x=">" ' * 60_000,
    "deep and unmatched": "<div>" * 100_000 + "</i>x" * 100_000,
    "unmatched behind a cell": "<i><table><td>" + "<div>" * 90_000 + "</i>" * 90_000,
    "rules in spans": "<span class=x>" * 35_000 + "<hr>" * 100_000,
    "declarations": "<!" * 500_000,
    "comments": "<!--" * 250_000,
    "raw text": "<style></styl" * 80_000,
    "long attributes": "<p class" + " " * 1_000_000 + ">x",
    "references": "&am" * 350_000,
}


@pytest.mark.parametrize("name", SHAPES)
def test_a_page_of_a_megabyte_takes_seconds_whatever_its_markup(name):
    page = SHAPES[name]
    began = time.process_time()
    html_text.parse(page)
    whole = time.process_time() - began
    began = time.process_time()
    html_text.parse(page[: len(page) // 4])
    assert whole < 4 and whole < 12 * max(0.1, time.process_time() - began)


def text(page):
    tree = html_text.parse(page)
    return html_text.text_of(tree, np.ones(len(tree.tag), bool))


def test_references_are_decoded_run_by_run():
    assert text("<p>AT&<b>amp;</b>") == "AT&amp;"
    assert text("<p>&am<i>p;</i> &amp;amp; &#65;<!-- -->&#x42; &lt<b>b</b>&gt;") == "&amp; &amp; AB <b>"
    assert text("<p>a&nbsp;&nbsp;<i>&nbsp;b</i>&eacute;") == "a bé"


def test_tags_end_outside_quoted_values():
    assert text("<p data-x=\"a>b\">c</p><p title='>'>d</p><p x=y\"z>e</p>") == "c\n\nd\n\ne"
    assert text('<a href="x>one</a> two <b>3</b>') == "one two 3"  # the quote is never closed
    assert text("a<b <p>c") == "ac" and text("1 < 2 <3 <<p>>x") == "1 < 2 <3 <\n\n>x"
    assert text("x<p class='never") == "x" and text("x<!-- never -- >") == "x" and text("x<script>never</scrip>") == "x"


def test_pages_are_batched_by_length(monkeypatch):
    model = html_training.trained()
    pages = ["<article><h1>Title</h1>" + f"<p>A sentence number {i}, of an article with words.</p>" * (1 + i % 5) + "</article>" for i in range(30)] + [None, ""]
    want = html_text.extract(pages, model)
    monkeypatch.setattr(html_text, "_CHARS", 100)
    assert html_text.extract(pages, model) == want and want[-1] == want[-2] == ""


class Article(HTMLParser):
    """The text of the article elements: blocks apart, white space as one space."""

    def __init__(self):
        super().__init__()
        self.depth, self.skipped, self.parts = 0, 0, []

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCK:
            self.parts.append("\0")
        self.depth += tag == "article"
        self.skipped += tag in ("script", "style")
        if tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in html_text.BLOCK:
            self.parts.append("\0")
        self.depth -= tag == "article"
        self.skipped -= tag in ("script", "style")

    def handle_data(self, data):
        if self.depth and not self.skipped:
            self.parts.append(data)


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no tables here")
def test_tables_against_another_parser():
    """On these pages the article element holds the main text and nothing else."""
    rows = [h for h in pq.read_table(PAGES, columns=["html"]).column("html").to_pylist() if h]
    got = html_text.extract(rows, html_training.trained())
    wrong = 0
    for page, mine in zip(rows, got, strict=True):
        other = Article()
        other.feed(page)
        other.close()
        blocks = (" ".join(b.split()) for b in "".join(other.parts).split("\0"))
        wrong += "\n\n".join(b for b in blocks if b) != mine
    assert wrong <= 0.01 * len(rows), wrong
