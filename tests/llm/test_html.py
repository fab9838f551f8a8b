"""Reading tags in linear time, sloppy pages, and layouts written by hand."""

import time
from collections import Counter

import pytest
from layouts import LAYOUTS

from fieldstone.llm import html
from fieldstone.llm.common import table

ATTRIBUTES = " ".join(f'a{i}="b"' for i in range(1000))


@pytest.mark.parametrize(
    "page",
    [f"<img {ATTRIBUTES}", "<p>x" + '<img a="b" ' * 20_000, "<div>" * 50_000 + "</span>" * 50_000, "<span class=x>" + "<div>" * 50_000 + "</span>" * 50_000,
     "<i class=y><div>" + "<b class=x>" * 50_000 + "</i>" * 50_000, "<div>" * 50_000 + "<li></li>" * 50_000, "<a " * 100_000, "<!" * 100_000, "<" * 100_000,
     "<noscript>" * 20_000, "<svg>" + "<g>" * 50_000 + "</q>" * 50_000, '<p a="x>' * 50_000, "<!--" * 50_000, "<title>" * 20_000],
    ids=range(14),
)
def test_reading_is_linear(page):
    began = time.perf_counter()
    html.parse(page)
    assert time.perf_counter() - began < 3


def texts(page):
    return "|".join(t for _, t, _ in html.parse(page).text if t)


def test_sloppy_pages():
    assert texts("<head><title>t</title><meta x><p>hello") == "hello"
    assert texts("<div><button>b</div><p>text") == "text"
    assert texts("<button>x<p>a</p></button>after") == "after"
    assert texts("<div><svg><g><path/></div>ok") == "ok"
    assert texts("<body><noscript>never closed<p>in</body>") == ""
    assert texts("a < b and c<d>e") == "a <| b and c|e"
    assert texts("<p title=don't>x</p>") == "x" and texts('<p a="1>2">q</p>') == "q"
    assert texts("x<p>y<img src=") == "x|y" and texts("</3>x<?php y ?>z<!DOCTYPE html>") == "x|z"


def test_layouts_by_hand(spark):
    """Words of the article found, and found words that are the article's."""
    model = html.train(table(spark, "/root/testdata/sf0.01", "pages"))
    given = got = both = 0
    for name, page, article in LAYOUTS:
        read = html.parse(page)
        logs = html.log_probabilities((model.feature, model.limit, model.leaf, model.prior), html.features(read))
        a, b = Counter(html.main_text(read, html.decode(read.parent, logs.tolist())).split()), Counter(article.split())
        given, got, both = given + b.total(), got + a.total(), both + (a & b).total()
    assert both >= 0.97 * got and both >= 0.9 * given


def test_articles_of_a_few_words(spark):
    """Every page's whole article is found, also where it is one short line."""
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    model = html.train(pages)
    short = 0
    for (source,) in pages.select("html").collect():
        read = html.parse(source)
        logs = html.log_probabilities((model.feature, model.limit, model.leaf, model.prior), html.features(read))
        want = html.main_text(read, html.teacher(read).tolist())
        short += len(want) < 100
        assert html.main_text(read, html.decode(read.parent, logs.tolist())) == want
    assert short
