import itertools
import random

import pytest

from fluxweave.llm import html_text as ht
from tests.conftest import SMOKE

PAGE = """<html><head><title>x</title><style>p{}</style></head><body><header><h1>My Site</h1><p>Welcome to the best site on earth.</p></header>
<div class="cookie-notice">We use cookies to make it better. Accept.</div><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="content"><h1>Article title</h1><p>First paragraph with enough   text to be content, really it has.</p><p>Short.</p>
<div class="ad-banner">Buy now the best thing in the world, only today.</div><script>var a = "<p>no</p>";</script>
<p>Second paragraph, with <a href=x>a link</a> inside<br>of it and &eacute;&nbsp;x &amp; y.</p><ul><li>item one<li>item two</ul></div>
<aside class="sidebar"><p>Related: other story that is long enough to look like an article.</p></aside>
<form><label>Your name</label><input></form><div id="comments"><p>I really like this article, thanks for writing all of it down.</p></div>
<footer>Copyright 2020 all rights reserved by us.</footer></body></html>"""
TEXT = [
    "Article title",
    "First paragraph with enough text to be content, really it has.",
    "Short.",
    "Second paragraph, with a link inside of it and é x & y.",
    "item one",
    "item two",
]


def test_article_without_the_rest():
    assert ht.article_blocks(PAGE) == TEXT
    assert ht.article_blocks(PAGE.replace('div class="content"', "article")) == TEXT


@pytest.mark.parametrize("page", ["", None, "<", "<p", "<!-- x", "<script>a", "<nav>a</nav>", "<div></div>", "&", "<style>p</style>"])
def test_pages_without_text(page):
    assert ht.main_text(page) == ""


@pytest.mark.parametrize("page", ["plain words only, no markup at all, and quite a few of them.", "<p>A paragraph of some length that stands alone.<p>Another one.", "<article>x y</article", "<b><i><p>Crossed <b>tags</i> here, but text enough to keep.</b>"])
def test_broken_markup_keeps_text(page):
    assert ht.main_text(page)


def cut_value(source, sink, ties, kept):
    return sum(s for s, k in zip(source, kept) if not k) + sum(t for t, k in zip(sink, kept) if k) + sum(c for a, b, c in ties if kept[a] != kept[b])


def test_cut_is_minimum():
    draw = random.Random(6)
    for _ in range(200):
        n = draw.randint(1, 9)
        source, sink = ([draw.uniform(0, 3) for _ in range(n)] for _ in range(2))
        ties = [(draw.randrange(n), draw.randrange(n), draw.uniform(0, 2)) for _ in range(draw.randint(0, 14))]
        got = cut_value(source, sink, ties, ht.minimum_cut(source, sink, ties))
        best = min(cut_value(source, sink, ties, kept) for kept in itertools.product((False, True), repeat=n))
        assert abs(got - best) < 1e-6


def test_long_page_and_deep_nesting():
    assert ht.main_text("<article>" + "<p>One more line of text, as long as it takes.</p>" * 3000 + "</article>").count("\n") == 2999
    assert ht.main_text("<div>" * 3000 + "<p>Deep down a paragraph of text that has to be found.</p>") != ""


def test_edges(spark):
    rows = [(1, "u", None, "mine"), (2, None, "", "mine"), (3, "u", PAGE, "mine"), (3, "u", PAGE, "mine")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.n_chars, r.text) for r in ht.extract(pages).collect())
    want = "\n".join(TEXT)
    assert got == [(1, 0, ""), (2, 0, ""), (3, len(want), want), (3, len(want), want)]
    assert ht.extract(pages.limit(0)).count() == 0


def test_query_returns_the_articles(spark):
    """The given pages hold their text in one article element."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMOKE}/pages.parquet").collect()}
    rows = ht.op8_html_extraction(spark, SMOKE).collect()
    assert {r.page_id for r in rows} == set(pages)
    for r in rows:
        html = pages[r.page_id] or ""
        inside = html.partition("<article>")[2].partition("</article>")[0]
        assert r.n_chars == len(r.text) and r.text == "\n".join(b.text for b in ht.page_blocks(inside)[0])


LINES = "<p>The first paragraph of the article is long enough to be one.</p><p>And so is the second paragraph, which ends it.</p>"
KEPT = "The first paragraph of the article is long enough to be one.\nAnd so is the second paragraph, which ends it."


@pytest.mark.parametrize(
    "page,want",
    [
        (f'<div class="content-sidebar-wrap"><main>{LINES}</main><div class="sidebar"><p>Popular posts of the week.</p></div></div>', KEPT),
        (f'<div class="layout with-sidebar"><article>{LINES}</article></div>', KEPT),
        (f'<article><header class="entry-header"><h1>A title</h1></header>{LINES}</article>', "A title\n" + KEPT),
        (f'<article><div class="social-history">{LINES}</div><div class="social-links"><a href="x">Tweet this</a></div></article>', KEPT),
        (f'<header class="site-header">Site name.</header><article>{LINES}</article><div id="comments"><article>{LINES * 3}</article></div>', KEPT),
        (f'<article>{LINES}<div class="header-ad">Buy this now.</div></article>', KEPT),
    ],
)
def test_names_of_wrappers_and_of_an_articles_own_parts(page, want):
    assert ht.main_text(f"<html><body>{page}</body></html>") == want
