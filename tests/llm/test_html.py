"""HTML extraction on written pages and on the given ones."""

import html as entities
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brickfield.llm import htmltext, queries

SF = "/root/testdata/sf0.001"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><article>x</article>";</script></head>
<body class="page"><header><h1>Site</h1></header><div role="navigation"><p>Menu</p></div><nav><ul><li>A<li>B</ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <article>no</article> --><aside>Side</aside>
<article class="post"><header><p>By someone</p><h1>Head &amp; {0}</h1></header><p>First <b>bold</b>
 text&nbsp;here<br>next<p>Second {0}<div class="ad">Buy</div><form><p>Name</p><input></form><ul><li>one<li>two</ul>
<section id="comments"><article><p>Nice post</p></article></section></article>
<section class="comments"><article><p>Me too</p></article></section><footer>&copy; F</footer></body></html>"""


def text_of(*pages):
    return htmltext.main_texts([htmltext.blocks_of(p) for p in pages])


def test_zones():
    assert text_of(PAGE.format("x")) == ["Head & x\nFirst bold text here next\nSecond x\none\ntwo"]


def test_boilerplate_of_a_host_goes_and_unique_runs_stay():
    lead, end = "Welcome to the finest site of all the sites there are", "All rights reserved by the owners of this site since nineteen ninety"
    pages = [f"<body><div>{lead}</div><p>Story number {k} has words w{k}a w{k}b w{k}c w{k}d w{k}e</p><p>{end} {k}</p></body>" for k in range(6)]
    got = text_of(*pages)
    assert got == [f"Story number {k} has words w{k}a w{k}b w{k}c w{k}d w{k}e\n{k}" for k in range(6)]
    assert text_of(pages[0]) == [f"{lead}\nStory number 0 has words w0a w0b w0c w0d w0e\n{end} 0"]
    copies = [pages[0]] * 5
    assert text_of(*copies) == text_of(pages[0]) * 5


def test_article_passages_shared_by_pages_stay():
    line = "A line that every article of this host holds in its middle"
    assert text_of(*(f"<article><p>a{k}</p><p>{line}</p></article>" for k in range(5))) == [f"a{k}\n{line}" for k in range(5)]


def test_unique_text_beside_an_article_stays_and_repeated_text_goes():
    menu = "Home News Sports Weather Money Travel About us"
    pages = [f"<div>{menu}</div><p>Lead w{k}a w{k}b of page {k}</p><article><p>Teaser {k}</p></article><div>{menu}</div>" for k in range(6)]
    assert text_of(*pages) == [f"Lead w{k}a w{k}b of page {k}\nTeaser {k}" for k in range(6)]
    assert text_of(*(p.replace("article>", "main>") for p in pages)) == [f"Lead w{k}a w{k}b of page {k}\nTeaser {k}" for k in range(6)]


def test_broken_markup():
    for page in ["", "<", "a < b", "<p", '<p class="x', "<!--", "<script>", "<![CDATA[x", "</div></p>", "<p a='>'>q", "<article><p>x" + "<b>" * 2000, '<a "' * 2000]:
        htmltext.blocks_of(page)
    assert text_of("a < b<p>c</q>d", "<p a='>'>q") == ["a < b\ncd", "q"]
    assert text_of("<article><p>x<div>y</article>z") == ["x\ny"]


def test_articles_in_elements_with_other_names_stay():
    story = "<article><p>Story</p></article>"
    for page in (
        f"<div class='content has-sidebar'>{story}</div>",
        f"<div id='page-share'>{story}</div>",
        f"<div class='menu'>{story}</div>",
        f"<form action='/'>{story}</form>",
        f"<html><head><title>T</title><meta charset='utf-8'><body>{story}",
        f"<head><link rel='x'><div>{story}</div>",
        f"<div class='banner'><main><p>Story</p></main></div>",
    ):
        assert text_of(page) == ["Story"], page
    for page in ("<nav><article><p>x</p></article></nav>", "<div class='comments'><article><p>x</p></article></div>", "<div hidden><article><p>x</p></article></div>", "<div class='site-footer'><p>x</p></div>", "<form><p>x</p></form>"):
        assert text_of(page) == [""], page


def test_quoted_attributes_of_any_length():
    for n in (100, 9000, 100_000):
        for quote in "\"'":
            assert text_of(f"<div data-x={quote}a > {'y' * n}{quote}><p>q</p></div>") == ["q"]
    assert text_of('<p a="x>q') == ["q"]
    htmltext.blocks_of('<a "<a >' * 20_001)


@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(tokens):
    order, common = htmltext.suffix_array(np.array(tokens, np.int64))
    cut = lambda k: tokens[k : k + 64]
    assert sorted(order.tolist()) == list(range(len(tokens)))
    for n, (a, b) in enumerate(zip(order[:-1].tolist(), order[1:].tolist(), strict=True)):
        assert cut(a) <= cut(b)
        lcp = next((k for k, (x, y) in enumerate(zip(tokens[a:], tokens[b:], strict=False)) if x != y), len(tokens) - max(a, b))
        assert common[n + 1] == min(lcp, common[n + 1]) and (common[n + 1] == lcp or lcp >= 64)


def test_query_gives_the_articles(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<(?!/?[ph])[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        want[r.page_id] = (r.url, "\n".join(b for b in blocks if b))
    got = {r.page_id: (r.url, r.text) for r in queries.op5_html_text(spark, SF).collect()}
    assert got == want
    assert all(len(r.text) == r.n_chars for r in queries.op5_html_text(spark, SF).collect())


def test_rows(spark):
    rows = [(1, None, None), (1, "http://A/x", "<p>a"), (1, "http://a/x", "<p>a"), (None, "http://a/y", ""), (2, "u", "<p>q</p>r")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("other", F.lit(1))
    got = sorted(((r.page_id, r.url, r.text, r.n_chars, r.other) for r in htmltext.extract_text(df).collect()), key=str)
    assert got == sorted([(1, None, "", 0, 1), (1, "http://A/x", "a", 1, 1), (1, "http://a/x", "a", 1, 1), (None, "http://a/y", "", 0, 1), (2, "u", "q\nr", 3, 1)], key=str)
    assert htmltext.extract_text(df.limit(0)).count() == 0


def test_large_hosts_are_judged_whole(spark, monkeypatch):
    line = "Boilerplate of this host in exactly eight words"
    rows = [(k, "http://big/x", f"<p>own{k} text{k}</p>" + (f"<div>{line}</div>" if k % 10 == 0 else "")) for k in range(100)]
    for size in (200, 20, 1):
        monkeypatch.setattr(htmltext, "GROUP", size)
        got = {r.page_id: r.text for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == {k: f"own{k} text{k}" for k in range(100)}


def plain_texts(pages):
    """All passages of all pages, counted one by one."""
    streams = [htmltext.stream_of(p) for p in pages]
    on = {}
    for p, s in zip(pages, streams, strict=True):
        for i in range(len(s) - htmltext.RUN + 1):
            on.setdefault(tuple(s[i : i + htmltext.RUN]), set()).add(str(p))
    few = len({str(p) for p in pages}) < htmltext.MIN_PAGES
    out = []
    for p, s in zip(pages, streams, strict=True):
        gone = {j for i in range(len(s) - htmltext.RUN + 1) if len(on[tuple(s[i : i + htmltext.RUN])]) >= htmltext.MIN_PAGES for j in range(i, i + htmltext.RUN)}
        best, lines, at = max((z for z, _ in p), default=0) if few else 0, [], 0
        for zone, text in p:
            words = text.split(" ")
            if zone != htmltext.ARTICLE:
                own = [at + k in gone for k in range(len(words))]
                at += len(words) + 1
                if not all(own):  # a covered stretch shorter than RUN only reaches into the block
                    for k in range(len(own)):
                        if own[k] and (k == 0 or not own[k - 1]):
                            end = next((e for e in range(k, len(own)) if not own[e]), len(own))
                            if end - k < htmltext.RUN:
                                own[k:end] = [None] * (end - k)
                words = [w for w, g in zip(words, own, strict=True) if not g]
            if zone >= best and words:
                lines.append(" ".join(words))
        out.append("\n".join(lines))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 3), st.text("ab", min_size=1, max_size=1).flatmap(lambda c: st.integers(1, 12).map(lambda n: " ".join((c * n)[:n])))), max_size=4), max_size=7))
def test_suffix_arrays_of_groups_find_what_counting_finds(pages):
    want = plain_texts(pages)
    assert htmltext.main_texts(pages) == want and htmltext.main_texts(pages, group=2) == want


def test_pages_without_an_article(spark):
    """Main text comes through the suffix array alone: pages whose menus and notes have no telling markup."""
    top, foot = "Latest stories from the region and the world every day", "Terms of use and privacy of this paper apply to all"
    rows = [(k, f"http://h{k % 2}.example/{k}", f"<body><div>{top}</div><div><p>Story {k} tells of w{k}a w{k}b</p><p>and of x{k}a x{k}b</p></div><div>{foot}</div></body>") for k in range(20)]
    got = {r.page_id: r.text for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Story {k} tells of w{k}a w{k}b\nand of x{k}a x{k}b" for k in range(20)}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a/x", "<p>q</p>")], "page_id long, url string, html string")
    for name in ("count", "_h", "_host", "_zones", "_blocks", "_group", "_codes", "_to", "_large", "_count", "id", "codes"):
        (row,) = htmltext.extract_text(df.withColumn(name, F.lit(7))).collect()
        assert row.text == "q" and row[name] == 7
