"""Web pages and vectors."""

import html
import math
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilwork.llm import html as web
from veilwork.llm import neighbours
from veilwork.llm.queries import QUERIES
from veilwork.llm.tables import read

SF = "/root/testdata/sf0.001"

PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div id="cookie-notice">We use cookies <button>OK</button></div>
<div class="wrapper"><div class="sidebar"><ul><li>one<li>two</ul></div><main><article class="post">
<header><h2>Title &eacute; here</h2><span class=byline>by X</span></header>
<p>First para with <b>bo</b>ld text and<br>a break &lt;tag&gt; long&nbsp;enough to be content.
<p>Second para, with more words to tell.<div class="ad-slot">BUY NOW</div>
<p>Third   para
after advert.<ul><li>item a</li><li>item b</li></ul><script>if (a<b) x("</p>")</script>
<section class="comments"><article class="comment"><p>Great post, I loved reading it</p></article></section></article></main>
<aside>related</aside></div><form>Search <input></form><footer>&copy; 2020</footer></body></html>"""


@pytest.fixture(scope="module")
def weights(spark):
    return web.learn(read(spark, SF, "pages"))


def test_pages_give_their_article(spark):
    pages = {r.page_id: r.html for r in read(spark, SF, "pages").collect()}
    rows = QUERIES["op1_html_extraction"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert r.n_chars == len(r.text)


def test_page_furniture_goes(weights):
    assert web.main_text(PAGE, weights) == (
        "Title é here First para with bold text and a break <tag> long enough to be content. "
        "Second para, with more words to tell. Third para after advert. item a item b")


def test_page_without_landmarks(weights):
    page = ('<body><div class="topbar">a b c</div><div>x1</div><div class=content><p>Only paragraphs here but good ones.</p>'
            '<p>And another one.</p></div><div role="contentinfo">foot</div></body>')
    assert web.main_text(page, weights) == "x1 Only paragraphs here but good ones. And another one."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain only", "plain only"), ("<p>a < b & c &am", "a < b & c &am"), ("<!-- open <p>x", ""),
    ("<p>x</p><a href='foo>bar'> y</a>", "x y"), ("<p>x<script>never ends", "x"), ("<p>x</p><b", "x"),
    ("<p hidden>x</p><p style='display: none'>y</p><p>z", "z"), ("</p></div>x", "x"), ("<>x</>", "<>x")])
def test_broken_pages(weights, page, text):
    assert web.main_text(page, weights) == text


@pytest.mark.parametrize("page, text", [
    ("<p>a<b title=it's>b</b> c it's d</p> e", "ab c it's d e"),
    ("<p x\"y>a</p><i it's>b</i><b title='1 > 0'>c</b>d", "a bcd"),
    ('<p "\'>a <b title="1 > 0">b</b> c', "a b c"), ("<p title = 'x > y'>a</p><b title=\"it's\">b</b> c's", "a b c's"),
    ("<p title=don't class='x>y'>a it's b", "a it's b"), ('<p>a</p><a href="foo>b</a>', "a b")])
def test_quotes_in_tags(weights, page, text):
    assert web.main_text(page, weights) == text


@pytest.mark.parametrize("part", [
    '<h2 id="discussion">kept words</h2>', '<section id="Discussion"><h2>kept</h2> words</section>', '<p id="reply-2">kept words</p>',
    '<section id="related-work">kept words</section>', '<h3 id="search-algorithms">kept words</h3>',
    '<div class="social-history">kept words</div>', '<h2 id="copyright-law">kept words</h2>', '<p id="notice-period">kept words</p>',
    '<div class="section" id="discussion"> <h2>kept</h2> <p>words</div>', '<math><mi>kept</mi> <mo>words</mo></math>',
    '<aside>kept words</aside>', '<p title="the hidden part">kept words</p>'])
def test_article_text_stays(weights, part):
    page = f"<body><article><p>First words of it.</p>{part}<p>Last words of it.</p></article></body>"
    assert web.main_text(page, weights) == "First words of it. kept words Last words of it."


@pytest.mark.parametrize("part", [
    '<div id="comments">gone</div>', '<ol class="comment-list"><li>gone</ol>', '<div class="relatedPosts"><h3>gone</h3></div>',
    '<section id="comments"><h2>gone</h2></section>', '<div class="ad-slot">gone</div>', '<aside class="sidebar">gone</aside>',
    '<div id="cookie-notice">gone</div>', '<ul class="share-buttons"><li>gone</ul>', '<p hidden>gone</p>'])
def test_article_furniture_goes(weights, part):
    page = f"<body><article><p>First words of it.</p>{part}<p>Last words of it.</p></article></body>"
    assert web.main_text(page, weights) == "First words of it. Last words of it."


def test_best_stretch_by_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        scores = rng.integers(-5, 6, rng.integers(0, 12)).tolist()
        spans = [(a, b) for a in range(len(scores) + 1) for b in range(a, len(scores) + 1)]
        best = max((sum(scores[a:b]) for a, b in spans), default=0)
        a, b = web.best_stretch(scores)
        assert sum(scores[a:b]) == best


def test_pages_odd(spark, weights):
    rows = [(1, "u", None, "old"), (None, None, "<p>x y</p>", None), (1, "u", None, "old"), (2, "u", "<p>" + "w " * 20000, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = web.extract(pages, web.learn(pages)).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("1", 0), ("2", 39999), ("None", 3)]
    assert web.extract(pages.where("false"), weights).count() == 0


@pytest.mark.parametrize("page", [
    "<div>x " * 125_000, "<article>" + "<div class=x>" * 70_000 + "x", "<div class=ad><article>" * 40_000 + "x",
    "</b>x" * 200_000, "<a>x" * 200_000, "<div b=" + "a" * 500_000 + " c=1 " + "d" * 500_000 + ">x",
    "<b title='x>" + '<i a="x>' * 60_000, "<p>&amp" * 100_000], ids=range(8))
def test_large_and_deep_pages_take_linear_time(page):
    begin = time.thread_time()
    web.main_text(page, web.Weights({}, {}))
    assert time.thread_time() - begin < 6


def test_deep_nesting_is_read_as_shallow(weights):
    """What is open around a text decides, however deep it is."""
    for inner, kept in (("<p>kept words here</p>", True), ("<div class=sidebar><p>gone</p></div>", False),
                        ("<div class=ad><article><p>kept words here</p></article></div>", True)):
        page = "<div>" * 3000 + inner + "</div>" * 3000
        assert web.main_text(page, weights) == ("kept words here" if kept else "")
    assert [i.label for i in web.parse("<header><div hidden><h2>a</h2></div><h2>b</h2></header>") if i.text] == []


def test_learning_reads_few_different_pages(spark):
    """Repeated pages count once, unlabelled ones not at all, and the choice depends on the pages alone."""
    pages = [("<p>no label</p>",), (None,)] * 5 + [(f"<article><p>{'w ' * k}</p></article><div>x</div>",) for k in range(1, 40)] * 3
    frame = spark.createDataFrame(pages, "html string")
    learned = web.learn(frame, most=10)
    assert learned == web.learn(frame.repartition(7).distinct(), most=10)
    assert learned != web.learn(frame)
    assert web.learn(frame.where("html NOT LIKE '%article%'")) == web.Weights({}, {})


def brute_force(rows, k=20):
    ids = np.array([i for i, _ in rows])
    matrix = np.array([v for _, v in rows], float)
    out = {}
    for i, v in zip(ids, matrix):
        if i % 20 == 0:
            scores = matrix @ v
            other = np.flatnonzero(ids != i)
            out[int(i)] = [int(ids[j]) for j in other[np.lexsort((ids[other], -scores[other]))][:k]]
    return out


def test_neighbours_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in read(spark, sf, "embeddings").collect()]
    want, got = brute_force(rows), {}
    for r in QUERIES["op6_permutation_index"](spark, sf).orderBy("query_id", "rank").collect():
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(want)
    found = sum(len(set(got[q]) & set(w)) for q, w in want.items())
    assert found >= 0.95 * sum(map(len, want.values()))


def test_neighbours_index_prunes(spark, monkeypatch):
    """With a small share kept and small blocks, the index still finds nine tenths; ``recall`` agrees."""
    monkeypatch.setattr(neighbours, "LEAST_KEPT", 1)
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", 100)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 10)
    vectors = read(spark, "/root/testdata/sf0.1", "embeddings")
    found = neighbours.nearest(vectors, F.col("id") % 20 == 0).persist()
    share = neighbours.recall(found, vectors, list(range(0, 2000, 40)))
    assert 0.9 <= share < 1


@pytest.mark.parametrize("sigma", [0.5, 0.0])
def test_neighbours_of_varied_lengths(spark, sigma):
    """Nine tenths are found while the index prunes, whatever the lengths."""
    rng = np.random.default_rng(11)
    rows = rng.normal(size=(20000, 128))
    rows *= np.exp(sigma * rng.normal(size=(20000, 1))) / np.linalg.norm(rows, axis=1, keepdims=True)
    vectors = spark.createDataFrame(pa.table({"vec_id": np.arange(20000), "embedding": list(rows)})).persist()
    queries = list(range(0, 20000, 200))
    found = neighbours.nearest(vectors, F.col("id") % 200 == 0).persist()
    assert 0.9 <= neighbours.recall(found, vectors, queries) < 1


@pytest.mark.parametrize("posted", [1, 16])
def test_neighbours_outside_the_files(spark, monkeypatch, posted):
    """What the files of pivots would miss is in the common file, in one direction and its opposite too."""
    monkeypatch.setattr(neighbours, "LEAST_KEPT", 1)
    rng = np.random.default_rng(12)
    for size in (1, 24):
        rows = rng.normal(size=(1500, size)) * np.exp(rng.normal(size=(1500, 1)))
        vectors = spark.createDataFrame(pa.table({"vec_id": np.arange(1500), "embedding": list(rows)}))
        found = neighbours.nearest(vectors, F.col("id") % 20 == 0, posted=posted).persist()
        assert neighbours.recall(found, vectors, list(range(0, 1500, 20))) >= 0.9


def test_neighbours_ties_and_norms(spark):
    """Many equal vectors and different lengths: exact while all are kept."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 4)) * rng.uniform(0.1, 9, size=(30, 1))
    rows = [(i, base[i % 30 if i % 3 else 0].tolist()) for i in range(200)]
    got = {}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in neighbours.nearest(frame, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute_force(rows)


def test_neighbours_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [math.nan, 1.0]), (5, [1.0]),
            (6, [math.inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (20, []), (8, [-1.0, 0.0]), (40, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in
           neighbours.nearest(frame, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 40, 0.0), (0, 3, 8, -1.0), (40, 1, 1, 0.5), (40, 2, 0, 0.0), (40, 3, 8, 0.0)]
    assert neighbours.nearest(frame.where("false"), F.col("id") % 20 == 0).count() == 0
