"""HTML extraction against a plain reading of marked pages and hand-made hard ones; top-k against brute force."""

import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica.llm import html_text, queries, topk


def test_pages_against_their_marked_article(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = {r["page_id"]: r for r in queries.op5_html_text(spark, sf).collect()}
    for page_id, page in pages.items():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", article)]
        assert found[page_id]["text"] == "\n".join(b for b in blocks if b)
        assert found[page_id]["n_chars"] == len(found[page_id]["text"])
    assert set(found) == set(pages)


WORDS = "It was the best of times and the worst of times for everyone who lived there."
HARD = [
    (None, ""),
    ("", ""),
    ("   \n ", ""),
    ("<nav><a href=x>Home</a> <a>News</a></nav><footer>Imprint and more</footer>", ""),
    (f"<div id=page><div class='top menu'><a>Home</a></div><div><h1>Title</h1><p>{WORDS}</p><p>{WORDS}</p><p>End.</p></div><div class=sidebar><p>{WORDS} {WORDS}</p></div></div>", f"Title\n{WORDS}\n{WORDS}\nEnd."),
    (f"<article><header><h1>A&amp;B &lt;3&gt; caf&eacute;</h1></header><p>{WORDS}</p><aside>See also this long list of other things</aside><div class='ad-box'>Buy now, buy it all today</div><p>a&nbsp; b<br>c</p><section id=comments><p>{WORDS}</p><article class=comment>Great post, thank you very much</article></section></article>", f"A&B <3> café\n{WORDS}\na b c"),
    (f"<main><form><label>Name</label><input></form><p>{WORDS}<script>var a = '<p>no</p>';</script></p><style>p{{}}</style><!-- <p>hidden</p> --><ul><li>one<li>two</ul><p hidden>gone</p><p style='display: none'>gone</p></main>", f"{WORDS}\none\ntwo"),
    (f"<body><header><p>Site name and slogan</p></header><p>{WORDS}</p><p>{WORDS}</p><footer><p>{WORDS}</p></footer>", f"{WORDS}\n{WORDS}"),
    (f"<p>{WORDS} 3 < 4 and <b>bold</b>er</p>", f"{WORDS} 3 < 4 and bolder"),
    ("<div role=banner><p>Cookies are used on this site for many purposes</p></div><article><p>Short.</p></article>", "Short."),
    (f"<div class=pageBody><div class='siteFooterLinks x'><p>{WORDS} {WORDS}</p></div><div id=topnav>{WORDS} {WORDS}</div><article class=post><p>{WORDS}</p></article></div>", WORDS),
    ("<script>" + "never closed ", ""),
    ("<p>" + "word " * 50_000 + "</p>", ("word " * 50_000).strip()),
]


@pytest.mark.parametrize("number", range(len(HARD)))
def test_hard_pages(number):
    page, wanted = HARD[number]
    assert (html_text.main_text(page, html_text.Weights()) if page else "") == wanted


def test_extract_odd_tables(spark):
    pages = spark.createDataFrame([(1, None, "u", "t", 5), (1, HARD[4][0], "u", "t", 5), (None, HARD[5][0], None, None, None), (1, HARD[4][0], "u", "t", 5)], "page_id long, html string, url string, text string, row int")
    found = html_text.extract(pages, html_text.learn_weights(pages)).select("row.page_id", "row.row", "text", "n_chars").collect()
    assert sorted(r["text"] for r in found) == sorted(["", HARD[4][1], HARD[4][1], HARD[5][1]])
    assert html_text.extract(pages.limit(0), html_text.learn_weights(pages.limit(0))).count() == 0


WRAPPED = [
    (f"<article class='post sponsored'><p>{WORDS}</p></article>", WORDS),
    (f"<div class='content has-sidebar'><p>{WORDS}</p></div>", WORDS),
    (f"<div id=page class=no-sidebar><p>{WORDS}</p></div>", WORDS),
    (f"<article class='post comments-open'><p>{WORDS}</p></article>", WORDS),
    (f"<div class='with-banner'><article><p>{WORDS}</p></article></div>", WORDS),
    (f"<body><form><h1>Title</h1><p>{WORDS}</p></form></body>", f"Title\n{WORDS}"),
    (f"<div class=banner><main><p>{WORDS}</p></main></div>", WORDS),
    (f"<main><p>{WORDS}</p><p class='notice-period'>Three months.</p><div class='social-history'>None known.</div></main>", f"{WORDS}\nThree months.\nNone known."),
    (f"<main><p>{WORDS}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold</p><noscript><p>Shown too.</p></noscript><object><p>And this.</p></object></main>", f"{WORDS}\nLet x=2 hold\nShown too.\nAnd this."),
    (f"<article><p>{WORDS}<svg class=icon/> More.</p><p>Last.</p></article>", f"{WORDS} More.\nLast."),
    (f"<article><div><svg><title>x</title><path></div><p>{WORDS}</p></article>", WORDS),
    (f"<article><p>{WORDS} <iframe src=x> never closed</p><p title='hidden gems'>Last.</p></article>", f"{WORDS} never closed\nLast."),
    (f"<div><p>{WORDS}</p></div><div class='comment-list'><p>{WORDS} {WORDS} {WORDS}</p><article class=comment><p>{WORDS} {WORDS} {WORDS} {WORDS}</p></article></div>", WORDS),
    (f"<article><p>{WORDS}</p><p title='a < b'>One.</p><div class='ad'>Buy now, buy it all today</div><p>End.</p></article><p>Other words at the end of it</p>", f"{WORDS}\nOne.\nEnd."),
]


@pytest.mark.parametrize("number", range(len(WRAPPED)))
def test_names_and_elements_are_evidence_and_no_veto(number):
    page, wanted = WRAPPED[number]
    assert html_text.main_text(page, html_text.Weights()) == wanted


@pytest.mark.parametrize("page", ["<div>x " * 100_000, "<!" * 500_000, "<b>" * 100_000 + "</i>" * 100_000, "<a b='" * 100_000, "<title>" * 100_000, "<p>" * 200_000, "<li><ul>" * 50_000 + "</p>" * 50_000, "<" * 300_000])
def test_parsing_is_linear(page):
    import time

    began = time.process_time()
    html_text.main_text(page, html_text.Weights())
    assert time.process_time() - began < 10


def test_weights_are_learned_from_marked_pages_however_few(spark):
    """One marked page among many that aren't: its kinds count."""
    marked = f"<section><article><section><p>{WORDS}</p></section></article><span>Out</span><span>Out</span></section>"
    pages = spark.createDataFrame([(i, f"<p>{WORDS}</p>") for i in range(300)] + [(1000 + i, marked) for i in range(20)], "page_id long, html string").repartition(3)
    learned, prior = html_text.learn_weights(pages, labelled=10_000), html_text.Weights()
    assert learned.tags["span"] < prior.tags["span"] and learned.tags["p"] > prior.tags["p"]
    few = html_text.learn_weights(pages, labelled=15)
    assert few.tags["span"] < prior.tags["span"]


def test_linear_scan_finds_the_best_region():
    rng = np.random.default_rng(8)
    for _ in range(200):
        score = [float(x) for x in rng.integers(-3, 4, rng.integers(1, 12))]
        best = max([0.0, *(sum(score[a : b + 1]) for a in range(len(score)) for b in range(a, len(score)))])
        first, last = html_text.best_region(score)
        assert sum(score[first : last + 1]) == best


def brute(rows, k, asks):
    ints = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    found = []
    for i, v in ints:
        if asks(i):
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in ints if j != i)
            found += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(found)


@pytest.mark.parametrize(("n", "scale"), [(0, 1.0), (1, 1.0), (12, 1.0), (700, 1.0), (700, 300.0)])
def test_top_k(spark, n, scale, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_ROWS", 150)
    monkeypatch.setattr(topk, "CHUNK_ROWS", 13)
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 16) * scale]) for i in range(n)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] if n > 100 else []  # ties
    if n:
        rows += [(2000, None), (2001, [None, 1.0]), (2002, [float("nan")]), (2003, [float("inf")]), (None, rows[0][1]), (2010, []), (2020, [1.0, -1.0]), (2040, [0.0] * 16)]
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in rows], "vec_id long, embedding array<float>, v string, grp int")
    found = topk.top_k(df, F.col("vec_id") % 20 == 0, 20)
    assert sorted(map(tuple, found.collect())) == brute(rows, 20, lambda i: i % 20 == 0)


def test_top_k_repeated_ids_and_large_components(spark):
    df = spark.createDataFrame([(20, [1.0]), (20, [1.0]), (7, [2.0]), (7, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") == 20, 5).collect())) == [(20, 1, 7, 8192)] * 2 + [(20, 2, 7, 8192)] * 2


def test_large_finite_components_take_part(spark):
    """Products past 2**62 go by whole numbers of any length, and past a bigint they count as the largest or smallest."""
    rows = [(0, [1e9, 1.0]), (1, [1e9, 2.0]), (2, [1e38, 0.0]), (3, [-1e38, 0.0]), (4, [0.5, 0.25]), (5, [3e7, -2e7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r[0], r[2]): (r[1], r[3]) for r in topk.top_k(df, F.col("vec_id") <= 4, 5).collect()}
    ints = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    for i in range(5):
        exact = {j: min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(ints[i], ints[j], strict=True)))) for j in ints if j != i}
        order = sorted(exact, key=lambda j: (-exact[j], j))
        assert {(i, j): (r + 1, exact[j]) for r, j in enumerate(order)} == {k: v for k, v in found.items() if k[0] == i}


def group_of(vectors):
    import pandas as pd

    rows = pd.DataFrame({"grp": 0, "vec_id": range(len(vectors)), "row_no": range(len(vectors)), "v": list(vectors.astype(float))})
    return topk._Group(next(topk._index(rows).itertuples()))


def test_segments_are_postings_and_stop_on_proof():
    """Vectors with a few large components: the first segments prove who can be a member; the others are not processed.
    Vectors without such a spread need all of them.  Zeros are in no list."""
    rng = np.random.default_rng(3)
    peaked = np.where(rng.random((600, 32)) < 0.1, rng.integers(-2000, 2000, (600, 32)), rng.integers(-1, 2, (600, 32)))
    flat = rng.integers(-3, 4, (600, 32))
    for vectors, stops in ((peaked, True), (flat, False)):
        group = group_of(vectors)
        assert sum(len(codes) for _, _, _, codes, _ in group.segments) == sum(int(x).bit_count() for x in np.abs(vectors).ravel())
        ids = np.arange(0, 600, 20)
        q, v, s = group.best(ids, vectors[ids].astype(float), 5)
        assert (group.processed < len(group.segments)) == stops
        for k, i in enumerate(ids):
            scores = vectors @ vectors[i]
            wanted = sorted((-int(scores[j]), j) for j in range(600) if j != i)[:5]
            assert [(-int(b), int(a)) for a, b in zip(v[q == k], s[q == k], strict=True)] == wanted


def test_wide_vectors_make_small_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART_BYTES", 8 * 64 * 10)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 64)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, 7).collect())) == brute(rows, 7, lambda i: i % 20 == 0)
