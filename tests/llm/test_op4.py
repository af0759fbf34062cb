import html
import re

import numpy as np
import pytest

from quillstack.llm.boosting import fit_trees
from quillstack.llm.dom import Page, table
from quillstack.llm.main_text import _Labelled, _Maker, extract_main_text, fit, main_text, op4_main_text

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trees(spark):
    return fit(spark.read.parquet(f"{SF}/pages.parquet"))


def plain(s):
    """The article of the test pages, which hold nothing but headings and paragraphs."""
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", s, re.S)
    blocks = re.split(r"</?(?:p|h1)\b[^>]*>", re.sub(r"<[a-zA-Z/][^<>]*\Z", "", m[1]))
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
    return "\n\n".join(b for b in blocks if b)


def test_all_pages_against_brute_force(spark):
    got = {r.page_id: r for r in op4_main_text(spark, SF).collect()}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        r = got.pop(p.page_id)
        assert (r.url, r.text, r.n_chars) == (p.url, plain(p.html), len(plain(p.html)))
    assert not got


def test_held_out_layouts(trees):
    maker, right, extra, missing, blocks = _Maker(4242), 0, 0, 0, 0
    for _ in range(200):
        page = _Labelled(maker.page())
        want, got = page.blocks(page.labels(False) > 0), page.blocks(page.kept(trees.log_odds(table(page.rows()))))
        right += got == want
        blocks += len(want)
        extra += sum(b not in want for b in got)
        missing += sum(b not in got for b in want)
    print(right, blocks, extra, missing)
    assert right > 120 and extra < 0.15 * blocks and missing < 0.06 * blocks


def test_a_page_of_another_kind(trees):
    body = "".join(f"<p>Sentence {i} of the story, with words enough. It goes on &amp; on,\n and ends&#33;</p>" for i in range(6))
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body>
    <header class="site-header"><h1>Site</h1><nav><a href="/">Home</a> <a href="/a">About</a></nav></header>
    <div class="cookie-notice"><p>We use cookies. Please accept them.</p></div>
    <div id="content"><h1>Title here</h1>{body}<script>if (a < b) x("</p>")</script></div>
    <aside class="sidebar"><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></aside>
    <div class="comments"><h3>Comments</h3><div class="comment"><p>Great story, thanks!</p></div></div>
    <form><label>Mail</label><input name=m></form><footer>&copy; Site</footer></body></html>"""
    want = ["Title here", *[f"Sentence {i} of the story, with words enough. It goes on & on, and ends!" for i in range(6)]]
    assert main_text(page, trees) == "\n\n".join(want)


def test_edges(spark, trees):
    texts = [None, "", "<", "<p", "a < b", "<!-- never closed", "<script>never closed", "<div>" * 3000 + "deep", "<p>" + "x " * 300_000, '<p class="a>b">t', "<nav><a href=x>a</a></nav>", "<p>a<p>a"]
    d = spark.createDataFrame([(i, "u", t, 1) for i, t in enumerate(texts)], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in extract_main_text(d, trees).collect()}
    assert len(got) == len(texts) and all(isinstance(t, str) for t in got.values())
    assert got[0] == got[1] == got[3] == got[5] == got[6] == got[10] == ""
    assert extract_main_text(d.limit(0), trees).collect() == []
    none = fit(d.limit(0))
    assert none.log_odds(np.zeros((2, 91), np.float32)).shape == (2,)


def test_decoding_is_the_best_consistent_labelling():
    r = np.random.default_rng(5)
    for _ in range(50):
        page = Page("<div><p>a</p><div><p>b</p>c</div></div><p>d</p>")
        n = len(page.tag)
        score = r.normal(0, 2, n)
        like = lambda y: -np.logaddexp(0, np.where(y, -score, score)).sum()  # noqa: E731,B023
        best = -np.inf
        for code in range(2**n):
            y = np.array([code >> i & 1 for i in range(n)], bool)
            if all(y[page.parent[i]] or not y[i] for i in range(1, n)):
                best = max(best, like(y))
        got = page.kept(score)
        assert abs(like(got) - best) < 1e-9 and all(got[page.parent[i]] or not got[i] for i in range(1, n))


def test_boosting_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = fit_trees(x[:2000], y[:2000])
    assert ((trees.log_odds(x[2000:]) > 0) == y[2000:]).mean() > 0.95
