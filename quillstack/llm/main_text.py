"""Main text of web pages: boosted trees over block nodes and joint decoding (operator 4).

Pages have no labels, so the trees learn from made pages of many layouts, whose article is known, and from a bounded
sample of the given pages, where <article> and <main> and the elements that never belong to one say what is what.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.boosting import Trees, fit_trees
from quillstack.llm.dom import FEATURES, Page
from quillstack.llm.dom import table as features
from quillstack.llm.textcore import map_texts
from quillstack.session import table

#: Made pages and pages of the table that the trees learn from, at most.
MADE, SAMPLE = 900, 100
_NEVER = frozenset("nav header footer aside form".split())


class _Maker:
    """Pages of random layouts. The article's elements carry data-k="1", everything else in them or around 0."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice("aeiou") + r.choice("bcdfglmnprst") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def prose(self, low: int = 1, high: int = 6) -> str:
        text = " ".join(self.words(3, 22).capitalize() + self.r.choice(".....?!") for _ in range(self.r.randint(low, high)))
        return text.replace(" ", ' <a href="/x">link</a> ', 1) if self.r.random() < 0.12 else text

    def wrap(self, inner: str, tags: str, names: str) -> str:
        r = self.r
        tag = r.choice(tags.split())
        name = "" if r.random() < 0.25 else f' {r.choice(["class", "class", "id"])}="{r.choice(names.split())}{r.choice(["", "", "-1", " box", " wide"])}"'
        inner = f"<div>{inner}</div>" if r.random() < 0.2 else inner
        return f"<{tag}{name}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/p">{self.words(1, 4)}</a>' for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; "]).join(items)

    def apart(self, kind: str) -> str:
        r = self.r
        p = lambda low=1, high=2: f"<p>{self.prose(low, high)}</p>" if r.random() < 0.7 else self.prose(low, high)
        if kind == "nav":
            return self.wrap(self.links(3, 9), "nav nav div ul", "nav menu navbar main-menu breadcrumbs pagination")
        if kind == "top":
            return self.wrap(f"<h1>{self.words(1, 4)}</h1>" * r.randint(0, 1) + p() + self.links(2, 5) * r.randint(0, 1), "header header div", "header masthead site-header banner topbar")
        if kind == "foot":
            return self.wrap(f"&copy; {self.words(1, 3)} &middot; {self.prose(1, 2)}" + self.links(2, 5) * r.randint(0, 1), "footer footer div", "footer site-footer colophon copyright")
        if kind == "side":
            return self.wrap(f"<h3>{self.words(1, 3)}</h3>" + self.links(2, 7) + p() * r.randint(0, 2), "aside aside div section", "sidebar widget related-posts side recommended")
        if kind == "ad":
            return self.wrap(p(), "div div aside p section", "ad ads advert sponsored promo ad-slot")
        if kind == "notice":
            return self.wrap(p() + "<button>OK</button>" * r.randint(0, 1), "div div section aside p", "cookie-notice notice alert consent gdpr-banner")
        if kind == "form":
            return self.wrap(f"<form><label>{self.words(1, 3)}</label><input name=q>" + p() * r.randint(0, 1) + f"<button>{self.words(1, 1)}</button></form>", "div div section", "subscribe newsletter search-box signup")
        if kind == "share":
            return self.wrap(self.links(2, 5), "div div ul", "share social tags post-meta")
        talk = "".join(self.wrap(f"<h4>{self.words(1, 2)}</h4>" * r.randint(0, 1) + "".join(f"<p>{self.prose(1, 4)}</p>" for _ in range(r.randint(1, 2))), "div li article", "comment reply comment-body") for _ in range(r.randint(1, 7)))
        return self.wrap(f"<h3>{self.words(1, 2)}</h3>" * r.randint(0, 1) + talk, "section div div ol", "comments discussion comment-list responses")

    def block(self) -> str:
        r = self.r.random()
        if r < 0.74:
            return f'<p data-k="1">{self.prose(1, self.r.choice([1, 1, 3, 8]))}</p>'
        if r < 0.82:
            return f'<h{self.r.choice("2233")} data-k="1">{self.words(1, 8)}</h2>'.replace("</h2>", "")
        if r < 0.90:
            return '<ul data-k="1">' + "".join(f'<li data-k="1">{self.prose(1, 2)}</li>' for _ in range(self.r.randint(2, 6))) + "</ul>"
        if r < 0.94:
            return f'<blockquote data-k="1"><p data-k="1">{self.prose()}</p></blockquote>'
        if r < 0.97:
            return '<table data-k="1">' + "".join(f'<tr data-k="1"><td data-k="1">{self.words(1, 3)}</td><td data-k="1">{self.words(1, 3)}</td></tr>' for _ in range(3)) + "</table>"
        return f'<pre data-k="1">{self.prose()}</pre>'

    def page(self) -> str:
        r = self.r
        blocks = [f'<h1 data-k="1">{self.words(2, 9)}</h1>'] * (r.random() < 0.8) + [self.block() for _ in range(r.choice([1, 2, 4, 8, 15]))]
        for kind in r.sample(["ad", "side", "share", "form", "talk", "notice"], r.choice([0, 0, 0, 1, 2])):
            blocks.insert(len(blocks) if kind == "talk" else r.randint(1, len(blocks)), self.apart(kind))
        tag = r.choice("article article main div div section".split())
        name = r.choice(["", f' class="{r.choice("article-body content post entry story post-content text main".split())}"', f' id="{r.choice("content main article".split())}"'])
        article = f'<{tag}{name} data-k="1">' + "".join(blocks) + f"</{tag}>"
        around = lambda kinds, share: [self.apart(k) for k in kinds if r.random() < share]
        parts = [*around(["notice", "top", "nav", "ad", "form"], 0.45), article, *around(["share", "talk", "side", "ad", "form"], 0.4), *around(["nav", "notice"], 0.15), *around(["foot"], 0.8)]
        at = parts.index(article)
        if r.random() < 0.25:
            parts.insert(at, self.apart("side"))
            at += 1
        if r.random() < 0.3:
            a, b = r.randint(max(0, at - 1), at), r.randint(at + 1, min(len(parts), at + 3))
            parts[a:b] = ['<div class="wrapper" data-k="1">' + "".join(parts[a:b]) + "</div>"]
        page = "<!DOCTYPE html><html><head><title>" + self.words(2, 6) + "</title></head><body>" + "".join(parts)
        return page + "</body></html>" if r.random() < 0.9 else page[: r.randint(len(page) * 4 // 5, len(page))]


class _Labelled(Page):
    """A page that remembers which nodes carry data-k."""

    def _start(self, name: str, attributes: str) -> None:
        before = len(self.tag)
        super()._start(name, attributes.replace(' data-k="1"', ""))
        if 'data-k="1"' in attributes and len(self.tag) > before and self.tag[-1] == name:
            self.marked.add(len(self.tag) - 1)

    def __init__(self, source: str):
        self.marked: set[int] = set()
        super().__init__(source)

    def labels(self, given: bool) -> np.ndarray:
        """given: by <article> and <main>, else by the marks. Text and what holds the article are as their place."""
        y = np.zeros(len(self.tag))
        for i in range(1, len(self.tag)):
            if given:
                y[i] = self.tag[i] in ("article", "main") or (y[self.parent[i]] and self.tag[i] not in _NEVER and not self.words[i] & ~1)
            else:
                y[i] = i in self.marked or (self.tag[i] == "#run" and self.parent[i] in self.marked)
        for i in range(len(self.tag) - 1, 0, -1):
            y[self.parent[i]] = max(y[self.parent[i]], y[i])
        return y


def fit(pages: DataFrame, source: str = "html", made: int = MADE, sample: int = SAMPLE) -> Trees:
    """Trees of made pages and of `sample` given pages, those with the smallest hashes."""
    maker = _Maker(11)
    read = [(_Labelled(maker.page()), False) for _ in range(made)]
    hashed = pages.where(F.length(source) > 0).select(F.xxhash64(source).alias("h"), F.col(source).alias("page"))
    some = hashed.join(F.broadcast(hashed.select("h").distinct().orderBy("h").limit(sample)), "h")  # `sample` hashes
    some = [r.page for r in some.groupBy("h").agg(F.min("page").alias("page")).orderBy("h").collect()]  # and pages
    read += [(page, True) for r in some if "article" in (page := _Labelled(r)).tag or "main" in page.tag]
    x = features([row for page, _ in read for row in page.rows()])
    y = np.concatenate([page.labels(given) for page, given in read]) if read else np.zeros(0)
    return fit_trees(x, y) if len(y) else fit_trees(np.zeros((0, FEATURES), np.float32), y)


def main_text(source: str | None, trees: Trees) -> str:
    return _extract([source or ""], trees)[0]


def _extract(sources: list[str], trees: Trees) -> list[str]:
    pages = [Page(s) for s in sources]
    rows = [p.rows() for p in pages]
    score = trees.log_odds(features([row for r in rows for row in r]))
    ends = np.cumsum([len(r) for r in rows])[:-1]
    return ["\n\n".join(p.blocks(p.kept(s))) for p, s in zip(pages, np.split(score, ends), strict=True)]


def extract_main_text(pages: DataFrame, trees: Trees, source: str = "html", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (all by default) with text string: kept blocks in page order, two line breaks between.

    Character references are decoded and white space within a block is one space. Null and empty pages, and pages
    without an article, have an empty text. Pages that repeat have equal texts; pages
    of any length are read whole; of equal labellings the first one found counts; an empty table stays empty. A column
    named text, in either case, gives way.
    """
    held = pages.sparkSession.sparkContext.broadcast(trees)

    def work(batch: pa.RecordBatch) -> list:
        return [_extract(batch.column(batch.num_columns - 1).to_pylist(), held.value)]

    return map_texts(pages, source, list(pages.columns if keep is None else keep), "text string", lambda: work, 1_000_000)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = extract_main_text(pages, fit(pages), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
