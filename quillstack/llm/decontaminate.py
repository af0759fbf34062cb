"""Benchmark decontamination by winnowing (operator 10).

Each document and each benchmark item keeps the smallest 5-word hash of every window of six. Any span of ten
shared words then shares a fingerprint, so documents that share none are clean; where one is shared, the hit is
extended by comparing the ten-word windows around it. The benchmark is a stated query set: it is read in blocks
of bounded size, and each block passes over all documents, as a job of its own whose broadcast is given back.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.textcore import ALNUM, Words, gram_hashes, gram_starts, map_texts, quoted, text_buffers, without
from quillstack.session import materialize, remove, table

#: Words of a window, of a gram, and grams of a winnowing window: SPAN = GRAM + WINDOW - 1.
SPAN, GRAM, WINDOW = 10, 5, 6
#: Benchmark text in one block; the driver and each Python worker hold one block's index.
BLOCK_BYTES = 8_000_000


class Index:
    """Sorted arrays of one block of items; words of an item with fewer than SPAN words are one window."""

    def __init__(self, items: list[tuple[str, str]]):
        self.ids = sorted({i for i, _ in items})
        number = {x: n for n, x in enumerate(self.ids)}
        words = Words(*text_buffers(pa.array([t or "" for _, t in items], pa.string())), ALNUM)
        owner = np.array([number[i] for i, _ in items], np.int64)[words.owner()] if items else np.zeros(0, np.int64)
        count = np.repeat(words.count, words.count)
        self.tables = {}
        for n in range(1, SPAN + 1):
            at = gram_starts(words, n)
            at = at[count[at] >= SPAN] if n == SPAN else at[count[at] == n]
            if len(at):
                h, o = gram_hashes(words.hash, n)[at], owner[at]
                order = np.lexsort((o, h))
                self.tables[n] = (h[order], o[order])
        at = winnowed(words)
        self.prints = np.unique(gram_hashes(words.hash, GRAM)[at])


def winnowed(words: Words) -> np.ndarray:
    """Positions of grams that are smallest in some window; windows that cross documents only add positions."""
    g = gram_hashes(words.hash, GRAM)
    n = len(g) - WINDOW + 1
    if n <= 0:
        return np.arange(len(g))
    least = g[:n].copy()
    for j in range(1, WINDOW):
        np.minimum(least, g[j : j + n], out=least)
    kept = np.zeros(len(g), bool)
    for j in range(WINDOW):
        kept[j : j + n] |= g[j : j + n] == least
    return np.flatnonzero(kept)


def _among(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _hits(words: Words, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, length and item of each window of the block that occurs in a document."""
    found = []
    for n, (hashes, owners) in index.tables.items():
        if n == SPAN:
            at = winnowed(words)
            at = at[_among(index.prints, gram_hashes(words.hash, GRAM)[at])] if len(at) else at
            at = np.unique((at[:, None] - np.arange(WINDOW)).ravel())
            whole = np.zeros(len(words.hash) + 1, bool)
            whole[gram_starts(words, n)] = True
            at = at[at >= 0]
            at = at[whole[at]]
            h = np.array([], np.uint64) if not len(at) else _grams_at(words.hash, at, n)
        else:
            at = gram_starts(words, n)
            h = gram_hashes(words.hash, n)[at] if len(at) else np.array([], np.uint64)
        if len(at):
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            hit = np.flatnonzero(hi > lo)
            times = (hi - lo)[hit]
            rank = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            found.append((np.repeat(at[hit], times), np.full(len(rank), n), owners[np.repeat(lo[hit], times) + rank]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _grams_at(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    rows = h[at[:, None] + np.arange(n)]
    return gram_hashes(np.ascontiguousarray(rows).ravel(), n)[::n]


def _spans(pos: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(pos.tolist(), (pos + length).tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _probe(index: Index):
    def work(batch: pa.RecordBatch) -> list:
        words = Words(*text_buffers(batch.column(batch.num_columns - 1)), ALNUM)
        pos, length, item = _hits(words, index)
        n = len(words.count)
        spans, items = [[] for _ in range(n)], [[] for _ in range(n)]
        doc = np.searchsorted(words.doc, pos, "right") - 1
        for d in np.unique(doc).tolist():
            mine = doc == d
            spans[d] = [{"start": a, "end": b} for a, b in _spans(pos[mine] - words.doc[d], length[mine])]
            items[d] = [index.ids[i] for i in np.unique(item[mine]).tolist()]
        return [words.count.astype(np.int64), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]

    return work


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None,
    item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`keep` columns (all by default) with n_words long, hit_spans array<struct<start, end>> and items array<string>.

    A span counts words, its end exclusive. Nulls, empty texts and texts without words have n_words 0 and no hits.
    A benchmark row without an id or without words matches nothing; rows that repeat an id are one item; an empty
    benchmark hits nothing. Repeated documents are judged each on its own, and texts of any length whole; an empty
    table stays empty. Columns of `docs` with the names of new ones, in either case, give way to them.
    """
    new = ("n_words", "hit_spans", "items")
    spans = "array<struct<start: long, end: long>>"
    out = f"n_words long, hit_spans {spans}, items array<string>"
    context = docs.sparkSession.sparkContext
    keep = without(docs.columns if keep is None else keep, new)
    bench = benchmark.select(quoted(item_id).cast("string").alias("i"), F.coalesce(quoted(item_text).cast("string"), F.lit("")).alias("t")).where("i is not null")
    size = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))

    def index(block: int):
        rows = bench.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).collect()  # at most about block_bytes
        return context.broadcast(Index([(r.i, r.t) for r in rows]))

    if blocks == 1:
        one = index(0)
        return map_texts(docs, text, keep, out, lambda: _probe(one.value))
    row = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)], F.lit(0).alias("_")).alias("row")
    rows = materialize(docs.select(row, quoted(text).alias("txt")), "rows").withColumn("at", F.monotonically_increasing_id())  # of files, so it stays the same
    found = []
    for b in range(blocks):
        part = index(b)
        hits = map_texts(rows, "txt", ["at"], out, lambda part=part: _probe(part.value))
        found.append(materialize(hits if b == 0 else hits.where(F.size("items") > 0), "hits"))  # the first has n_words of all
        part.destroy()
    hits = reduce(DataFrame.unionByName, found).groupBy("at").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hit_spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))
    hits = materialize(hits, "hits")
    remove(*found)
    joined = F.aggregate(
        F.array_sort("s"), F.array().cast(spans),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    return rows.join(hits, "at").select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], "n_words", joined.alias("hit_spans"), F.array_sort(F.array_distinct("i")).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]))
