"""Quality scores by nearest-neighbour voting in a latent semantic space (operator 7).

Terms are hashed words, hashed word shapes and repeats. A bounded sample of labelled rows gives term weights and, by
a truncated singular value decomposition, the space; its vectors and labels are broadcast. Every document meets all
of them in exact blocked cosine products, and the labels of its nearest vote by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.brown import remainder
from quillstack.llm.textcore import SPACED, Words, map_texts, mix, release, slices, small_batches, text_buffers
from quillstack.session import table

#: Labelled rows to learn from, at most; terms of words and of shapes; dimensions; neighbours; score of a 1.
SAMPLE, WORD_TERMS, SHAPE_TERMS, DIMENSIONS, NEIGHBOURS, THRESHOLD = 4096, 2048, 2048, 64, 25, 0.3
TERMS = WORD_TERMS + SHAPE_TERMS
#: Documents of one matrix product.
ROWS = 256
#: Text of one run; bounds the arrays of a word each.
RUN_BYTES = 500_000
_U = np.uint64
_CLASS = np.arange(256)  # letters by case and digits are classes; other bytes stand for themselves
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 0x61, 0x41, 0x30, 0x61


def _terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Document and term of each occurrence: each word gives its hash, and its shape together with whether it repeats."""
    if not len(words.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner, data, size = words.owner(), words.data, words.end - words.start
    kind = _CLASS[data]
    counts = [np.concatenate([[0], np.cumsum(kind == c)]) for c in (0x61, 0x41, 0x30)]
    lower, upper, digit = (c[words.end] - c[words.start] for c in counts)
    other = size - lower - upper - digit
    again = np.zeros(len(size), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (owner[1:] == owner[:-1])
    parts = (kind[words.start], kind[words.end - 1], kind[np.maximum(words.end - 2, words.start)], np.minimum(size, 15) // 3, lower > 0, np.minimum(upper, 2), digit > 0, np.minimum(other, 4), again)
    shape = np.zeros(len(size), _U)
    for p in parts:
        shape = shape * _U(263) + p.astype(_U)
    terms = np.concatenate([(words.hash % _U(WORD_TERMS)).astype(np.int64), WORD_TERMS + (mix(shape) % _U(SHAPE_TERMS)).astype(np.int64)])
    return np.concatenate([owner, owner]), terms


def _matrix(owner: np.ndarray, term: np.ndarray, first: int, rows: int) -> np.ndarray:
    mine = (owner >= first) & (owner < first + rows)
    x = np.bincount((owner[mine] - first) * TERMS + term[mine], minlength=rows * TERMS)
    return np.log1p(x.reshape(rows, TERMS).astype(np.float32))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def _weigh(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Both kinds of terms count alike."""
    x = x * weight
    return np.concatenate([_unit(x[:, :WORD_TERMS]), _unit(x[:, WORD_TERMS:])], 1)


@dataclass
class Space:
    """Term weights, the projection, and the labelled vectors (unit length) with their labels and mean label."""

    weight: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), self.prior)
        near = _unit(_weigh(x, self.weight) @ self.project) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        at = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < len(self.labels) else np.broadcast_to(np.arange(k), (len(x), k))
        vote = np.maximum(np.take_along_axis(near, at, 1), 0).astype(np.float64) ** 4
        return np.clip(((vote * self.labels[at]).sum(1) + 1e-6 * self.prior) / (vote.sum(1) + 1e-6), 0, 1)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1, RUN_BYTES):
            owner, term = _terms(Words(*text_buffers(batch.column(1)), SPACED))
            cell, n = np.unique(owner * TERMS + term, return_counts=True)
            ends = np.searchsorted(cell // TERMS, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (cell % TERMS, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["label", "term", "n"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Space:
    """The space of (key, text, label) rows. Of more than `sample` keys those with the smallest hashes are learnt from;
    labels other than 0 and 1 and null labels are left out; an empty table gives every text the score 0.5."""
    small_batches(labelled.sparkSession)
    rows = labelled.where("label in (0, 1)")
    keys = rows.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(sample)
    rows = rows.join(F.broadcast(keys), "key").select(F.col("label").cast("double"), F.coalesce("text", F.lit("")).alias("text"))  # `sample` keys at most
    seen = rows.mapInArrow(_sparse, "label double, term array<int>, n array<int>").toArrow()
    y = seen.column("label").to_numpy()
    if not len(y):
        return Space(np.zeros(TERMS, np.float32), np.zeros((TERMS, DIMENSIONS), np.float32), np.zeros((0, DIMENSIONS), np.float32), y, 0.5)
    lists = [seen.column(c).combine_chunks() for c in ("term", "n")]
    term, n = (x.flatten().to_numpy() for x in lists)
    row = np.repeat(np.arange(len(y)), np.diff(lists[0].offsets.to_numpy()))
    weight = np.log((1 + len(y)) / (1 + np.bincount(term, minlength=TERMS))).astype(np.float32) + 0.1
    value = np.log1p(n).astype(np.float32) * weight[term]
    half = 2 * row + (term >= WORD_TERMS)
    value /= np.maximum(np.sqrt(np.bincount(half, value * value, 2 * len(y))), 1e-9).astype(np.float32)[half]
    mark = np.bincount(row, value * np.random.default_rng(1).standard_normal(TERMS)[term], len(y))
    order = np.lexsort((mark, y))  # the same space whatever the order of the rows
    place = np.empty(len(y), np.int64)
    place[order] = np.arange(len(y))
    x, y = np.zeros((len(y), TERMS), np.float32), y[order]
    x[place[row], term] = value
    del seen, lists, term, n, row, value, half
    q = np.random.default_rng(0).standard_normal((TERMS, min(DIMENSIONS + 16, len(y)))).astype(np.float32)
    for _ in range(4):  # randomised subspace iteration
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    project = (q @ vt[:DIMENSIONS].T).astype(np.float32)
    space = Space(weight, project, _unit(x @ project), y, float(y.mean()))
    del x
    release()
    return space


def _score(space):
    def work(batch: pa.RecordBatch) -> list:
        owner, term = _terms(Words(*text_buffers(batch.column(batch.num_columns - 1)), SPACED))
        out = [space.value.scores(_matrix(owner, term, at, min(ROWS, batch.num_rows - at))) for at in range(0, batch.num_rows, ROWS)]
        return [np.concatenate(out)]

    return work


def score_quality(docs: DataFrame, space: Space, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (all by default) with score double. Texts without words (null, empty) get the mean label; equal
    texts have equal scores, and texts of any length count whole; of equally near neighbours any may vote. An empty
    table stays empty. A column named score, in either case, gives way to the new one."""
    held = docs.sparkSession.sparkContext.broadcast(space)  # at most SAMPLE vectors
    return map_texts(docs, text, list(docs.columns if keep is None else keep), "score double", lambda: _score(held), RUN_BYTES)


def training_rows(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """(key, text, label) of the labelled documents that aren't held out."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0).select(F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    keys = labels.where("key is not null and label in (0, 1)").select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(SAMPLE)
    labels = labels.join(F.broadcast(keys), "key")
    return docs.select(F.col("doc_id").alias("key"), "text").join(F.broadcast(labels), "key")  # SAMPLE keys


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), fit(training_rows(spark, sf_dir)), keep=["doc_id"])
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
