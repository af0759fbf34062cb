"""Arrow batches of texts to word hashes with numpy, for operators that must look at every word.

Words are byte runs of UTF-8 text, so no text is decoded and no Python object is made per word. A word's hash
is a 64-bit polynomial over random byte values, read off prefix sums modulo 2**64, then mixed.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

_U = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=_U) | _U(1)
_STEP = _RNG.integers(1, 2**63, 64, dtype=_U) | _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)

#: Byte masks of the two kinds of words.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x80:] = ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

#: Bytes hashed at once; bounds the memory of the prefix sums.
PIECE = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    done = 1
    while done < n:
        step = _U(pow(base, done, 2**64))
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out


class _Powers:
    up = _powers(_BASE, 2)
    down = _powers(_INVERSE, 2)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(_INVERSE, n)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xA3B195354A39B70D)
    return h ^ (h >> _U(32))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts of an array, one after another, and their offsets; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = at if len(at) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]  # the buffer of a slice is that of its whole batch


class Words:
    """Words of a batch in order: `hash`, byte spans `start` and `end`, and `doc` offsets (documents + 1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word: np.ndarray):
        self.data = data
        starts, ends, hashes = [], [], []
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        at, stop = int(offsets[0]), int(offsets[-1])
        while at < stop:
            to = min(at + PIECE, stop)
            while to < stop and not edge[to] and word[data[to]]:  # a word never crosses a piece
                to += 1
            part = _LOWER[data[at:to]]
            inside = np.zeros(len(part) + 2, bool)
            inside[1:-1] = word[data[at:to]]
            first = inside[1:-1] & (~inside[:-2] | edge[at:to])
            last = inside[1:-1] & (~inside[2:] | edge[at + 1 : to + 1])
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            _Powers.reach(len(part) + 1)
            sums = np.zeros(len(part) + 1, _U)
            np.cumsum(_BYTE[part] * _Powers.up[: len(part)], out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * _Powers.down[s] + (e - s).astype(_U) * _STEP[63]))
            starts.append(s + at)
            ends.append(e + at)
            at = to
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.start, self.end, self.hash = join(starts, np.int64), join(ends, np.int64), join(hashes, _U)
        self.doc = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.doc)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of k words from each position on; the last k - 1 positions have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, _U(k * int(_STEP[62]) % 2**64), _U)
    for j in range(k):
        out += h[j : j + n] * _STEP[j]
    return mix(out)


def gram_starts(words: Words, k: int) -> np.ndarray:
    """Positions at which k words of one document begin."""
    ok = np.ones(len(words.hash), bool)
    for j in range(1, k):
        at = words.doc[1:] - j
        ok[at[at >= words.doc[:-1]]] = False
    return np.flatnonzero(ok)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, with offsets; fewer words than k are one shingle."""
    owner = words.owner()
    at = gram_starts(words, k)
    hashes, owners = [gram_hashes(words.hash, k)[at]], [owner[at]]
    for n in range(1, k):
        docs = np.flatnonzero(words.count == n)
        if len(docs):
            h = np.full(len(docs), _U(n * int(_STEP[62]) % 2**64), _U)
            for j in range(n):
                h += words.hash[words.doc[docs] + j] * _STEP[j]
            hashes.append(mix(h))
            owners.append(docs)
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.searchsorted(o, np.arange(len(words.count) + 1))


def slices(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of about `most_bytes` of text; a longer text is a run of its own."""
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    run = np.cumsum(size) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def release() -> None:
    """Give the memory that a task has freed back to the system: the worker may be idle next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Bytes of an Arrow batch, and Spark's own default for it.
BATCH_BYTES, _DEFAULT_BATCH = "4m", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES for the session, unless it has a limit of its own: rows may be long, and both the
    JVM and each Python worker hold whole batches."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == _DEFAULT_BATCH:
        spark.conf.set(name, BATCH_BYTES)


def without(columns: list[str], new: list[str]) -> list[str]:
    """The columns, each once, whose names aren't those of new ones; Spark takes upper and lower case as one."""
    gone = {c.lower() for c in new}
    return [c for c in dict.fromkeys(columns) if c.lower() not in gone]


def quoted(column: str) -> Column:
    """The column of exactly this name, dots and backquotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def map_texts(
    df: DataFrame,
    text: str,
    keep: list[str],
    out: str,
    make: Callable[[], Callable[[pa.RecordBatch], list]],
    most_bytes: int = 1_000_000,
) -> DataFrame:
    """`keep` columns and the columns of schema `out`, computed from runs of rows.

    `make()` is called once a task and returns a function from a batch (the kept columns, then the text) to the
    values of `out`. Names may clash: a kept column that is also in `out`, in either case, gives way to the new one.
    """
    small_batches(df.sparkSession)
    schema = StructType.fromDDL(out)
    keep = without(keep, schema.names)
    slim = df.select(
        *[quoted(c).alias(f"_k{i}") for i, c in enumerate(keep)],
        F.coalesce(quoted(text).cast("string"), F.lit("")).alias("_t"),
    )
    names = [f"_k{i}" for i in range(len(keep))] + schema.names
    kinds = schema.fields
    result = StructType([*slim.schema.fields[: len(keep)], *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [to_arrow_type(f.dataType) for f in kinds]
        work = make()
        for whole in batches:
            for batch in slices(whole, len(keep), most_bytes):
                made = [pa.array(v, t) if not isinstance(v, pa.Array) else v.cast(t) for v, t in zip(work(batch), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=names)
        del work
        release()

    done = slim.mapInArrow(run, result)
    return done.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f.name) for f in kinds])
