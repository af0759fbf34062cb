"""Line deduplication with a sharded minimal perfect hash (operator 6).

The key hashes of all lines are counted by document; keys of two documents or more go, by hash, to shards of
bounded size. Each shard gets a minimal perfect hash (levels of collision-free bits, indexed by rank) over arrays
of fingerprints, document counts and smallest ids. Documents then look their lines up in the arrays: lines are
never joined. Arrays are broadcast in passes of at most `broadcast_bytes`. Each pass is a job of its own that writes
the numbers of dropped lines and gives its broadcast back, so one pass's arrays are held at a time.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.textcore import map_texts, mix, quoted, without
from quillstack.session import materialize, remove, table

#: Line keys of fewer code points are never dropped.
LEAST_CHARS = 10
#: Keys of a shard, about; arrays broadcast at once.
SHARD_KEYS, BROADCAST_BYTES = 50_000, 64_000_000
_GAP = " \t\n\x0b\x0c\r"
_U = np.uint64
#: Stands for the first id of a key that no two documents have.
_NEVER = np.iinfo(np.int64).max
_ARRAYS = ("sizes", "bits", "rest", "prints", "counts", "first", "twins")
#: Bits a key of a level, and levels before the rest is kept as a sorted list.
_ROOM, _LEVELS = 2, 24


def line_hash(line: str) -> tuple[int, int] | None:
    """128 bits of the line's key, or None for a short one."""
    key = line.strip(_GAP)
    if len(key) < LEAST_CHARS:
        return None
    h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass").lower())
    return h & (2**64 - 1), h >> 64


def _slot(lo: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(lo + _U((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % _U(size)).astype(np.int64)


class MinimalHash:
    """Levels of bits that one key alone sets, and the sorted rest; a key's number is its bit's rank over all levels."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks = [np.cumsum(bits, dtype=np.int64) - 1 for bits in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalHash:
        levels, left = [], np.unique(keys)
        while len(left) and len(levels) < _LEVELS:
            size = max(8, _ROOM * len(left))
            at = _slot(left, len(levels), size)
            levels.append(np.bincount(at, minlength=size) == 1)
            left = left[~levels[-1][at]]
        return cls(levels, left)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; for any other value some number or -1, so that the fingerprint decides."""
        out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for k, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = _slot(keys[left], k, len(bits))
            hit = bits[at]
            out[left[hit]] = base + rank[at[hit]]
            left, base = left[~hit], base + int(rank[-1]) + 1
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            known = self.rest[at] == keys[left]
            out[left[known]] = base + at[known]
        return out


class Shard:
    """The arrays of one shard, ready to be looked up."""

    def __init__(self, row):
        sizes = np.frombuffer(row.sizes, np.int64)
        bits = np.unpackbits(np.frombuffer(row.bits, np.uint8))[: sizes.sum()].astype(bool)
        self.hash = MinimalHash(np.split(bits, np.cumsum(sizes)[:-1]) if len(sizes) else [], np.frombuffer(row.rest, _U))
        self.prints, self.first = np.frombuffer(row.prints, _U), np.frombuffer(row.first, np.int64)
        twins = np.frombuffer(row.twins, np.int64).reshape(-1, 3)
        self.twins = {(int(a), int(b)): int(c) for a, b, c in twins}
        self.twin_lo = np.unique(twins[:, 0]).view(_U)

    def look_up(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest id that holds each key, or the largest long for a key of one document."""
        number = self.hash.number(lo)
        known = number >= 0
        known[known] = self.prints[number[known]] == hi[known]
        first = np.full(len(lo), _NEVER)
        first[known] = self.first[number[known]]
        if len(self.twins):
            for i in np.flatnonzero(np.isin(lo, self.twin_lo)).tolist():
                first[i] = self.twins.get((int(lo[i].view(np.int64)), int(hi[i].view(np.int64))), _NEVER)
        return first


def _pack(keys: pd.DataFrame) -> pd.DataFrame:
    """Arrays of a shard. Keys that share their low halves (`twins`) are kept whole, beside the minimal hash."""
    shard, twin = int(keys.shard.iloc[0]), keys.duplicated("lo", keep=False)
    twins, keys = keys[twin], keys[~twin]
    lo = keys.lo.to_numpy().view(_U)
    found = MinimalHash.build(lo)
    order = np.argsort(found.number(lo))
    array = lambda name: keys[name].to_numpy()[order].astype(np.int64).tobytes()
    bits = np.concatenate([np.zeros(0, bool), *found.levels])
    return pd.DataFrame([{
        "shard": shard, "sizes": np.array([len(x) for x in found.levels], np.int64).tobytes(), "bits": np.packbits(bits).tobytes(),
        "rest": found.rest.tobytes(), "prints": array("hi"), "counts": array("n"), "first": array("first"),
        "twins": np.ascontiguousarray(twins[["lo", "hi", "first"]].to_numpy(np.int64)).tobytes(),
    }])


def line_keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, lo, hi) once for each document row and key of LEAST_CHARS code points or more."""
    slim = map_texts(docs.select(quoted(doc_id).cast("long").alias("doc"), quoted(text).alias("txt")), "txt", ["doc"], "keys array<struct<lo: long, hi: long>>", lambda: _keys)
    return slim.select("doc", F.explode("keys").alias("k")).select("doc", "k.lo", "k.hi")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _keys(batch: pa.RecordBatch) -> list:
    out = []
    for t in batch.column(batch.num_columns - 1).to_pylist():
        found = {h for line in t.split("\n") if (h := line_hash(line))}
        out.append([{"lo": _signed(a), "hi": _signed(b)} for a, b in found])
    return [out]


def line_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """A row of packed arrays for each shard, and the number of shards. Counting combines before the shuffle."""
    counted = line_keys(docs, doc_id, text).groupBy("lo", "hi").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"))
    repeated = materialize(counted.where("first < last").select("lo", "hi", "first", "n"), "lines")
    shards = max(1, -(-repeated.count() // shard_keys))
    out = "shard long, " + ", ".join(f"{x} binary" for x in _ARRAYS)
    packed = repeated.withColumn("shard", F.pmod(F.col("lo"), F.lit(shards))).groupBy("shard").applyInPandas(_pack, out)
    packed = materialize(packed, "line_shards")
    remove(repeated)
    return packed, shards


class Lookup:
    """Some shards of the index, for lines of any shard; lines of absent shards count as unknown."""

    def __init__(self, rows: list, shards: int):
        self.rows, self.shards, self.open = {r.shard: r for r in rows}, shards, {}

    def first(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.full(len(lo), _NEVER)
        if not len(lo):
            return out
        shard = np.mod(lo.view(np.int64), self.shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for at in np.split(order, cuts):
            s = int(shard[at[0]])
            if s in self.rows:
                if s not in self.open:
                    self.open[s] = Shard(self.rows[s])
                out[at] = self.open[s].look_up(lo[at], hi[at])
        return out


def _drop(lookup: Lookup, lines: bool):
    """lines: return the kept text, else only the numbers of dropped lines."""

    def work(batch: pa.RecordBatch) -> list:
        ids, texts = batch.column(0).to_pylist(), [t.split("\n") for t in batch.column(batch.num_columns - 1).to_pylist()]
        at, lo, hi = [], [], []
        for d, ls in enumerate(texts):
            for n, line in enumerate(ls):
                if h := line_hash(line):
                    at.append((d, n))
                    lo.append(h[0])
                    hi.append(h[1])
        first = lookup.first(np.array(lo, _U), np.array(hi, _U)).tolist()
        dropped: list[set[int]] = [set() for _ in texts]
        for (d, n), f in zip(at, first, strict=True):
            if f < _NEVER and (ids[d] is None or ids[d] > f):
                dropped[d].add(n)
        if not lines:
            return [[sorted(x) for x in dropped]]
        kept = ["\n".join(x for n, x in enumerate(ls) if n not in gone) for ls, gone in zip(texts, dropped, strict=True)]
        return [kept, [len(x) for x in texts], [len(x) for x in dropped]]

    return work


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None,
    shard_keys: int = SHARD_KEYS, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """`keep` columns (all by default) with kept_text string, n_lines long and n_dropped long.

    A line goes if its key (outer white space stripped, A-Z lower-cased, ten code points or more) is held by
    another document of smaller id. A null or empty text is one empty line; when every line goes the kept text is
    empty. Rows that share an id are one document; a row without an id holds nothing and loses every repeated
    line. Repeated lines in the smallest document stay. Lines and texts of any length count whole; an empty table
    stays empty. Columns named as new ones, in either case, give way to them.
    """
    spark = docs.sparkSession
    keep = without(docs.columns if keep is None else keep, ["kept_text", "n_lines", "n_dropped"])
    index, shards = line_index(docs, doc_id, text, shard_keys)
    size = index.agg(F.sum(sum(F.octet_length(c) for c in _ARRAYS))).first()[0] or 0
    passes = max(1, -(-size // broadcast_bytes))
    row = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)], F.lit(0).alias("_")).alias("row")
    rows = docs.select(quoted(doc_id).cast("long").alias("id"), row, quoted(text).cast("string").alias("txt"))
    kept = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)]
    if passes == 1:
        lookup = spark.sparkContext.broadcast(Lookup(index.collect(), shards))  # at most broadcast_bytes
        remove(index)
        done = map_texts(rows, "txt", ["id", "row"], "kept_text string, n_lines long, n_dropped long", lambda: _drop(lookup.value, True))
        return done.select(*kept, "kept_text", "n_lines", "n_dropped")
    rows = materialize(rows, "rows").withColumn("at", F.monotonically_increasing_id())  # of files, so it stays the same
    gone = []
    for p in range(passes):
        lookup = spark.sparkContext.broadcast(Lookup(index.where(F.pmod(F.col("shard"), F.lit(passes)) == p).collect(), shards))
        found = map_texts(rows, "txt", ["id", "at"], "gone array<long>", lambda lookup=lookup: _drop(lookup.value, False))
        gone.append(materialize(found.where(F.size("gone") > 0).select("at", "gone"), "gone"))
        lookup.destroy()
    remove(index)
    all_gone = reduce(DataFrame.unionByName, gone).groupBy("at").agg(F.flatten(F.collect_list("gone")).alias("gone"))  # a list for each pass
    held = rows.join(materialize(all_gone, "gone"), "at", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<long>")))
    remove(*gone)
    lines = F.split(F.coalesce("txt", F.lit("")), "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("gone"), i.cast("long"))), "\n")
    return held.select(*kept, left.alias("kept_text"), F.size(lines).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
