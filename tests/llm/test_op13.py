"""Importance resampling against a plain computation."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstack.llm import importance as I

SCHEMA = "doc_id long, text string"


def features(text, least=1, most=1):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    return len(w), [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, buckets=10_000, least=1, most=1, least_words=20, percent=10):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    read = [(i, *features(t, least, most)) for i, t in rows]
    s = Counter(at(f) for *_, fs in read for f in fs)
    t = Counter(at(f) for x in target for f in features(x, least, most)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for i, n, fs in read:
        weight = sum(gain[at(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    able = sorted((r for r in out if r[4] >= least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = {id(r): k for k, r in enumerate(able[: len(able) * percent // 100], 1)}
    return sorted(((*r[:4], drawn.get(id(r))) for r in out), key=repr)


def made(n):
    word = lambda k: f"w{k * k % 97}"
    return [(i, " ".join(word(i * j + j) for j in range(1, 3 + i % 60)) + (" Ünïcode_x" if i % 3 else " A-B.c")) for i in range(n)]


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"least": 1, "most": 3, "buckets": 50, "percent": 33}, {"least": 2, "most": 2, "least_words": 0, "percent": 100}])
def test_all_rows(spark, options):
    rows, target = [*made(300), (None, None), (1000, ""), (1001, "one"), (None, "w1 " * 30)], ["w1 w4 w9 w16", "Ünïcode x", None, ""]
    out = I.resample(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(t,) for t in target], "text string"), **options)
    assert got(out) == brute(rows, target, **options)
    assert sum(r[4] is not None for r in got(out)) > 5


def test_ties_and_repeated_rows(spark):
    text = " ".join(["same"] * 25)
    rows = [(7, text)] * 40 + [(8, text)] * 10
    out = I.resample(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "text string"), percent=50).collect()
    assert sorted(r.rank for r in out if r.rank) == list(range(1, 26)) and len(out) == 50 and len({r.score for r in out}) == 2
    first = next(r.doc_id for r in out if r.rank == 1)
    assert {r.doc_id for r in out if r.rank} == {first} if first == 7 else {r.doc_id for r in out if r.rank} == {7, 8}


def test_empty_tables_clashes_and_long_texts(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert I.resample(none, none).collect() == []
    df = spark.createDataFrame([(1, "x " * 300_000, "kept", 3), (2, "y", "too", 4)], SCHEMA + ", `a.b` string, RANK int")
    out = I.resample(df, none, percent=100)
    assert out.columns == ["doc_id", "text", "a.b", "n_features", "weight", "score", "rank"]
    assert sorted((r.doc_id, r["a.b"], r.n_features, r.rank) for r in out.collect()) == [(1, "kept", 300_000, 1), (2, "too", 1, None)]


def test_places_are_one_order(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("v"))
    rows = sorted(I.ranked(df.repartition(7), F.desc("v"), F.asc("id")).collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(1, 5001)) and [(r.v, r.id) for r in rows] == sorted(((r.v, r.id) for r in rows), key=lambda x: (-x[0], x[1]))
