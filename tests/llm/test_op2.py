import hashlib
import re

from pyspark.sql import functions as F

from quillstack.llm.fingerprints import K, containment, decode, distinct_shingles, encode, fingerprint_edits, merge, merge_groups, op2_fingerprints, resemblance, sketch, with_next

SF = "/root/testdata/sf0.01"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edits(rows):
    rows = sorted(rows, key=lambda x: -x[0])
    for i, (d, t) in enumerate(rows):
        t, follow = t or "", rows[(i + 1) % len(rows)][1] or ""
        h = len(t) // 2
        yield d, t, follow, t[: len(t) - h] + follow[:h]


def test_all_documents_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in op2_fingerprints(spark, SF).collect()}
    off = []
    prints = {}
    for d, t, follow, edited in edits(rows):
        r = got.pop(d)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r.fingerprint) == 13 * min(K, len(shingles(t)))
        off += [r.near_edited - jaccard(t, edited), r.near_next - jaccard(t, follow)]
        if len(shingles(t)) < K and len(shingles(edited)) < K:
            assert abs(off[-2]) < 1e-12
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        prints.setdefault(edited, r.edited_fingerprint)
    assert not got and max(map(abs, off)) < 0.2 and sum(map(abs, off)) / len(off) < 0.02


def test_edges(spark):
    rows = [(10, None), (7, ""), (5, "One two"), (4, "ONE  two"), (3, "🙂é" * 5), (2, "a b c d e f g"), (-9, "w " * 30_000 + "end")]
    d = spark.createDataFrame([(*r, 3, "s") for r in rows], "doc_id long, text string, n_chars int, sketch string")
    got = {r.doc_id: r for r in fingerprint_edits(d).collect()}
    for i, t, follow, edited in edits(rows):
        r = got[i]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.near_edited, r.near_next) == (jaccard(t, edited), jaccard(t, follow))
    assert fingerprint_edits(d.limit(0)).collect() == []
    more = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (None, None)], "doc_id long, text string")
    assert fingerprint_edits(more).count() == 4
    one = fingerprint_edits(more.limit(1)).first()
    assert one.near_next == 1.0


def test_next_over_many_ranges(spark):
    ids = [i * i % 100_003 - 50_000 for i in range(2000)]
    d = spark.createDataFrame([(i, str(i)) for i in set(ids)], "doc_id long, text string")
    order = sorted(set(ids), reverse=True)
    for ranges in (1, 7, 512):
        got = {r.doc_id: int(r.next_text) for r in with_next(d, "doc_id", "text", ranges=ranges).collect()}
        assert got == {a: b for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    none = d.unionByName(spark.createDataFrame([(None, f"none {i}") for i in range(500)], "doc_id long, text string"))
    for ranges in (1, 7, 512):  # rows without ids follow the last, each once, and the last of them is followed by the first
        follow = {r.text: r.next_text for r in with_next(none, "doc_id", "text", ranges=ranges).collect()}
        at, seen = str(order[0]), []
        for _ in follow:
            seen.append(at)
            at = follow[at]
        assert at == seen[0] and seen[: len(order)] == list(map(str, order)) and len(set(seen)) == len(order) + 500


def test_sketches_merge_and_estimate(spark):
    texts = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 900), (600, 1500), (0, 60), (30, 90), (0, 30))]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", sketch(F.col("t")).alias("s"))
    s = {r.i: r.s for r in d.collect()}
    row = d.groupBy().agg(F.max(F.when(F.col("i") == 0, F.col("s"))).alias("a"), F.max(F.when(F.col("i") == 1, F.col("s"))).alias("b"), F.max(F.when(F.col("i") == 2, F.col("s"))).alias("c"), F.max(F.when(F.col("i") == 3, F.col("s"))).alias("d"), F.max(F.when(F.col("i") == 4, F.col("s"))).alias("e"))
    r = row.select(
        resemblance(F.col("a"), F.col("b")).alias("ab"), distinct_shingles(F.col("a")).alias("na"), containment(F.col("a"), F.col("b")).alias("cab"),
        resemblance(F.col("c"), F.col("d")).alias("cd"), containment(F.col("e"), F.col("c")).alias("cec"), merge(F.col("a"), F.col("b")).alias("m"), decode(encode(F.col("a"))).alias("back"),
    ).first()
    assert abs(r.ab - 296 / 1496) < 0.12 and abs(r.na / 896 - 1) < 0.25 and abs(r.cab - 296 / 896) < 0.17
    assert r.cd == 26 / 86 and r.cec == 1.0 and r.back == s[0] and r.m == sorted({*s[0], *s[1]})[:K]
    grouped = merge_groups(d.withColumn("g", F.col("i") < 2), ["g"], "s").collect()
    assert {x.g: x.s for x in grouped}[True] == r.m
