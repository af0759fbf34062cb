import hashlib
import re

import pytest

from quillstack.llm.decontaminate import decontaminate, digest, op10_decontaminate

SF = "/root/testdata/sf0.01"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = {}
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    lengths = {len(x) for x in windows}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def rows(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_all_documents_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows(op10_decontaminate(spark, SF)) == brute(docs, items)


@pytest.mark.parametrize("block", [8_000_000, 60])
def test_edges(spark, block):
    item = "One two three four five six seven eight nine ten eleven TWELVE"
    long = "x1 " * 5000 + item + " é" * 3000
    docs = [(1, None), (2, ""), (3, "..."), (4, item), (5, item), (6, "zero " + item[:50] + " end"), (7, long), (8, "a b"), (9, "b a b c"), (10, "two three four five six seven eight nine ten eleven")]
    items = [(1, item), (2, "a b"), (3, None), (4, " , "), (None, "b a"), (5, "nine ten eleven twelve"), (1, "b c")]
    d = spark.createDataFrame([(*x, "s", 1) for x in docs], "doc_id long, text string, items string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(d, b, block_bytes=block)
    assert sorted(got.columns) == ["doc_id", "hit_spans", "items", "n_words", "text"]
    assert rows(digest(got)) == brute(docs, [x for x in items if x[0] is not None])
    assert rows(digest(decontaminate(d.limit(0), b, block_bytes=block))) == {}
    assert rows(digest(decontaminate(d, b.limit(0), block_bytes=block))) == brute(docs, [])


@pytest.mark.parametrize("block", [8_000_000, 60])
def test_columns_named_as_helpers_or_in_other_case(spark, block):
    d = spark.createDataFrame([(1, "a b c", 5, "x", 2)], "doc_id long, text string, N_WORDS int, at string, row int")
    items = spark.createDataFrame([(i, f"word{i} b c") for i in range(20)] + [(99, "b c")], "item_id long, text string")
    got = decontaminate(d, items, block_bytes=block)
    assert sorted(got.columns) == ["at", "doc_id", "hit_spans", "items", "n_words", "row", "text"]
    r = got.first()
    assert (r.n_words, r.row, r.at, r["items"]) == (3, 2, "x", ["99"]) and [tuple(s) for s in r.hit_spans] == [(1, 3)]
