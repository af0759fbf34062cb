import hashlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from quillstack.llm.line_dedup import Lookup, Shard, _pack, dedup_lines, op6_line_dedup

SF = "/root/testdata/sf0.01"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(docs):
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_all_documents_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(docs)]
    assert sorted(map(tuple, op6_line_dedup(spark, SF).collect())) == want


@pytest.mark.parametrize(("shard", "most"), [(50_000, 64_000_000), (100, 9000)])
def test_edges(spark, shard, most):
    docs = [(5, "Shared line of text\nown line, number one\nshared LINE of text \nshort\nshort"), (3, "\t shared line of text\r\nx"), (9, None), (8, ""), (7, "ééééééééé\nshort"), (6, "ééééééééé\nÉÉÉÉÉÉÉÉÉÉ"), (4, "éÉÉÉÉÉÉÉÉÉ\nÉÉÉÉÉÉÉÉÉÉ"), (11, "\n".join(f"line number {i % 900}" for i in range(3000))), (10, "\n".join(f"LINE number {i}" for i in range(800)))]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_lines int")
    got = dedup_lines(d, shard_keys=shard, broadcast_bytes=most)
    assert sorted(got.columns) == ["doc_id", "kept_text", "n_dropped", "n_lines", "text"]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == brute(docs)
    assert dedup_lines(d.limit(0), shard_keys=shard, broadcast_bytes=most).collect() == []


@pytest.mark.parametrize("most", [64_000_000, 3000])
def test_columns_named_as_helpers_or_in_other_case(spark, most):
    docs = [(i, f"the same long line\nown line number {i}\n" + "\n".join(f"filling {j % 40} and more" for j in range(i, i + 30))) for i in range(60)]
    d = spark.createDataFrame([(a, b, a * 2, "k", "N") for a, b in docs], "doc_id long, text string, _id long, at string, N_LINES string")
    got = dedup_lines(d, shard_keys=5, broadcast_bytes=most)
    assert sorted(got.columns) == ["_id", "at", "doc_id", "kept_text", "n_dropped", "n_lines", "text"]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == brute(docs)
    assert all(r._id == 2 * r.doc_id for r in got.collect())


def test_keys_that_share_their_low_halves():
    keys = pd.DataFrame({"shard": 0, "lo": [5, 5, 7, -9], "hi": [1, 2, 3, 4], "first": [10, 20, 30, 40], "n": 2})
    shard = SimpleNamespace(**_pack(keys).iloc[0].to_dict())
    lo, hi = np.array([5, 5, 7, -9, 5, 8]).view(np.uint64), np.array([1, 2, 3, 4, 9, 3]).view(np.uint64)
    never = np.iinfo(np.int64).max
    assert Shard(shard).look_up(lo, hi).tolist() == [10, 20, 30, 40, never, never]
    assert Lookup([shard], 1).first(lo, hi).tolist() == [10, 20, 30, 40, never, never]
