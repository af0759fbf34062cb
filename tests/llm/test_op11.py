"""Vector groups against all pairs in double precision."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.llm import vector_dedup as V

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, least=0.93):
    """(id, links, component, kept) by all pairs."""
    ok = [r for r in range(len(rows)) if rows[r][2] is not None and rows[r][1] and all(x is not None and np.isfinite(x) for x in rows[r][1]) and any(rows[r][1])]
    near = {r: set() for r in range(len(rows))}
    for a in ok:
        for b in ok:
            x, y = rows[a][1], rows[b][1]
            if a != b and rows[a][2] == rows[b][2] and len(x) == len(y) and np.dot(x, y) / np.sqrt(np.dot(x, x)) / np.sqrt(np.dot(y, y)) >= least:
                near[a].add(b)
    out = []
    for r in range(len(rows)):
        seen, todo = {r}, [r]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[s][0] for s in seen if rows[s][0] is not None]
        component = min(ids, default=None)
        out.append((rows[r][0], len(near[r]), component, component is not None and rows[r][0] == component))
    return sorted(out, key=repr)


def got(spark, rows, **options):
    df = V.group_vectors(spark.createDataFrame(rows, SCHEMA), keep=["vec_id"], **options)
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def made(seed, n, dim=24, labels=3):
    """Chains, clusters and copies of random vectors."""
    r = np.random.default_rng(seed)
    base = r.normal(size=(max(n // 6, 1), dim))
    rows = []
    for i in range(n):
        v = base[r.integers(len(base))] + r.normal(size=dim) * r.choice([0, 0.1, 0.25, 0.4])
        rows.append((i, (v * r.choice([1e-3, 1, 50])).tolist(), int(r.integers(labels))))
    return rows


@pytest.mark.parametrize("tile", [10, 40, 1000])
def test_links_are_those_of_all_pairs(spark, tile):
    rows = made(tile, 150)
    want = brute(rows)
    assert got(spark, rows, tile=tile) == want and 20 < sum(w[1] > 0 for w in want) < 150


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, -0.0], 0), (4, [1.0, 0.0], 1), (5, [1.0, 0.0], None), (6, None, 0), (7, [], 0), (8, [0.0, 0.0], 0), (9, [1.0, None], 0), (10, [nan, 1.0], 0), (11, [inf, 1.0], 0),
        (12, [1.0, 0.0, 0.0], 0), (None, [0.0, 1.0], 0), (None, [0.0, 1.0], 0), (None, [1.0, 0.01], 0), (13, [1e300, 1e298], 2), (14, [1e299, 0.0], 2), (15, [-1.0, 0.0], 0),
    ]
    plain = [r if r[0] not in (13, 14) else (r[0], [x / 1e299 for x in r[1]], r[2]) for r in rows]
    assert got(spark, rows) == brute(plain)
    assert got(spark, []) == []


def test_names_that_clash_and_floats(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 0, "a"), (2, [1.0, 0.1], 0, "b")], "vec_id long, embedding array<float>, label int, KEPT string").withColumn("row.x", F.lit(5))
    df = V.group_vectors(rows)
    assert df.columns == ["vec_id", "embedding", "label", "row.x", "n_links", "component_id", "kept"]
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_many_copies_are_one_point(spark):
    df = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.when(F.col("id") % 100 == 0, F.col("id") * 1e-9).otherwise(0.0)).alias("embedding"), F.lit(1).alias("label"))
    out = V.group_vectors(df, keep=["vec_id"], tile=50)
    assert out.agg(F.min("n_links"), F.max("n_links"), F.count_distinct("component_id"), F.count_if("kept")).first() == (19_999, 19_999, 1, 1)


def test_the_bound_holds_and_few_pairs_are_computed_again():
    r = np.random.default_rng(5)
    x = V.unit(np.concatenate([r.normal(size=(300, 64)), r.normal(size=(300, 64)) * r.lognormal(0, 2, 64)]))
    code, scale, back, left = V.quantise(x)
    about = (code @ code.T).astype(float) * scale[:, None] * scale
    assert (np.abs(about - x @ x.T) <= left[:, None] * back + left + 1e-12).all()
    again = sum(n for _, _, n in V.linked(x, x, 0.93, True))
    true = int((np.triu(x @ x.T, 1) >= 0.93).sum())
    assert sum(len(i) for i, _, _ in V.linked(x, x, 0.93, True)) == true and again < 0.05 * len(x) ** 2 / 2
    wide = V.unit(r.normal(size=(40, 2500)))  # more dimensions than a product adds up exactly at once
    c, s, _, _ = V.quantise(wide)
    assert (V._products(c, c) == (c.astype(np.int64) @ c.T.astype(np.int64))).all()
