"""What the vector index finds against exact search, and scopes that are hard to fill."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.operators import retrieval as R
from quillstack.operators import vector_index as V
from quillstack.plans.corpus_queries import _vectors


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_nine_tenths_of_the_50_nearest_are_found(spark, sf):
    queries, vectors = _vectors(spark, f"/root/testdata/{sf}")
    index = V.build(vectors)
    assert index.table(spark).count() == vectors.count()
    got = V.search(index, queries)
    exact = R.vector_top(queries, vectors)
    assert got.groupBy("qid").count().where("count <> 50").isEmpty() and got.select("qid").distinct().count() == queries.count()
    both = got.join(exact.select("qid", "id"), ["qid", "id"]).count()
    assert both / exact.count() >= 0.9
    assert index.probes < len(index.centroids)  # not all of it was read at once
    assert got.join(exact.withColumnRenamed("score", "true"), ["qid", "id"]).where(F.abs(F.col("score") - F.col("true")) > 2e-5).isEmpty()


def test_a_narrow_scope_widens_the_search(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(20, 16))
    rows = [(i, (base[i % 20] + 0.1 * r.normal(size=16)).tolist()) for i in range(2000)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = spark.createDataFrame([(7, base[3].tolist()), (8, base[4].tolist()), (9, [0.0] * 16)], "qid long, query array<double>")
    index = V.build(vectors, lists=20)
    few = vectors.where("id % 20 = 11 and id < 600").select("id")  # thirty rows of another cluster
    got = V.search(index, queries, 25, few, probes=1)
    assert {(x.qid, x["count"]) for x in got.groupBy("qid").count().collect()} == {(7, 25), (8, 25)}  # all lists were read in the end
    exact = R.vector_top(queries, vectors.join(few, "id", "left_semi"), 25)
    assert sorted((x.qid, x.id) for x in got.collect()) == sorted((x.qid, x.id) for x in exact.collect())


def test_odd_vectors_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.6, 0.8])]
    index = V.build(spark.createDataFrame(rows, "id long, embedding array<float>"))
    got = V.search(index, spark.createDataFrame([(1, [1.0, 0.0])], "qid long, query array<float>"), 5).collect()
    assert [(r.id, r.score, r.rank) for r in got] == [(1, 1.0, 1), (6, 0.6, 2)]
    none = V.build(spark.createDataFrame([], "id long, embedding array<float>"))
    assert none.centroids.shape == (1, 1)


def test_tiles_rank_as_all_pairs_do(spark, monkeypatch):
    """Copies, odd vectors, vectors of other lengths and null parts, over several blocks of both sides."""
    from quillstack.operators import ranking

    monkeypatch.setattr(ranking, "QUERIES", 9)
    monkeypatch.setattr(ranking, "COMPONENTS", 700)
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 8)).astype(np.float32)
    rows = [(f"v{i}", base[i % 40].tolist() if i < 250 else (base[i % 40] + 1e-4 * r.normal(size=8)).tolist()) for i in range(400)]
    rows += [("n", None), ("z", [0.0] * 8), ("p", [None] + [1.0] * 7), ("s", [1.0, 2.0]), ("e", [])]
    vectors = spark.createDataFrame(rows, "id string, embedding array<float>")
    queries = spark.createDataFrame([(k, base[k].tolist()) for k in range(20)] + [(20, [2.0, 1.0]), (21, [0.0] * 8)], "qid long, query array<float>")
    got = {(x.qid, x["rank"]): (x.id, x.score) for x in R.vector_top(queries, vectors, 12).collect()}
    want = {}
    for q in queries.collect():
        near = []
        for v in vectors.collect():
            if v.embedding and None not in v.embedding and len(v.embedding) == len(q.query) and any(v.embedding) and any(q.query):
                a, b = np.array(v.embedding, np.float64), np.array(q.query, np.float64)
                near.append((-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 5), v.id))
        want |= {(q.qid, n): (i, -s) for n, (s, i) in enumerate(sorted(near)[:12], 1)}
    assert got == want and len(want) == 20 * 12 + 1


def test_exact_search_and_probes_make_no_row_a_pair(spark):
    queries, vectors = _vectors(spark, "/root/testdata/sf0.001")
    plan = R.vector_top(queries, vectors)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
