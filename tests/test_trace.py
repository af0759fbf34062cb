"""Traces of runs: halting, access checks, last records, and scores that equal those of ready columns."""

import json

from pyspark.sql import functions as F

from quillstack.operators import access as A
from quillstack.operators import evaluate as E
from quillstack.operators import steps as S
from quillstack.operators import trace as T

ASKED = "qid int, p_boolean float, p_choice float, p_ranking float, p_open float, p_yes float"
MATCHES = "qid int, id string, place int, authoritative boolean, context_for string, injection float, relevance float, contradiction float, evidence float, acl array<string>, sensitivity string"
OK, OFF = (0.1, 0.9, 0.1, 0.9), (0.1, 0.1, 0.1, 0.1)


def tables(spark):
    asked = spark.createDataFrame([(1, 0.55, 0.1, 0.1, 0.25, 0.5), (2, 0.9, 0.0, 0.0, 0.1, 0.9), (3, 0.1, 0.1, 0.1, 0.7, 0.5), (4, 0.1, 0.1, 0.1, 0.7, 0.5), (5, 0.9, 0.0, 0.0, 0.1, 0.6), (6, 0.1, 0.1, 0.1, 0.7, 0.5)], ASKED)
    rows = [
        (1, "a", 0, True, None, *OK, [], "public"), (1, "a2", 1, False, "a", *OK, ["role:x"], "public"), (1, "b", 2, False, None, *OK, ["role:reader"], "internal"), (2, "c", 0, True, None, *OK, [], "internal"), (2, "d", 1, True, None, *OFF, [], "confidential"),
        (4, "e", 0, True, None, *OFF, [], "public"), (5, "f", 0, True, None, *OK, [], "public"), (6, "g", 0, True, None, *OK, ["user:ana"], "public"),
    ]
    scope = asked.select("qid", F.array(F.lit("role:reader")).alias("members"), F.array(F.struct(F.lit("reader").alias("role"), F.lit("internal").alias("clearance"))).alias("grants"))
    return asked, spark.createDataFrame(rows, MATCHES), scope


def test_halted_runs_take_no_later_step(spark):
    traces = {r.qid: r.trace for r in T.run(*tables(spark)).collect()}
    steps = {q: [e.step for e in t] for q, t in traces.items()}
    upto = list(T.STEPS)
    assert steps == {1: upto[:4], 2: upto, 3: upto[:2], 4: upto[:4], 5: upto, 6: upto[:2]}
    assert {q: t[-1].reason for q, t in traces.items()} == {1: None, 2: None, 3: "no_sources", 4: "no_admitted_sources", 5: "low_confidence", 6: "no_sources"}
    assert all(e.outcome == "passed" for t in traces.values() for e in t[:-1])
    answer = traces[2][-1]
    assert json.loads(answer.record) == {"kind": "answer", "parsed": {"yes": True, "probability_yes": 0.9}} and abs(answer.score - 0.9) < 1e-6 and abs(answer.threshold - 0.7) < 1e-6


def test_denied_chunks_stay_in_the_checks_alone(spark):
    traces = {r.qid: {e.step: e for e in r.trace} for r in T.run(*tables(spark)).collect()}
    assert [(c.chunk, c.decision) for c in traces[1]["retrieve"].access] == [("a", "allowed by reader"), ("a2", "not_in_acl"), ("b", "allowed by reader")]
    assert [(c.chunk, c.decision) for c in traces[2]["retrieve"].access] == [("c", "allowed by reader"), ("d", "no_grant")]
    assert all(c.decision.startswith("allowed") for t in traces.values() if "rerank" in t for c in t["rerank"].access)
    assert not any(x in e.record for t in traces.values() for e in t.values() for x in ('"a2"', '"d"', '"g"'))  # in no record of any step
    _, matches, scope = tables(spark)
    allowed, checks = A.enforce(matches, scope.where("qid <> 4"))
    assert {r.id for r in allowed.collect()} == {"a", "b", "c", "f"} and {r.id: r.decision for r in checks.collect()}["e"] == "no_grant"


def test_scores_of_traces_are_those_of_ready_columns(spark):
    asked, matches, scope = tables(spark)
    golden = spark.createDataFrame([(1, "open", ["a"]), (2, "boolean", ["c", "zz"]), (3, "open", ["x"]), (4, "boolean", []), (5, "boolean", ["f"]), (6, "open", ["g"])], "qid int, category string, relevant array<string>")
    got = {r.run: r.asDict() for r in T.scores(T.run(asked, matches, scope), golden).collect()}
    allowed, _ = A.enforce(matches, scope)
    listed = lambda rows, by: rows.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct(by, F.struct("id", "context_for").alias("x")))), lambda y: y["x"]).alias("v"))
    outcomes = S.run_pipeline(asked, allowed)
    ready = outcomes.drop("category").join(S.classify(asked, 0.6).select("qid", F.col("category").alias("classified_as")), "qid").join(golden, "qid")
    ready = ready.join(listed(allowed, "place").withColumnRenamed("v", "retrieved"), "qid", "left").join(listed(S.rerank(allowed, 5), "rank").withColumnRenamed("v", "reranked"), "qid", "left")
    none = F.array().cast("array<struct<id:string,context_for:string>>")
    empty = F.array().cast("array<string>")
    ready = ready.select(
        F.col("qid").alias("run"), "category", "classified_as", F.when(F.col("halted_at").isNotNull(), "declined").otherwise("answered").alias("status"), F.when(F.col("outcome").isin("yes", "no"), F.col("outcome")).alias("verdict"), F.lit(None).cast("string").alias("expected"),
        "relevant", F.coalesce("retrieved", none).alias("retrieved"), "reranked", empty.alias("cited"), empty.alias("verdicts"), F.lit(False).alias("judged"),
    )
    assert got == {r.run: r.asDict() for r in E.run_scores(ready).collect()}
    assert got[2]["found_share"] == 0.5 and got[3]["hit"] is None and got[4]["found_share"] is None and got[6]["found_share"] == 0.0
    assert T.as_runs(T.run(asked, matches, scope), golden).where("run = 5").first().verdict is None


def test_the_last_record_of_a_kind_counts(spark):
    entry = "array<struct<step: string, record: string>>"
    rows = spark.createDataFrame([(1, [("x", '{"kind":"k","v":1}'), ("y", '{"kind":"o","v":2}'), ("x", '{"kind":"k","v":3}'), ("z", "broken")]), (2, [])], f"qid int, trace {entry}")
    got = {r.qid: r.v for r in rows.select("qid", F.try_variant_get(T.last_record("trace", "k"), "$.v", "int").alias("v")).collect()}
    assert got == {1: 3, 2: None}
