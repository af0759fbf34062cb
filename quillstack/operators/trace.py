"""Run traces: each step of answering adds an entry with its record and its access checks, and a run that a step declines
takes no later step. Scores read the last record of a kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.operators import access as A
from quillstack.operators import evaluate as E
from quillstack.operators import steps as S
from quillstack.session import materialize

CHECKS = "array<struct<chunk: string, decision: string>>"
#: Steps in order.
STEPS = ("classify", "retrieve", "rerank", "admit", "answer")


def entry(rows: DataFrame, step: str, record: dict[str, Column], reason: Column | None = None, score: Column | None = None, threshold: float | None = None, checks: Column | None = None) -> DataFrame:
    """(qid, n, entry) of a step: passed, or declined where there is a `reason`; the record is JSON with its kind."""
    none = F.lit(None)
    reason = none.cast("string") if reason is None else reason
    whole = F.to_json(F.struct(F.lit(step).alias("kind"), *[c.alias(k) for k, c in record.items()]))
    one = F.struct(
        F.lit(step).alias("step"), F.when(reason.isNotNull(), "declined").otherwise("passed").alias("outcome"), reason.alias("reason"), (none if score is None else score).cast("float").alias("score"),
        F.lit(threshold).cast("float").alias("threshold"), whole.alias("record"), (none.cast(CHECKS) if checks is None else checks).alias("access"),
    )
    return rows.select("qid", F.lit(STEPS.index(step)).alias("n"), one.alias("entry"))


def joined(entries: list[DataFrame]) -> DataFrame:
    """(qid, trace): entries in the order of their steps, up to the first that declined."""
    rows = reduce(DataFrame.unionByName, entries)
    by = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("n", "entry"))).alias("all"), F.min(F.when(F.col("entry.outcome") == "declined", F.col("n"))).alias("end"))
    kept = F.filter("all", lambda x: F.col("end").isNull() | (x["n"] <= F.col("end")))
    return by.select("qid", F.transform(kept, lambda x: x["entry"]).alias("trace"))


def _listed(rows: DataFrame, order: str, **fields: Column) -> DataFrame:
    """(qid, list): a question's rows as an array of structs in order; what a run has retrieved, and no more, is in it."""
    by = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(order, F.struct(*[c.alias(k) for k, c in fields.items()]).alias("x")))).alias("all"))
    return by.select("qid", F.transform("all", lambda y: y["x"]).alias("list"))


def run(questions: DataFrame, matches: DataFrame, scopes: DataFrame, keep: int = 5, least: float = 0.6, sure: float = 0.7) -> DataFrame:
    """(qid, trace) of whole tables: classify, retrieve, rerank, admit and, for boolean questions, answer.

    `questions` and `matches` are as `steps.run_pipeline` takes them, with `acl` and `sensitivity` of each match;
    `scopes` is (qid, members, grants). Every step that reads chunks checks them: what isn't allowed goes before it is
    ranked, and the check stays in the trace. A question that retrieves no match that it may read ends there; context alone
    is no source.
    """
    asked = S.classify(questions, least)
    names = lambda *c: {k: F.col(k) for k in c}
    entries = [entry(asked, "classify", {"mode": F.lit("judged"), **names("raw", "category", "fallback_from")}, score=F.col("score"))]
    # Written, as several steps read them.
    checks = materialize(A.enforce(matches, scopes)[1], "checks")
    allowed = checks.where(F.col("decision").startswith("allowed"))
    chunk = {"chunk": F.col("id"), "context_for": F.col("context_for")}
    hits = _listed(allowed, "place", **chunk)
    checked = _listed(checks, "place", chunk=F.col("id"), decision=F.col("decision")).withColumnRenamed("list", "checks")
    got = asked.select("qid").join(hits, "qid", "left").join(checked, "qid", "left")
    entries.append(entry(got, "retrieve", {"chunks": F.coalesce("list", F.array().cast(hits.schema["list"].dataType))}, F.when(~F.coalesce(F.exists("list", lambda c: c["context_for"].isNull()), F.lit(False)), "no_sources"), checks=F.coalesce("checks", F.array().cast(CHECKS))))
    again = materialize(A.enforce(S.rerank(allowed.drop("decision"), keep), scopes)[1], "reread")
    reread = again.where(F.col("decision").startswith("allowed"))
    order = _listed(reread, "rank", **chunk).join(_listed(again, "rank", chunk=F.col("id"), decision=F.col("decision")).withColumnRenamed("list", "checks"), "qid")
    entries.append(entry(order, "rerank", {"mode": F.lit("retrieval_order"), "chunks": F.col("list")}, checks=F.col("checks")))
    routed = S.admit(reread)
    routes = _listed(routed, "rank", chunk=F.col("id"), route=F.col("route")).join(routed.groupBy("qid").agg(F.max("kept").alias("some")), "qid")
    entries.append(entry(routes, "admit", {"sources": F.col("list")}, F.when(~F.col("some"), "no_admitted_sources")))
    yes, confidence = S.verdict(F.col("p_yes"))
    boolean = asked.where("category = 'boolean'").withColumn("sure", confidence)
    parsed = F.struct(yes.alias("yes"), F.round(F.col("p_yes").cast("double"), 6).alias("probability_yes"))
    entries.append(entry(boolean, "answer", {"parsed": parsed}, F.when(F.col("sure") < S.f32(sure), "low_confidence"), F.col("sure"), sure))
    return joined(entries)


def last_record(trace: str, kind: str) -> Column:
    """The last record of a kind as VARIANT; null where the trace has none."""
    of = F.filter(trace, lambda e: F.try_variant_get(F.try_parse_json(e["record"]), "$.kind", "string") == kind)
    return F.try_parse_json(F.try_element_at(of, F.lit(-1))["record"])


def _chunks(record: Column) -> Column:
    return F.try_variant_get(record, "$.chunks", "array<struct<chunk: string, context_for: string>>")


def as_runs(traces: DataFrame, golden: DataFrame) -> DataFrame:
    """What `evaluate.run_scores` takes, read from traces (qid, trace) and golden questions (qid, category, relevant).

    A run without a record of a kind has nulls there, and scores that need it don't apply.
    """
    ids = lambda r: F.transform(_chunks(r), lambda c: F.struct(c["chunk"].alias("id"), c["context_for"].alias("context_for")))
    end = F.try_element_at("trace", F.lit(-1))
    answer = last_record("trace", "answer")
    said = F.try_variant_get(answer, "$.parsed.yes", "boolean")
    none = F.lit(None)
    return traces.join(golden, "qid").select(
        F.col("qid").alias("run"), "category", F.try_variant_get(last_record("trace", "classify"), "$.category", "string").alias("classified_as"), F.when(end["outcome"] == "declined", "declined").otherwise("answered").alias("status"),
        F.when(end["outcome"] == "passed", F.when(said, "yes").when(~said, "no")).alias("verdict"), none.cast("string").alias("expected"), "relevant", ids(last_record("trace", "retrieve")).alias("retrieved"), ids(last_record("trace", "rerank")).alias("reranked"),
        F.array().cast("array<string>").alias("cited"), F.array().cast("array<string>").alias("verdicts"), F.lit(False).alias("judged"),
    )


def scores(traces: DataFrame, golden: DataFrame) -> DataFrame:
    return E.run_scores(as_runs(traces, golden))
