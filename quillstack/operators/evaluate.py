"""Evaluation of stored runs against a golden set: scores a run, metrics, gates, tuning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstack.functions import text as T
from quillstack.operators.steps import CATEGORIES
from quillstack.session import broadcast_small

#: Metrics of a set of runs: name and run score; the rates that are better when lower.
METRICS = {"classify": "classified", "found_share": "found_share", "hit": "hit", "precision": "correct", "declined": "declined", "failed": "failed", "citations": "citations_valid", "faithfulness": "faithful"}
LOWER_IS_BETTER = ("declined", "failed")
#: Launch gate: least precision, most declines. Differences count from this step on.
PRECISION, DECLINES, STEP = 0.95, 0.40, 1e-9


def matches(chunks: str) -> Column:
    """Ids of the matches of array<struct<id, context_for>>, in order; context is left out."""
    return F.transform(F.filter(chunks, lambda c: c["context_for"].isNull()), lambda c: c["id"])


def found_share_at(k: int, relevant: str, chunks: str) -> Column:
    """Share of the distinct relevant ids among the first k matches; null without relevant ids."""
    found = F.array_intersect(F.array_distinct(relevant), F.slice(matches(chunks), 1, k))
    return F.try_divide(F.size(found).cast("double"), F.size(F.array_distinct(relevant)))


def hit_at(k: int, relevant: str, chunks: str) -> Column:
    """Is a relevant id among the first k rows, context included? Null without relevant ids."""
    first = F.slice(F.transform(chunks, lambda c: c["id"]), 1, k)
    return F.when(F.size(relevant) > 0, F.arrays_overlap(first, relevant))


def faithfulness(verdicts: str, judged: Column) -> Column:
    """Share of supported claims; null unless claims were judged and there are some."""
    return F.when(judged, F.try_divide(F.size(F.filter(verdicts, lambda v: v == "supported")).cast("double"), F.size(verdicts)))


def citations_valid(cited: str, retrieved: str, reranked: str) -> Column:
    """Is every cited id one of the run's own?"""
    return F.forall(cited, lambda c: F.array_contains(F.array_union(retrieved, reranked), c))


def graded(verdict: str, expected: str) -> Column:
    """Are two lists of answers the same, one by one, but for case and outer spaces? Null without a verdict."""
    pairs = F.arrays_zip(F.col(verdict).alias("v"), F.col(expected).alias("e"))
    same = (F.size(verdict) == F.size(expected)) & F.forall(pairs, lambda p: F.coalesce(T.same_text(p["v"], p["e"]), F.lit(False)))
    return F.when(F.col(verdict).isNotNull(), same)


def run_scores(runs: DataFrame) -> DataFrame:
    """Scores of runs (run, category, classified_as, status, verdict, expected, relevant, retrieved, reranked, cited, verdicts, judged); null where they don't apply."""
    ids = lambda c: F.transform(c, lambda x: x["id"])
    answered = F.col("status") == "answered"
    return runs.select(
        "run", "category", (F.col("classified_as") == F.col("category")).alias("classified"), found_share_at(50, "relevant", "retrieved").alias("found_share"), hit_at(5, "relevant", "reranked").alias("hit"),
        F.when(answered & F.col("verdict").isNotNull() & F.col("expected").isNotNull(), T.same_text(F.col("verdict"), F.col("expected"))).alias("correct"),
        (F.col("status") == "declined").alias("declined"), (F.col("status") == "failed").alias("failed"),
        F.when(answered, citations_valid("cited", ids("retrieved"), ids("reranked"))).alias("citations_valid"), faithfulness("verdicts", F.col("judged")).alias("faithful"),
    )


def metrics(scores: DataFrame, by_category: bool = False) -> DataFrame:
    """(scope, metric, value, n): means over the runs that a score applies to. With categories, all of them have rows."""
    number = {m: F.col(c).cast("double").alias(m) for m, c in METRICS.items()}
    rows = scores.select("category", *number.values())
    if by_category:
        scopes = F.array(F.lit("overall"), F.col("category"))
        rows = rows.select(F.explode(scopes).alias("scope"), *METRICS)
    else:
        rows = rows.select(F.lit("overall").alias("scope"), *METRICS)
    wide = rows.groupBy("scope").agg(*[F.struct(F.avg(m).alias("value"), F.count(m).alias("n")).alias(m) for m in METRICS])
    if by_category:
        every = scores.sparkSession.createDataFrame([(c,) for c in ("overall", *CATEGORIES)], "scope string")
        wide = every.join(wide, "scope", "left")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m)["value"].alias("value"), F.coalesce(F.col(m)["n"], F.lit(0)).alias("n")) for m in METRICS])
    return wide.select("scope", F.inline(pairs))


def regressions(current: DataFrame, baseline: DataFrame, tolerances: DataFrame) -> DataFrame:
    """Metrics (scope, metric, value) that are worse than the baseline by more than their tolerance, or gone."""
    rows = baseline.withColumnRenamed("value", "was").join(current.withColumnRenamed("value", "now"), ["scope", "metric"], "left").join(broadcast_small(tolerances), "metric", "left")
    steps = lambda c: F.round(c / STEP).cast("long")
    worse = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("now") - F.col("was")).otherwise(F.col("was") - F.col("now"))
    bad = F.col("was").isNotNull() & (F.col("now").isNull() | (steps(worse) > steps(F.coalesce("tolerance", F.lit(0.0)))))
    return rows.where(bad).select("scope", "metric", "was", "now")


def found_share_changes(now: DataFrame, was: DataFrame) -> DataFrame:
    """gained, lost or unchanged by (found_share_50, found_share_10) in this order; a null is the least. A question that one
    side lacks is `missing`."""
    level = lambda c: F.coalesce(c, F.lit(-1.0))
    rows = now.select("qid", F.struct(level("found_share_50").alias("a"), level("found_share_10").alias("b")).alias("now")).join(was.select("qid", F.struct(level("found_share_50").alias("a"), level("found_share_10").alias("b")).alias("was")), "qid", "full_outer")
    return rows.select("qid", F.when(F.col("now").isNull() | F.col("was").isNull(), "missing").when(F.col("now") > F.col("was"), "gained").when(F.col("now") < F.col("was"), "lost").otherwise("unchanged").alias("change"))


def change_counts(changes: DataFrame) -> DataFrame:
    """One row: how many questions gained, lost, stayed and are missing."""
    return changes.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("gained", "lost", "unchanged", "missing")])


def found_share_report(shares: DataFrame) -> DataFrame:
    """(scope, found_share_10, found_share_50, n) overall and of each category, an empty one too, of (category,
    found_share_10, found_share_50)."""
    rows = shares.select(F.explode(F.array(F.lit("overall"), F.col("category"))).alias("scope"), "found_share_10", "found_share_50").where("scope is not null")
    by = rows.groupBy("scope").agg(F.avg("found_share_10").alias("found_share_10"), F.avg("found_share_50").alias("found_share_50"), F.count("found_share_50").alias("n"))
    every = shares.sparkSession.createDataFrame([(c,) for c in ("overall", *CATEGORIES)], "scope string")
    return every.join(by, "scope", "full").withColumn("n", F.coalesce("n", F.lit(0)))


def baseline_subset(scores: DataFrame, current: DataFrame, by_category: bool = False) -> DataFrame:
    """Metrics of the baseline's stored scores for only the runs that the current scores cover, so that both compare."""
    return metrics(scores.join(current.select("run").distinct(), "run", "left_semi"), by_category)


def write_results(scores: DataFrame, path: str) -> None:
    """Scores as lines of JSON, nulls written out; an existing result is replaced."""
    scores.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_results(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Stored scores; a line that isn't of the schema is an error when it is read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def replay(runs: DataFrame, candidates: DataFrame, steps: tuple[str, ...] = ("rerank", "answer")) -> DataFrame:
    """Runs (run, outcome, correct, <step>_score) under candidate thresholds (candidate, <step>): the first recorded score
    under its threshold declines; runs that were declined for their score stay so and are unresolved."""
    rows = runs.crossJoin(broadcast_small(candidates))  # a stated set
    under = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"{s}_score") < F.col(s), F.lit(False)) for s in steps])
    outcome = F.when(F.col("outcome") == "low_confidence", "declined").when((F.col("outcome") == "answered") & under, "declined").otherwise(F.col("outcome"))
    return rows.select("candidate", "run", outcome.alias("replayed"), (F.col("outcome") == "low_confidence").alias("unresolved"), "correct")


def tune(replayed: DataFrame) -> DataFrame:
    """Counts, precision, decline rate and launch gate of each candidate."""
    answered, declined = F.count_if(F.col("replayed") == "answered"), F.count_if(F.col("replayed") == "declined")
    by = replayed.groupBy("candidate").agg(
        answered.alias("answered"), declined.alias("declined"), F.count_if("unresolved").alias("unresolved"), F.avg(F.when(F.col("replayed") == "answered", F.col("correct").cast("double"))).alias("precision"),
        (declined / F.count(F.lit(1))).alias("decline_rate"),
    )
    gate = F.coalesce((F.col("precision") >= PRECISION) & (F.col("decline_rate") <= DECLINES), F.lit(False))
    return by.withColumn("gate", gate)


def select_golden(golden: DataFrame, ids: list[str]) -> DataFrame:
    """The questions with these ids; an unknown id is an error."""
    wanted = golden.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    unknown = [r.id for r in wanted.join(golden, "id", "left_anti").collect()]  # at most `ids`
    if unknown:
        raise ValueError(f"unknown questions: {', '.join(sorted(unknown))}")
    return golden.join(broadcast_small(wanted), "id", "left_semi")


GOLDEN = "id string, question string, category string, expected array<string>"


def validate_golden(lines: DataFrame) -> DataFrame:
    """(file, line, problem) of numbered JSON lines (file, line, value) that are no golden questions; blank lines are
    skipped. An id counts as repeated after the first line of its file that has it."""
    parsed = F.from_json("value", GOLDEN + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.where(F.trim("value") != "").withColumn("q", parsed)
    repeated = rows.groupBy("file", F.col("q.id").alias("again")).agg(F.min("line").alias("first"))
    rows = rows.join(repeated.withColumnRenamed("file", "of"), (F.col("file") == F.col("of")) & (F.col("q.id") == F.col("again")), "left")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    problem = (
        F.when(F.col("q._corrupt_record").isNotNull() | F.col("q.category").isNull(), "malformed").when(blank("q.id"), "blank id").when(F.col("line") > F.col("first"), "repeated id").when(blank("q.question"), "blank question")
        .when((F.col("q.category") == "ranking") & (F.coalesce(F.size("q.expected"), F.lit(0)) < 2), "ranking of one")
    )
    return rows.select("file", "line", problem.alias("problem")).where("problem is not null")


def read_golden(lines: DataFrame) -> DataFrame:
    """The golden questions of numbered JSON lines; a file with a bad line gives none (`validate_golden` says why)."""
    bad = validate_golden(lines).select("file").distinct()
    good = lines.where(F.trim("value") != "").join(bad, "file", "left_anti")
    return good.select("file", "line", F.from_json("value", GOLDEN).alias("q")).select("file", "line", "q.*")
