"""Queries of evaluation and of stored runs, over retrieval results and over the runs that conversations stand for."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillstack.operators import evaluate as E
from quillstack.operators import retrieval as R
from quillstack.operators import runs as U
from quillstack.plans.corpus_queries import _BM25, _bm25
from quillstack.plans.inline import Catalogue
from quillstack.session import materialize, shared_dir, table
from quillstack.sources import corpus as C
from quillstack.sources import derived as D
from quillstack.sources.lines import numbered_lines

catalogue = Catalogue()
WITH = f"WITH {D.SQL}"

#: Questions whose passage's first line has 20 characters or more, with the chunks that hold it.
RELEVANT = "relevant AS (SELECT q.qid, c.id FROM (SELECT qid, trim(string_split(question, chr(10))[1]) AS line FROM questions) q JOIN chunks c ON len(q.line) >= 20 AND contains(c.text, q.line))"


def relevant(spark, d):
    line = F.trim(F.get(F.split("question", "\n"), F.lit(0)))
    asked = C.questions(spark, d).select("qid", line.alias("line")).where(F.char_length("line") >= 20)
    return R.containing(C.chunks(spark, d).select("id", "text"), asked)


def _found(spark, d):
    return _bm25(spark, d).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: F.struct(x["id"].alias("id"), F.lit(None).cast("string").alias("context_for"))).alias("found"))


def _found_shares(spark, d):
    truth = relevant(spark, d).groupBy("qid").agg(F.collect_set("id").alias("relevant"))
    none = F.array().cast("array<string>")
    rows = C.questions(spark, d).join(_found(spark, d), "qid", "left").join(truth, "qid", "left")
    rows = rows.select("qid", F.coalesce("relevant", none).alias("relevant"), F.coalesce("found", F.array().cast("array<struct<id:string,context_for:string>>")).alias("found"))
    return rows.select("qid", E.found_share_at(10, "relevant", "found").alias("found_share_10"), E.found_share_at(50, "relevant", "found").alias("found_share_50"), E.hit_at(5, "relevant", "found").alias("hit_5"))


_FOUND_SHARE = f"""WITH {C.SQL}, {_BM25}, {RELEVANT}, r AS (SELECT q.qid, count(DISTINCT x.id) AS n, count(DISTINCT x.id) FILTER (t.rank <= 10) AS a, count(DISTINCT x.id) FILTER (t.rank <= 50) AS b, count(DISTINCT x.id) FILTER (t.rank <= 5) AS h
 FROM questions q LEFT JOIN relevant x ON x.qid = q.qid LEFT JOIN text_ranked t ON t.qid = q.qid AND t.id = x.id GROUP BY q.qid), found_shares AS (SELECT qid, CASE WHEN n > 0 THEN a::DOUBLE / n END AS found_share_10, CASE WHEN n > 0 THEN b::DOUBLE / n END AS found_share_50, CASE WHEN n > 0 THEN h > 0 END AS hit_5 FROM r)"""


@catalogue.add("found_share_at_k", f"{_FOUND_SHARE} SELECT qid, round(found_share_10, 6) AS found_share_10, round(found_share_50, 6) AS found_share_50 FROM found_shares")
def found_share_at_k(spark, d):
    return _found_shares(spark, d).select("qid", F.round("found_share_10", 6).alias("found_share_10"), F.round("found_share_50", 6).alias("found_share_50"))


@catalogue.add("hit_at_k", f"{_FOUND_SHARE} SELECT qid, hit_5 FROM found_shares")
def hit_at_k(spark, d):
    return _found_shares(spark, d).select("qid", "hit_5")


@catalogue.add("found_share_report", f"""{_FOUND_SHARE}, s AS (SELECT 'overall' AS scope, found_share_10, found_share_50 FROM found_shares UNION ALL SELECT ['boolean', 'choice', 'ranking'][(qid % 3)::INT + 1], found_share_10, found_share_50 FROM found_shares)
SELECT x.scope, round(avg(found_share_10), 6) AS found_share_10, round(avg(found_share_50), 6) AS found_share_50, count(found_share_50) AS n FROM (VALUES ('overall'), ('boolean'), ('choice'), ('ranking'), ('open')) x(scope) LEFT JOIN s ON s.scope = x.scope GROUP BY x.scope""")
def found_share_report(spark, d):
    """Overall and by category; no question is of the open one, which has a row all the same."""
    category = F.get(F.array(*map(F.lit, ("boolean", "choice", "ranking"))), (F.col("qid") % 3).cast("int"))
    by = E.found_share_report(_found_shares(spark, d).withColumn("category", category))
    return by.select("scope", F.round("found_share_10", 6).alias("found_share_10"), F.round("found_share_50", 6).alias("found_share_50"), "n")


_CHANGES = f"""{_FOUND_SHARE}, was AS (SELECT qid, CASE WHEN qid % 3 = 0 THEN NULL ELSE found_share_50 END AS found_share_50, CASE WHEN qid % 3 = 1 THEN 1.0 ELSE found_share_10 END AS found_share_10 FROM found_shares),
changes AS (SELECT r.qid, CASE WHEN (coalesce(r.found_share_50, -1), coalesce(r.found_share_10, -1)) > (coalesce(w.found_share_50, -1), coalesce(w.found_share_10, -1)) THEN 'gained' WHEN (coalesce(r.found_share_50, -1), coalesce(r.found_share_10, -1)) < (coalesce(w.found_share_50, -1), coalesce(w.found_share_10, -1)) THEN 'lost' ELSE 'unchanged' END AS change
 FROM found_shares r JOIN was w ON w.qid = r.qid)"""


def _changes(spark, d):
    now = _found_shares(spark, d)
    was = now.select("qid", F.when(F.col("qid") % 3 == 0, F.lit(None)).otherwise(F.col("found_share_50")).alias("found_share_50"), F.when(F.col("qid") % 3 == 1, 1.0).otherwise(F.col("found_share_10")).alias("found_share_10"))
    return E.found_share_changes(now, was)


@catalogue.add("found_share_changes", f"{_CHANGES} SELECT qid, change FROM changes")
def found_share_changes(spark, d):
    return _changes(spark, d)


@catalogue.add("found_share_change_counts", f"{_CHANGES} SELECT count(*) FILTER (change = 'gained') AS gained, count(*) FILTER (change = 'lost') AS lost, count(*) FILTER (change = 'unchanged') AS unchanged, 0::BIGINT AS missing FROM changes")
def found_share_change_counts(spark, d):
    return E.change_counts(_changes(spark, d))


_IDS = lambda c: f"list_transform({c}, lambda x: x.id)"
_SCORES = f"""{D.SQL}, scores AS (SELECT run, total, category, classified_as = category AS classified, CASE WHEN len(relevant) > 0 THEN len(list_intersect(relevant, list_transform(list_filter(retrieved, lambda x: x.context_for IS NULL)[1:50], lambda x: x.id)))::DOUBLE / len(relevant) END AS found_share,
 CASE WHEN len(relevant) > 0 THEN list_has_any({_IDS("reranked[1:5]")}, relevant) END AS hit, CASE WHEN status = 'answered' AND verdict IS NOT NULL AND expected IS NOT NULL THEN lower(trim(verdict)) = lower(trim(expected)) END AS correct,
 status = 'declined' AS declined, status = 'failed' AS failed, CASE WHEN status = 'answered' THEN list_has_all({_IDS("list_concat(retrieved, reranked)")}, cited) END AS citations_valid,
 CASE WHEN judged AND len(verdicts) > 0 THEN len(list_filter(verdicts, lambda v: v = 'supported'))::DOUBLE / len(verdicts) END AS faithful FROM runs)"""


@catalogue.add("run_scores", f"WITH {_SCORES} SELECT * EXCLUDE (total) FROM scores")
def run_scores(spark, d):
    return E.run_scores(D.runs(spark, d))


_UNION = lambda s: " UNION ALL ".join(f"SELECT scope, '{m}' AS metric, round(avg({c}::DOUBLE), 6) AS value, count({c}) AS n FROM {s} GROUP BY scope" for m, c in E.METRICS.items())
_BOTH = lambda where="true": f"(SELECT *, 'overall' AS scope FROM scores WHERE {where} UNION ALL SELECT *, category AS scope FROM scores WHERE {where})"


@catalogue.add("eval_metrics", f"WITH {_SCORES}, s AS (SELECT *, 'overall' AS scope FROM scores) {_UNION('s')}")
def eval_metrics(spark, d):
    return E.metrics(E.run_scores(D.runs(spark, d))).withColumn("value", F.round("value", 6))


@catalogue.add("eval_metrics_rollup", f"WITH {_SCORES}, s AS {_BOTH()} {_UNION('s')}")
def eval_metrics_rollup(spark, d):
    return E.metrics(E.run_scores(D.runs(spark, d)), True).withColumn("value", F.round("value", 6))


@catalogue.add("faithfulness", f"WITH {_SCORES} SELECT run, faithful FROM scores")
def faithfulness(spark, d):
    return D.runs(spark, d).select("run", E.faithfulness("verdicts", F.col("judged")).alias("faithful"))


@catalogue.add("citation_validity", f"{WITH} SELECT run, list_has_all({_IDS('list_concat(retrieved, reranked)')}, cited) AS valid FROM runs")
def citation_validity(spark, d):
    ids = lambda c: F.transform(c, lambda x: x["id"])
    return D.runs(spark, d).select("run", E.citations_valid("cited", ids("retrieved"), ids("reranked")).alias("valid"))


@catalogue.add("grade_answers", f"""{WITH}, g AS (SELECT t.qid, total, list(role ORDER BY turn) AS e FROM turns t JOIN totals USING (qid) GROUP BY t.qid, total),
v AS (SELECT qid, e, CASE WHEN total % 7 <> 0 THEN list_transform(CASE WHEN total % 3 = 0 THEN list_reverse(e) WHEN total % 5 = 0 THEN e[1:len(e) - 1] ELSE e END, lambda x: ' ' || upper(x)) END AS v FROM g)
SELECT qid, CASE WHEN v IS NOT NULL THEN list_transform(v, lambda x: lower(trim(x))) = e END AS correct FROM v""")
def grade_answers(spark, d):
    """The roles of a conversation as an expected ranking, and as a given one in other letters, in part reversed or cut."""
    by = D.turns(spark, d).groupBy("qid").agg(F.sum("n").alias("total"), F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("expected"))
    given = F.when(F.col("total") % 3 == 0, F.reverse("expected")).when(F.col("total") % 5 == 0, F.slice("expected", F.lit(1), F.size("expected") - 1)).otherwise(F.col("expected"))
    rows = by.select("qid", "expected", F.when(F.col("total") % 7 != 0, F.transform(given, lambda x: F.concat(F.lit(" "), F.upper(x)))).alias("verdict"))
    return rows.select("qid", E.graded("verdict", "expected").alias("correct"))


#: How far a metric may fall.
TOLERANCES = [("classify", 0.05), ("found_share", 0.05)]


@catalogue.add("regression_gate", f"""WITH {_SCORES}, s AS {_BOTH("run % 2 = 0")}, w AS {_BOTH("run % 3 = 0")}, m AS ({_UNION('s').replace('round(', '(').replace(', 6)', ')')}), b AS ({_UNION('w').replace('round(', '(').replace(', 6)', ')')}),
e AS (SELECT b.scope, b.metric, b.value AS was, m.value AS now, CASE b.metric WHEN 'classify' THEN 0.05 WHEN 'found_share' THEN 0.05 ELSE 0 END::DOUBLE AS tolerance FROM b LEFT JOIN m ON m.scope = b.scope AND m.metric = b.metric WHERE b.value IS NOT NULL)
SELECT scope, metric, round(was, 6) AS was, round(now, 6) AS now FROM e WHERE now IS NULL OR round((CASE WHEN metric IN ('declined', 'failed') THEN now - was ELSE was - now END) / 1e-9) > round(tolerance / 1e-9)""")
def regression_gate(spark, d):
    """Runs of even numbers against a baseline of every third run."""
    scores = E.run_scores(D.runs(spark, d))
    now = E.metrics(scores.where("run % 2 = 0"), True).select("scope", "metric", "value")
    was = E.metrics(scores.where("run % 3 = 0"), True).select("scope", "metric", "value")
    bad = E.regressions(now, was, spark.createDataFrame(TOLERANCES, "metric string, tolerance double"))
    return bad.select("scope", "metric", F.round("was", 6).alias("was"), F.round("now", 6).alias("now"))


@catalogue.add("baseline_subset", f"WITH {_SCORES}, s AS {_BOTH('run % 4 <> 1')} {_UNION('s')}")
def baseline_subset(spark, d):
    """A baseline of all runs, counted again for the runs that a current set covers."""
    scores = E.run_scores(D.runs(spark, d))
    return E.baseline_subset(scores, scores.where("run % 4 <> 1"), True).withColumn("value", F.round("value", 6))


#: Candidate thresholds of two steps.
TRIED = [("none", None, None), ("answer .5", None, 0.5), ("answer .75", None, 0.75), ("rerank .85", 0.85, 0.35)]
_TRIED = "(VALUES ('none', NULL, NULL), ('answer .5', NULL, 0.5::FLOAT), ('answer .75', NULL, 0.75::FLOAT), ('rerank .85', 0.85::FLOAT, 0.35::FLOAT)) c(candidate, rerank, answer)"


@catalogue.add("tune_replay", f"""WITH {_SCORES}, r AS (SELECT r.run, CASE WHEN r.total % 9 = 1 THEN 'low_confidence' ELSE r.status END AS outcome, s.correct, r.rerank_score, r.answer_score FROM runs r JOIN scores s ON s.run = r.run),
x AS (SELECT c.candidate, CASE WHEN r.outcome = 'low_confidence' THEN 'declined' WHEN r.outcome = 'answered' AND (coalesce(r.rerank_score < c.rerank, false) OR coalesce(r.answer_score < c.answer, false)) THEN 'declined' ELSE r.outcome END AS o, r.outcome = 'low_confidence' AS u, r.correct FROM r, {_TRIED}),
g AS (SELECT candidate, count(*) FILTER (o = 'answered') AS answered, count(*) FILTER (o = 'declined') AS declined, count(*) FILTER (u) AS unresolved, round(avg(CASE WHEN o = 'answered' THEN correct::INT END), 6) AS precision, round(count(*) FILTER (o = 'declined')::DOUBLE / count(*), 6) AS decline_rate FROM x GROUP BY candidate)
SELECT *, coalesce(precision >= 0.95 AND decline_rate <= 0.4, false) AS gate FROM g""")
def tune_replay(spark, d):
    scored = E.run_scores(D.runs(spark, d)).select("run", "correct")
    runs = D.runs(spark, d).join(scored, "run").select("run", F.when(F.col("total") % 9 == 1, "low_confidence").otherwise(F.col("status")).alias("outcome"), "correct", "rerank_score", "answer_score")
    done = E.tune(E.replay(runs, spark.createDataFrame(TRIED, "candidate string, rerank float, answer float")))
    return done.withColumn("precision", F.round("precision", 6)).withColumn("decline_rate", F.round("decline_rate", 6))


@catalogue.add("golden_select", "SELECT item_id AS id, text AS question FROM benchmark WHERE item_id IN (3, 5, 7)")
def golden_select(spark, d):
    golden = C.questions(spark, d).select(F.col("qid").cast("string").alias("id"), "question")
    return E.select_golden(golden, ["3", "5", "7"]).select(F.col("id").cast("long").alias("id"), "question")


def golden_file(spark, d) -> str:
    """A golden set of all benchmark items as lines of JSON, some of them made bad by their number; a set is one file."""
    n = F.col("item_id")
    category = F.get(F.array(*map(F.lit, ("boolean", "choice", "ranking", "open"))), (n % 4).cast("int"))
    id_ = F.when(n % 11 == 5, " ").when(n % 13 == 6, "same").otherwise(n.cast("string"))
    expected = F.when(n % 8 == 2, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y")))
    line = F.to_json(F.struct(id_.alias("id"), F.when(n % 7 == 3, "  ").otherwise(F.col("text")).alias("question"), category.alias("category"), expected.alias("expected")))
    rows = table(spark, d, "benchmark").select("item_id", F.when(n % 9 == 4, F.concat(F.lit("{"), line)).when(n % 10 == 9, "").otherwise(line).alias("value"))
    path = f"{shared_dir(spark)}/golden-{uuid.uuid4().hex}"
    rows.coalesce(1).sortWithinPartitions("item_id").select("value").write.text(path)
    return path


_GOLDEN = """WITH g AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS line, ['boolean', 'choice', 'ranking', 'open'][(item_id % 4)::INT + 1] AS category, CASE WHEN item_id % 11 = 5 THEN ' ' WHEN item_id % 13 = 6 THEN 'same' ELSE item_id::VARCHAR END AS id, CASE WHEN item_id % 7 = 3 THEN '  ' ELSE text END AS question, item_id % 9 = 4 AS cut, item_id % 9 <> 4 AND item_id % 10 = 9 AS empty FROM benchmark),
f AS (SELECT *, min(line) FILTER (NOT cut AND NOT empty) OVER (PARTITION BY id) AS first FROM g), p AS (SELECT *, CASE WHEN empty THEN NULL WHEN cut THEN 'malformed' WHEN trim(id) = '' THEN 'blank id' WHEN line > first THEN 'repeated id' WHEN trim(question) = '' THEN 'blank question' WHEN category = 'ranking' AND item_id % 8 = 2 THEN 'ranking of one' END AS problem FROM f)"""


@catalogue.add("golden_validate", f"{_GOLDEN} SELECT line, problem FROM p WHERE problem IS NOT NULL")
def golden_validate(spark, d):
    return E.validate_golden(numbered_lines(spark, golden_file(spark, d))).select("line", "problem")


@catalogue.add("run_store_dedupe", f"""{WITH}, b AS (SELECT 'r' || (qid * 2 + CASE WHEN turn > 2 THEN 1 ELSE 0 END) AS id, turn AS arrived, role AS outcome, qid FROM turns)
SELECT id, arrived, outcome, row_number() OVER (PARTITION BY id ORDER BY arrived) = 1 AND id NOT IN (SELECT 'r' || qid * 2 FROM totals WHERE total % 3 = 0) AS stored FROM b""")
def run_store_dedupe(spark, d):
    """Turns arrive as two runs a conversation; a third of the first ones is stored already."""
    batch = D.turns(spark, d).select(F.concat(F.lit("r"), F.col("qid") * 2 + F.when(F.col("turn") > 2, 1).otherwise(0)).alias("id"), F.col("turn").alias("arrived"), F.col("role").alias("outcome"))
    stored = D.totals(spark, d).where("total % 3 = 0").select(F.concat(F.lit("r"), F.col("qid") * 2).alias("id"))
    fresh, rejected = U.new_runs(stored, batch)
    return fresh.withColumn("stored", F.lit(True)).union(rejected.withColumn("stored", F.lit(False)))


_STEP = "CASE role WHEN 'system' THEN 'answer' WHEN 'user' THEN 'retrieve' WHEN 'assistant' THEN 'explain' END"


@catalogue.add("run_lookup", f"{WITH} SELECT qid AS id, count(*) AS entries, string_agg({_STEP}, ';' ORDER BY turn) AS steps FROM turns WHERE qid IN (SELECT item_id FROM benchmark) GROUP BY qid")
def run_lookup(spark, d):
    """The runs that the benchmark's items name."""
    found = U.look_up(D.traces(spark, d), C.questions(spark, d).select(F.col("qid").alias("id")))
    return found.select("id", F.size("entries").cast("long").alias("entries"), F.array_join(F.transform("entries", lambda e: U.field(e, "$.step")), ";").alias("steps"))


@catalogue.add("trace_redact", f"{WITH} SELECT qid AS id, string_agg(concat_ws(',', CASE WHEN n % 3 <> 0 THEN id END, CASE WHEN n % 2 <> 0 THEN coalesce(prev_id, 'talk:none#t0') END), ';' ORDER BY turn) AS seen FROM turns GROUP BY qid")
def trace_redact(spark, d):
    rows = D.traces(spark, d).select("id", U.without_denials(F.col("trace")).alias("entries"))
    checks = lambda e: F.try_variant_get(e, "$.access", "array<variant>")
    return rows.select("id", F.array_join(F.transform("entries", lambda e: F.array_join(F.transform(checks(e), lambda a: U.field(a, "$.chunk")), ",")), ";").alias("seen"))


@catalogue.add("trace_migrate", f"""{WITH}, a AS (SELECT qid, bool_or(role = 'system') AS answered FROM turns GROUP BY qid),
e AS (SELECT t.qid, turn, '{{"access":[{{"allowed":' || (n % 3 <> 0)::VARCHAR || ',"chunk":' || to_json(id) || '}},{{"allowed":' || (n % 2 <> 0)::VARCHAR || ',"chunk":' || to_json(coalesce(prev_id, 'talk:none#t0')) || '}}],"record":{{' || CASE WHEN role = 'assistant' AND turn % 5 <> 4 AND answered THEN '"contradicts_verdict":' || (n % 2 = 0)::VARCHAR || ',' ELSE '' END
 || CASE WHEN turn % 5 = 4 THEN '"extra":{{"n":' || n || ',"tags":[' || to_json(role) || ',"x"]}},"kind":"future"' ELSE '"kind":' || to_json({_STEP}) END || ',"raw":' || to_json(text) || '}},"step":' || to_json({_STEP}) || '}}' AS j FROM turns t JOIN a ON a.qid = t.qid)
SELECT qid AS id, sha256('[' || string_agg(j, ',' ORDER BY turn) || ']') AS trace_sha256, length('[' || string_agg(j, ',' ORDER BY turn) || ']') AS n_chars FROM e GROUP BY qid""")
def trace_migrate(spark, d):
    """Whole migrated traces as JSON: nothing unknown is lost."""
    rows = materialize(D.traces(spark, d).select("id", U.as_json(U.migrate_trace(F.col("trace"))).alias("trace")), "migrated")
    return rows.select("id", F.sha2("trace", 256).alias("trace_sha256"), F.char_length("trace").cast("long").alias("n_chars"))


@catalogue.add("acl_migrate", f"""WITH {C.SQL} SELECT document_id, array_to_string(list_sort(list_distinct(list_transform(list_concat(acl, [d.source, upper(x.lang), 'Ana ' || d.source, d.source]), lambda a: CASE WHEN regexp_matches(a, '^(role|user):') THEN a WHEN regexp_matches(a, '^[a-z0-9_.:-]+$') THEN 'role:' || a ELSE 'user:' || a END))), ';') AS acl
 FROM docs d JOIN documents x ON x.doc_id::VARCHAR = d.external_id""")
def acl_migrate(spark, d):
    """Lists of all documents, with entries from before entries had tags."""
    lang = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("external_id"), "lang")
    rows = C.documents(spark, d).join(lang, "external_id").select("document_id", F.concat("acl", F.array(F.col("source"), F.upper("lang"), F.concat(F.lit("Ana "), F.col("source")), F.col("source"))).alias("acl"))
    return rows.select("document_id", F.array_join(U.migrate_acl(F.col("acl")), ";").alias("acl"))
