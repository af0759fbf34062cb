"""Queries of the answering steps over the runs that conversations stand for, and over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.functions import text as T
from quillstack.operators import steps as S
from quillstack.operators import trace as R
from quillstack.plans.inline import Catalogue
from quillstack.sources import corpus as C
from quillstack.sources import derived as D

catalogue = Catalogue()
f64 = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
WITH = f"WITH {D.SQL}"

_CLASSES = """greatest(p_boolean, p_choice, p_ranking, p_open) AS m FROM asked), classes AS (SELECT *, CASE WHEN p_open = m THEN 'open' WHEN p_ranking = m THEN 'ranking' WHEN p_choice = m THEN 'choice' ELSE 'boolean' END AS raw FROM p),
classified AS (SELECT *, CASE WHEN raw <> 'open' AND m < 0.6::FLOAT THEN 'open' ELSE raw END AS category, CASE WHEN raw <> 'open' AND m < 0.6::FLOAT THEN raw END AS fallback_from FROM classes)"""


@catalogue.add("classify_fallback", f"{WITH}, p AS (SELECT *, {_CLASSES} SELECT qid, raw, category, fallback_from, round(m::DOUBLE, 6) AS score FROM classified")
def classify_fallback(spark, d):
    return S.classify(D.asked(spark, d), 0.6).select("qid", "raw", "category", "fallback_from", f64("score"))


#: Thresholds of a configuration; what they are held against are the turns.
GENERAL, OWN = [("rerank", 0.5), ("answer", 0.6)], [("answer", "boolean", 0.7)]


@catalogue.add("threshold_gate", f"""{WITH}, s AS (SELECT qid, turn, ['answer', 'rerank', 'verify'][(turn % 3)::INT + 1] AS step, ['boolean', 'open'][(n % 2)::INT + 1] AS category, CASE WHEN n % 7 <> 0 THEN (n * 3 % 101 / 100.0::DOUBLE)::FLOAT END AS score FROM turns),
h AS (SELECT *, CASE WHEN step = 'answer' AND category = 'boolean' THEN 0.7::FLOAT WHEN step = 'answer' THEN 0.6::FLOAT WHEN step = 'rerank' THEN 0.5::FLOAT END AS threshold FROM s)
SELECT qid, turn, CASE WHEN threshold IS NULL THEN 'passed' WHEN score IS NULL THEN 'failed' WHEN score < threshold THEN 'declined' ELSE 'passed' END AS outcome FROM h""")
def threshold_gate(spark, d):
    pick = lambda c, *v: F.get(F.array(*map(F.lit, v)), (F.col(c) % len(v)).cast("int"))
    rows = D.turns(spark, d).select("qid", "turn", pick("turn", "answer", "rerank", "verify").alias("step"), pick("n", "boolean", "open").alias("category"), F.when(F.col("n") % 7 != 0, D.share("n", 3)).alias("score"))
    return S.gate(rows, spark.createDataFrame(GENERAL, "step string, threshold float"), spark.createDataFrame(OWN, "step string, category string, threshold float")).select("qid", "turn", "outcome")


_KEY = lambda place: f"(1.0::DOUBLE / (60 + {place} + CASE WHEN authoritative THEN 0 ELSE 10 END))::FLOAT"
_RANKED = f"""own AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) - 1 AS spot FROM sources WHERE context_for IS NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {_KEY("spot")} DESC, spot) AS r FROM own QUALIFY r <= {{keep}}),
riding AS (SELECT * EXCLUDE (place, r), place, r, 0 AS c FROM (SELECT * EXCLUDE (spot) FROM best) UNION ALL SELECT s.* EXCLUDE (place), s.place, b.r, 1 FROM sources s JOIN best b ON b.qid = s.qid AND b.id = s.context_for),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c, r, place) AS rank, row_number() OVER (PARTITION BY qid ORDER BY r, c, place) AS reading FROM riding)"""


@catalogue.add("rerank_order", f"{WITH}, {_RANKED.format(keep=3)} SELECT qid, id, r AS rank FROM best")
def rerank_order(spark, d):
    """Matches alone: context is left out before it is ranked."""
    return S.rerank(D.sources(spark, d).where("context_for is null"), 3).select("qid", "id", "rank")


@catalogue.add("rerank_judged", f"""{WITH}, {_RANKED.format(keep=3)}, j AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY p DESC, spot) - 1 AS judged FROM own WHERE spot < 4)
SELECT qid, id, round(p::DOUBLE, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY ({_KEY("spot")} + {_KEY("judged")})::FLOAT DESC, spot) AS rank, round(max(p) OVER (PARTITION BY qid)::DOUBLE, 6) AS most FROM j QUALIFY rank <= 3""")
def rerank_judged(spark, d):
    rows = S.rerank(D.sources(spark, d).where("context_for is null"), 3, candidates=4)
    judged = D.sources(spark, d).where("context_for is null")  # the best judged of those that were candidates
    spot = F.row_number().over(S.Window.partitionBy("qid").orderBy("place"))
    most = judged.withColumn("spot", spot).where("spot <= 4").groupBy("qid").agg(F.round(F.max("p").cast("double"), 6).alias("most"))
    return rows.join(most, "qid").select("qid", "id", f64("score"), "rank", "most")


@catalogue.add("rerank_context", f"{WITH}, {_RANKED.format(keep=2)} SELECT qid, id, context_for, rank, reading FROM ranked")
def rerank_context(spark, d):
    return S.rerank(D.sources(spark, d), 2).select("qid", "id", "context_for", "rank", "reading")


_ROUTED = """m AS (SELECT *, CASE WHEN injection > 0.7::FLOAT THEN 'injection' WHEN context_for IS NOT NULL THEN NULL WHEN relevance < 0.45::FLOAT THEN 'irrelevant' WHEN contradiction > 0.7::FLOAT THEN 'conflict' WHEN evidence >= 0.55::FLOAT THEN 'admitted' ELSE 'no_evidence' END AS own FROM {rows}),
routed AS (SELECT a.qid, a.id, a.text, coalesce(a.own, b.own) AS route, coalesce(a.own, b.own) IN ('admitted', 'conflict') AS kept FROM m a LEFT JOIN m b ON b.qid = a.qid AND b.id = a.context_for AND b.context_for IS NULL)"""


@catalogue.add("admit_route", f"{WITH}, {_ROUTED.format(rows='sources')} SELECT qid, id, route, kept FROM routed")
def admit_route(spark, d):
    return S.admit(D.sources(spark, d)).select("qid", "id", "route", "kept")


@catalogue.add("answer_verdict", f"{WITH} SELECT qid, p_yes >= 0.5::FLOAT AS yes, round(greatest(p_yes, (1::FLOAT - p_yes)::FLOAT)::DOUBLE, 6) AS confidence FROM asked")
def answer_verdict(spark, d):
    yes, sure = S.verdict(F.col("p_yes"))
    return D.asked(spark, d).select("qid", yes.alias("yes"), F.round(sure.cast("double"), 6).alias("confidence"))


@catalogue.add("answer_state", f"""WITH {C.SQL} SELECT document_id AS qid, left(string_agg('[' || (ordinal + 1) || '] ' || text, chr(10) ORDER BY ordinal), 16000) AS state FROM chunks GROUP BY document_id""")
def answer_state(spark, d):
    """All lines of each document, cut at the operator's own limit."""
    return S.answer_state(C.chunks(spark, d).select(F.col("document_id").alias("qid"), (F.col("ordinal") + 1).alias("rank"), "text"))


@catalogue.add("verify_membership", f"""{WITH} SELECT c.qid, c.claim, CASE WHEN count(x.id) = 0 THEN 'uncited' WHEN count(x.id) > count(s.id) THEN 'unknown_citation' ELSE 'passed' END AS verdict
 FROM claims c LEFT JOIN cited x ON x.qid = c.qid AND x.claim = c.claim LEFT JOIN claim_sources s ON s.qid = x.qid AND s.id = x.id GROUP BY c.qid, c.claim""")
def verify_membership(spark, d):
    return S.membership(D.claims(spark, d), D.claim_sources(spark, d)).select("qid", "claim", "verdict")


_PLAIN = lambda x: f"""regexp_replace(lower({x}), '[\\s`"''“”‘’]+', '', 'g')"""
_QUOTED = f"""held AS (SELECT c.qid, c.claim, c.text, count(x.id) AS n_cited, count(s.id) AS n_known, coalesce(list({_PLAIN("s.text")}) FILTER (s.id IS NOT NULL), []) AS plain
 FROM claims c LEFT JOIN cited x ON x.qid = c.qid AND x.claim = c.claim LEFT JOIN claim_sources s ON s.qid = x.qid AND s.id = x.id GROUP BY c.qid, c.claim, c.text),
spans AS (SELECT * EXCLUDE (text), list_filter(list_transform(regexp_extract_all(text, '`[^`]*`|"[^"]*"|“[^”]*”'), lambda q: q[2:len(q) - 1]), lambda q: trim(q) <> '') AS spans FROM held),
quoted AS (SELECT *, len(list_filter(spans, lambda q: len(list_filter(plain, lambda s: contains(s, {_PLAIN("q")}))) = 0)) = 0 AS quotes_found FROM spans)"""


@catalogue.add("quote_check", f"{WITH}, {_QUOTED} SELECT qid, claim, quotes_found FROM quoted")
def quote_check(spark, d):
    return S.quotes(D.claims(spark, d), D.claim_sources(spark, d))


_SUPPORT = """backed AS (SELECT qid, claim, CASE WHEN min(place) FILTER (supports >= 0.75::FLOAT) IS NOT NULL THEN 'supported' WHEN max(contradicts) >= 0.75::FLOAT THEN 'contradicted' ELSE 'unsupported' END AS verdict,
 min(place) FILTER (supports >= 0.75::FLOAT) AS by_place FROM votes GROUP BY qid, claim)"""


@catalogue.add("verify_support", f"{WITH}, {_SUPPORT} SELECT qid, claim, verdict, by_place::INT AS by_place FROM backed")
def verify_support(spark, d):
    return S.support(D.votes(spark, d), 0.75)


_VERIFIED = f"""{_QUOTED}, {_SUPPORT}, verified AS (SELECT q.qid, q.claim, CASE WHEN n_cited = 0 THEN 'uncited' WHEN n_cited > n_known THEN 'unknown_citation' WHEN NOT quotes_found THEN 'misquoted' ELSE coalesce(b.verdict, 'unsupported') END AS verdict
 FROM quoted q LEFT JOIN backed b ON b.qid = q.qid AND b.claim = q.claim)"""


@catalogue.add("verify_claims", f"{WITH}, {_VERIFIED} SELECT qid, claim, verdict FROM verified")
def verify_claims(spark, d):
    return S.verify(D.claims(spark, d), D.claim_sources(spark, d), D.votes(spark, d)).select("qid", "claim", "verdict")


@catalogue.add("verify_publish", f"""{WITH}, c AS (SELECT qid, count(*) AS claims, count(*) FILTER (n % 5 <> 0) AS passed FROM claims GROUP BY qid)
SELECT 'decline' AS policy, qid, claims, passed, 0::BIGINT AS stripped, CASE WHEN passed < claims THEN 'declined' ELSE 'answered' END AS outcome FROM c
UNION ALL SELECT 'strip', qid, claims, passed, CASE WHEN passed = 0 THEN 0 ELSE claims - passed END, CASE WHEN passed = 0 THEN 'declined' ELSE 'answered' END FROM c""")
def verify_publish(spark, d):
    rows = D.claims(spark, d).select("qid", "claim", (F.col("n") % 5 != 0).alias("passed"))
    both = [S.publish(rows, p).select(F.lit(p).alias("policy"), "qid", "claims", "passed", "stripped", "outcome") for p in ("decline", "strip")]
    return both[0].union(both[1])


@catalogue.add("citation_numbering", f"{WITH}, f AS (SELECT qid, id, min({{'claim': claim, 'place': place}}) AS first FROM cited GROUP BY qid, id) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY first) AS number FROM f")
def citation_numbering(spark, d):
    return S.number_citations(D.claims(spark, d))


_ESCAPED = lambda x: f"""replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""


@catalogue.add("explain_prompt", f"""WITH {C.SQL}, e AS (SELECT document_id AS qid, min(title) AS title, string_agg('<source chunk_id="' || {_ESCAPED("id")} || '" title="' || {_ESCAPED("title")} || '" authoritative="' || authoritative::VARCHAR || '">' || chr(10) || {_ESCAPED("text")} || chr(10) || '</source>' || chr(10), '' ORDER BY ordinal) AS x FROM chunks GROUP BY document_id)
SELECT qid, '<question>' || chr(10) || {_ESCAPED("title")} || chr(10) || '</question>' || chr(10) || chr(10) || '<sources>' || chr(10) || x || '</sources>' || chr(10) || chr(10) || '<verdict>' || CASE WHEN length(qid) % 2 = 0 THEN 'yes' ELSE 'no' END || '</verdict>' AS prompt FROM e""")
def explain_prompt(spark, d):
    """All lines of each document as the sources of its title."""
    rows = C.chunks(spark, d).select(F.col("document_id").alias("qid"), "id", F.col("ordinal").alias("rank"), "text", "title", "heading", "authoritative")
    titles = C.documents(spark, d).select(F.col("document_id").alias("qid"), F.col("title").alias("question"), (F.char_length("document_id") % 2 == 0).alias("verdict")).join(rows.select("qid").distinct(), "qid", "left_semi")
    return S.prompt(titles, rows)


@catalogue.add("explain_schema", f"""WITH {C.SQL} SELECT document_id AS qid, '{{"type":"object","properties":{{"claims":{{"type":"array","items":{{"type":"object","properties":{{"text":{{"type":"string"}},"chunk_ids":{{"type":"array","items":{{"type":"string","enum":[' || string_agg(to_json(id)::VARCHAR, ',' ORDER BY ordinal)
 || ']}},"minItems":1}}}},"required":["text","chunk_ids"],"additionalProperties":false}}}},"contradicts_verdict":{{"type":"boolean"}}}},"required":["claims","contradicts_verdict"],"additionalProperties":false}}' AS schema FROM chunks GROUP BY document_id""")
def explain_schema(spark, d):
    """What a reply about each document may say."""
    return S.reply_schema(C.chunks(spark, d).select(F.col("document_id").alias("qid"), "id", F.col("ordinal").alias("rank")), verdict=True)


@catalogue.add("explain_parse", f"""{WITH}, c AS (SELECT c.*, t.total, row_number() OVER (PARTITION BY c.qid ORDER BY claim) = 1 AS first FROM claims c JOIN totals t ON t.qid = c.qid),
i AS (SELECT *, list_concat(list_filter([cited[1], CASE WHEN len(cited) > 1 AND cited[2] <> cited[1] THEN cited[2] END], lambda x: x IS NOT NULL), CASE WHEN first AND total % 7 = 3 THEN [''] WHEN first AND total % 7 = 4 THEN ['no id'] ELSE [] END) AS ids, CASE WHEN total % 7 = 2 AND first THEN '' ELSE trim(text) END AS said FROM c),
s AS (SELECT qid, total, string_agg(said || '[' || array_to_string(ids, ',') || ']', ';' ORDER BY claim) AS said, arg_min(CASE WHEN said = '' THEN 'blank_claim' WHEN list_contains(ids, '') THEN 'blank_id' WHEN list_contains(ids, 'no id') THEN 'malformed_id' END, claim) FILTER (said = '' OR list_contains(ids, '') OR list_contains(ids, 'no id')) AS fault FROM i GROUP BY qid, total)
SELECT qid, CASE WHEN total % 7 = 0 THEN 'malformed' WHEN total % 7 = 1 THEN 'no_claims' ELSE fault END AS problem, total % 7 = 5 AS contradicts, CASE WHEN total % 7 <= 1 THEN '' ELSE said END AS claims FROM s""")
def explain_parse(spark, d):
    shown = F.array_join(F.transform("claims", lambda c: F.concat(c["text"], F.lit("["), F.array_join(c["cited"], ","), F.lit("]"))), ";")
    return S.parse_explanation(D.replies(spark, d)).select("qid", "problem", "contradicts", F.coalesce(shown, F.lit("")).alias("claims"))


@catalogue.add("render_sources", f"""WITH {C.SQL} SELECT document_id, '**Sources**' || chr(10) || string_agg('[' || (ordinal + 1) || '] [' || title || '](' || url || '): ' || CASE WHEN length(trim(text)) > 200 THEN rtrim(left(trim(text), 200)) || '…' ELSE trim(text) END, chr(10) ORDER BY ordinal) AS markdown FROM chunks GROUP BY document_id""")
def render_sources(spark, d):
    """All lines of each document with their excerpts."""
    line = F.concat(F.lit("["), (F.col("ordinal") + 1).cast("string"), F.lit("] ["), F.col("title"), F.lit("]("), F.col("url"), F.lit("): "), T.excerpt(F.col("text")))
    by = C.chunks(spark, d).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", line.alias("x")))).alias("all"))
    return by.select("document_id", F.concat(F.lit("**Sources**\n"), F.array_join(F.transform("all", lambda s: s["x"]), "\n")).alias("markdown"))


for _name in ("answer_state", "explain_prompt", "render_sources"):  # the same under the names they had beside cut ones
    catalogue.add(f"{_name}_whole", catalogue.sql[_name])(catalogue.queries[_name])


_RUN = f"""{{with}}, p AS (SELECT *, {_CLASSES}, {_RANKED.format(keep=5)}, {_ROUTED.format(rows="ranked")}, admitted AS (SELECT qid, count(*) AS sources FROM routed WHERE kept GROUP BY qid), had AS (SELECT DISTINCT qid FROM ranked),
run AS (SELECT q.qid, q.category, q.p_yes, CASE WHEN s.qid IS NULL THEN 'retrieve' WHEN a.sources IS NULL THEN 'admit' WHEN q.category = 'boolean' AND greatest(p_yes, (1::FLOAT - p_yes)::FLOAT) < 0.7::FLOAT THEN 'answer' END AS halted_at, coalesce(a.sources, 0) AS sources
 FROM classified q LEFT JOIN had s ON s.qid = q.qid LEFT JOIN admitted a ON a.qid = q.qid)"""


@catalogue.add("pipeline_e2e", f"""{_RUN.format(**{"with": WITH})} SELECT qid, category, halted_at, CASE WHEN halted_at IS NOT NULL THEN 'declined' WHEN category = 'boolean' THEN CASE WHEN p_yes >= 0.5::FLOAT THEN 'yes' ELSE 'no' END ELSE 'explained' END AS outcome, sources FROM run""")
def pipeline_e2e(spark, d):
    """Classify, rerank, admit and decide for every conversation."""
    return S.run_pipeline(D.asked(spark, d), D.sources(spark, d))


_CHECKED = """checked AS (SELECT *, CASE WHEN role = 'system' THEN 'not_in_acl' WHEN n % 5 = 0 THEN 'no_grant' ELSE 'allowed by reader' END AS decision FROM sources), allowed AS (SELECT * EXCLUDE (decision) FROM checked WHERE decision LIKE 'allowed%')"""
_TRACED = _RUN.replace("FROM sources", "FROM allowed").format(**{"with": f"{WITH}, {_CHECKED}"})


def _traces(spark, d):
    """Traces of all conversations, read by somebody who may not see system turns and texts of every fifth length."""
    labels = [F.when(F.col("role") == "system", F.array(F.lit("role:ops"))).otherwise(F.array().cast("array<string>")).alias("acl"), F.when(F.col("n") % 5 == 0, "confidential").otherwise("internal").alias("sensitivity")]
    asked = D.asked(spark, d)
    scope = asked.select("qid", F.array(F.lit("role:reader")).alias("members"), F.array(F.struct(F.lit("reader").alias("role"), F.lit("internal").alias("clearance"))).alias("grants"))
    return R.run(asked, D.sources(spark, d).select("*", *labels), scope)


@catalogue.add("run_traces", f"""{_TRACED}, a AS (SELECT qid, string_agg(id, ',' ORDER BY place) AS retrieved FROM allowed GROUP BY qid), c AS (SELECT qid, string_agg(id || '=' || decision, ',' ORDER BY place) AS checks FROM checked GROUP BY qid), x AS (SELECT r.qid, string_agg(k.id || '=' || k.route, ',' ORDER BY r.rank) AS routes FROM ranked r JOIN routed k ON k.qid = r.qid AND k.id = r.id GROUP BY r.qid)
SELECT r.qid, 'classify;retrieve' || CASE WHEN halted_at = 'retrieve' THEN '' WHEN halted_at = 'admit' OR category <> 'boolean' THEN ';rerank;admit' ELSE ';rerank;admit;answer' END AS steps, CASE halted_at WHEN 'retrieve' THEN 'no_sources' WHEN 'admit' THEN 'no_admitted_sources' WHEN 'answer' THEN 'low_confidence' END AS reason,
 coalesce(a.retrieved, '') AS retrieved, c.checks, CASE WHEN halted_at IS DISTINCT FROM 'retrieve' THEN x.routes END AS routes FROM run r LEFT JOIN a ON a.qid = r.qid LEFT JOIN c ON c.qid = r.qid LEFT JOIN x ON x.qid = r.qid""")
def run_traces(spark, d):
    record = lambda kind, path, of: F.try_variant_get(R.last_record("trace", kind), path, of)
    shown = lambda a, f: F.array_join(F.transform(a, f), ",")
    steps = F.array_join(F.transform("trace", lambda e: e["step"]), ";")
    checks = F.get(F.filter("trace", lambda e: e["step"] == "retrieve"), F.lit(0))["access"]
    return _traces(spark, d).select(
        "qid", steps.alias("steps"), F.try_element_at("trace", F.lit(-1))["reason"].alias("reason"), shown(record("retrieve", "$.chunks", "array<struct<chunk: string>>"), lambda c: c["chunk"]).alias("retrieved"),
        shown(checks, lambda c: F.concat_ws("=", c["chunk"], c["decision"])).alias("checks"), shown(record("admit", "$.sources", "array<struct<chunk: string, route: string>>"), lambda c: F.concat_ws("=", c["chunk"], c["route"])).alias("routes"),
    )


@catalogue.add("run_trace_scores", f"""{_TRACED}, g AS (SELECT run AS qid, category AS golden, relevant FROM runs), a AS (SELECT qid, list(id ORDER BY place) FILTER (context_for IS NULL) AS found FROM allowed GROUP BY qid), k AS (SELECT qid, list(id ORDER BY rank) AS first FROM ranked GROUP BY qid)
SELECT r.qid AS run, g.golden AS category, r.category = g.golden AS classified, CASE WHEN len(relevant) > 0 THEN len(list_intersect(relevant, coalesce(a.found, [])[1:50]))::DOUBLE / len(relevant) END AS found_share,
 CASE WHEN len(relevant) > 0 AND halted_at IS DISTINCT FROM 'retrieve' THEN list_has_any(coalesce(k.first, [])[1:5], relevant) END AS hit, halted_at IS NOT NULL AS declined
 FROM run r JOIN g ON g.qid = r.qid LEFT JOIN a ON a.qid = r.qid LEFT JOIN k ON k.qid = r.qid""")
def run_trace_scores(spark, d):
    """Scores that are read from the traces' last records."""
    golden = D.runs(spark, d).select(F.col("run").alias("qid"), "category", "relevant")
    return R.scores(_traces(spark, d), golden).select("run", "category", "classified", "found_share", "hit", "declined")
