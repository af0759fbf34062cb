"""Runs, claims, screens, votes and traces, derived by rule from the conversations, for which the test tables have none.

A conversation is a question's run: its turns are the sources in the order of retrieval, assistant turns are claims about
them, and the lengths of texts stand for what a model would judge. Each view has its SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.session import table

STEPS = {"system": "answer", "user": "retrieve", "assistant": "explain"}


def share(n: str, by: int, plus: str = "0") -> Column:
    """A made probability: n * by + plus, modulo 101, in hundredths, as a 32-bit float."""
    return F.expr(f"cast((({n}) * {by} + {plus}) % 101 / 100.0D AS FLOAT)")


def _share(n: str, by: int, plus: str = "0") -> str:
    return f"((({n}) * {by} + {plus}) % 101 / 100.0::DOUBLE)::FLOAT"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, turn, role, text, n (characters), id, and the turn, id and text before it."""
    rows = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null and text is not null")
    named = rows.select(F.col("conv_id").alias("qid"), "turn", "role", "text", F.char_length("text").cast("long").alias("n"), F.concat(F.lit("talk:"), F.col("conv_id"), F.lit("#t"), F.col("turn")).alias("id"))
    order = Window.partitionBy("qid").orderBy("turn")
    return named.select("*", F.lag("id").over(order).alias("prev_id"), F.lag("text").over(order).alias("prev_text"))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid and its characters in all, total."""
    return turns(spark, sf_dir).groupBy("qid").agg(F.sum("n").alias("total"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, total, the four category probabilities and p_yes."""
    parts = [F.expr(f"total div {11**k} % 11") for k in range(4)]
    whole = parts[0] + parts[1] + parts[2] + parts[3] + 1
    p = [(x.cast("double") / whole).cast("float").alias(f"p_{c}") for x, c in zip(parts, ("boolean", "choice", "ranking", "open"), strict=True)]
    return totals(spark, sf_dir).select("qid", "total", *p, share("total", 1).alias("p_yes"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, id, place, text, authoritative, context_for (every third turn is context of the one before), p, four screens, role and n."""
    rows = turns(spark, sf_dir)
    screens = {"p": 3, "injection": 7, "relevance": 13, "contradiction": 17, "evidence": 29}
    return rows.select("qid", "id", F.col("turn").alias("place"), "text", (F.col("role") == "assistant").alias("authoritative"), F.when(F.col("turn") % 3 == 2, F.col("prev_id")).alias("context_for"), *[share("n", k).alias(c) for c, k in screens.items()], "role", "n")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, claim, text, cited, n: assistant turns, some of which quote the turn before or themselves."""
    rows = turns(spark, sf_dir).where("role = 'assistant'")
    first, gone, before = F.concat(F.lit("talk:"), "qid", F.lit("#t0")), F.concat(F.lit("talk:"), "qid", F.lit("#t999999")), F.coalesce("prev_id", F.lit("talk:none#t0"))
    k = F.col("n") % 5
    cited = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(before)).when(k == 2, F.array(before, first)).when(k == 3, F.array(before, gone)).otherwise(F.array(first))
    said = F.expr("CASE n % 3 WHEN 0 THEN text WHEN 1 THEN concat('It says `', translate(replace(coalesce(prev_text, ''), '`', ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '`.') ELSE concat('\"', replace(text, '\"', ''), '\" it says') END")
    return rows.select("qid", F.col("turn").alias("claim"), said.alias("text"), cited.alias("cited"), "n")


def claim_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, id, text of the turns that aren't the assistant's: what claims may cite."""
    return turns(spark, sf_dir).where("role <> 'assistant'").select("qid", "id", "text")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, claim, place, supports, contradicts of each citation; every eleventh length has none."""
    rows = claims(spark, sf_dir).where("n % 11 <> 0").select("qid", "claim", "n", F.posexplode("cited").alias("place", "id"))
    return rows.select("qid", "claim", F.col("place").cast("long").alias("place"), share("n", 1, "31 * place").alias("supports"), share("n", 3, "17 * place").alias("contradicts"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, raw: a model's JSON reply of each conversation with claims; by the total some are malformed, empty or blank."""
    said = F.expr("CASE WHEN total % 7 = 2 AND first THEN '  ' ELSE concat(' ', text) END")
    rows = claims(spark, sf_dir).join(totals(spark, sf_dir), "qid").withColumn("first", F.row_number().over(Window.partitionBy("qid").orderBy("claim")) == 1)
    odd = F.expr("CASE WHEN total % 7 = 3 AND first THEN array(' ') WHEN total % 7 = 4 AND first THEN array('no id') ELSE cast(array() AS array<string>) END")
    by = rows.groupBy("qid", "total").agg(F.sort_array(F.collect_list(F.struct("claim", F.struct(said.alias("text"), F.concat("cited", "cited", odd).alias("chunk_ids")).alias("c")))).alias("all"))
    raw = F.to_json(F.struct(F.transform("all", lambda x: x["c"]).alias("claims"), (F.col("total") % 7 == 5).alias("contradicts_verdict")))
    return by.select("qid", F.when(F.col("total") % 7 == 0, F.concat(F.lit("no json: "), raw)).when(F.col("total") % 7 == 1, F.lit('{"claims":[]}')).otherwise(raw).alias("raw"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored run of each conversation, with what scores need: category, classified_as, status, verdict, expected, the
    relevant, retrieved, reranked and cited ids, the claims' verdicts and whether they were judged; scores of two steps."""
    rows = turns(spark, sf_dir)
    context = F.when(F.col("turn") % 3 == 2, F.col("prev_id"))
    chunk = F.struct(F.col("id"), context.alias("context_for"))
    in_order = lambda key, value: F.transform(F.sort_array(F.collect_list(F.struct(*key, value.alias("v")))), lambda x: x["v"])
    assistant = F.col("role") == "assistant"
    verdict = F.when(F.col("n") % 3 == 0, "supported").when(F.col("n") % 3 == 1, "contradicted").otherwise("unsupported")
    by = rows.groupBy("qid").agg(
        F.sum("n").alias("total"), F.sort_array(F.collect_list(F.when((F.col("role") == "user") & (F.col("turn") % 4 == 0), F.col("id")))).alias("relevant"),
        in_order([F.col("turn")], chunk).alias("retrieved"), in_order([(-F.col("n")).alias("m"), F.col("turn")], chunk).alias("reranked"),
        in_order([F.col("turn")], F.when(assistant, F.coalesce("prev_id", F.lit("talk:none#t0")))).alias("cited"), in_order([F.col("turn")], F.when(assistant, verdict)).alias("verdicts"),
    )
    some = lambda c: F.filter(c, lambda x: x.isNotNull())
    pick = lambda e, *values: F.expr(f"element_at(array({', '.join(repr(v) if v else 'cast(null as string)' for v in values)}), cast({e} as int) + 1)")
    category = pick("total % 4", "boolean", "choice", "ranking", "open")
    return by.select(
        F.col("qid").alias("run"), "total", category.alias("category"), F.when(F.col("total") % 13 == 0, F.lit(None)).when(F.col("total") % 5 == 0, "open").otherwise(category).alias("classified_as"),
        F.when(F.col("total") % 9 == 0, "failed").when(F.col("total") % 9 <= 2, "declined").otherwise("answered").alias("status"), pick("total % 3", "Yes", " no ", None).alias("verdict"), pick("total div 3 % 3", "yes", "NO", None).alias("expected"),
        "relevant", "retrieved", F.slice("reranked", 1, 4).alias("reranked"), F.when(F.col("total") % 6 == 0, F.array(F.lit("elsewhere"))).otherwise(some("cited")).alias("cited"), some("verdicts").alias("verdicts"), (F.col("total") % 2 == 0).alias("judged"),
        F.when(F.col("total") % 8 != 0, share("total", 1)).alias("rerank_score"), F.when(F.col("total") % 10 != 0, share("total", 7)).alias("answer_score"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, trace: a JSON array of entries, one a turn, with step, record and access checks. Some entries have a record kind
    and fields that no schema here knows."""
    rows = turns(spark, sf_dir)
    step = F.create_map(*[F.lit(x) for pair in STEPS.items() for x in pair])[F.col("role")]
    odd = F.col("turn") % 5 == 4
    flag = F.when((F.col("role") == "assistant") & ~odd, F.col("n") % 2 == 0)
    record = F.struct(F.when(odd, "future").otherwise(step).alias("kind"), F.col("text").alias("raw"), flag.alias("contradicts_verdict"), F.when(odd, F.struct(F.col("n").alias("n"), F.array("role", F.lit("x")).alias("tags"))).alias("extra"))
    checks = F.array(F.struct(F.col("id").alias("chunk"), (F.col("n") % 3 != 0).alias("allowed")), F.struct(F.coalesce("prev_id", F.lit("talk:none#t0")).alias("chunk"), (F.col("n") % 2 != 0).alias("allowed")))
    entry = F.struct(step.alias("step"), record.alias("record"), checks.alias("access"))
    by = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("turn", F.to_json(entry).alias("e")))).alias("all"))
    return by.select(F.col("qid").alias("id"), F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["e"]), ","), F.lit("]")).alias("trace"))


_PICK = lambda e, *values: f"[{', '.join(repr(v) if v else 'NULL' for v in values)}][({e})::INT + 1]"
_CATEGORY = _PICK("total % 4", "boolean", "choice", "ranking", "open")
#: The same views for DuckDB.
SQL = f"""turns AS (SELECT *, lag(id) OVER w AS prev_id, lag(text) OVER w AS prev_text FROM (SELECT conv_id AS qid, turn, role, text, length(text) AS n, 'talk:' || conv_id || '#t' || turn AS id FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL) x WINDOW w AS (PARTITION BY qid ORDER BY turn)),
totals AS (SELECT qid, sum(n)::BIGINT AS total FROM turns GROUP BY qid),
shares AS (SELECT *, total % 11 AS a, total // 11 % 11 AS b, total // 121 % 11 AS c, total // 1331 % 11 AS d FROM totals),
asked AS (SELECT qid, total, (a::DOUBLE / (a + b + c + d + 1))::FLOAT AS p_boolean, (b::DOUBLE / (a + b + c + d + 1))::FLOAT AS p_choice, (c::DOUBLE / (a + b + c + d + 1))::FLOAT AS p_ranking, (d::DOUBLE / (a + b + c + d + 1))::FLOAT AS p_open, {_share("total", 1)} AS p_yes FROM shares),
sources AS (SELECT qid, id, turn AS place, text, role = 'assistant' AS authoritative, CASE WHEN turn % 3 = 2 THEN prev_id END AS context_for, {_share("n", 3)} AS p, {_share("n", 7)} AS injection, {_share("n", 13)} AS relevance, {_share("n", 17)} AS contradiction, {_share("n", 29)} AS evidence, role, n FROM turns),
claims AS (SELECT qid, turn AS claim, n, CASE n % 3 WHEN 0 THEN text WHEN 1 THEN 'It says `' || translate(replace(coalesce(prev_text, ''), '`', ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '`.' ELSE '"' || replace(text, '"', '') || '" it says' END AS text,
 CASE n % 5 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [coalesce(prev_id, 'talk:none#t0')] WHEN 2 THEN [coalesce(prev_id, 'talk:none#t0'), 'talk:' || qid || '#t0'] WHEN 3 THEN [coalesce(prev_id, 'talk:none#t0'), 'talk:' || qid || '#t999999'] ELSE ['talk:' || qid || '#t0'] END AS cited FROM turns WHERE role = 'assistant'),
cited AS (SELECT qid, claim, n, unnest(cited) AS id, unnest(range(len(cited))) AS place FROM claims),
claim_sources AS (SELECT qid, id, text FROM turns WHERE role <> 'assistant'),
votes AS (SELECT qid, claim, place, {_share("n", 1, "31 * place")} AS supports, {_share("n", 3, "17 * place")} AS contradicts FROM cited WHERE n % 11 <> 0),
runs AS (SELECT qid AS run, total, {_CATEGORY} AS category, CASE WHEN total % 13 = 0 THEN NULL WHEN total % 5 = 0 THEN 'open' ELSE {_CATEGORY} END AS classified_as, CASE WHEN total % 9 = 0 THEN 'failed' WHEN total % 9 <= 2 THEN 'declined' ELSE 'answered' END AS status,
 {_PICK("total % 3", "Yes", " no ", None)} AS verdict, {_PICK("total // 3 % 3", "yes", "NO", None)} AS expected, relevant, retrieved, reranked[1:4] AS reranked, CASE WHEN total % 6 = 0 THEN ['elsewhere'] ELSE list_filter(cited, lambda x: x IS NOT NULL) END AS cited, list_filter(verdicts, lambda x: x IS NOT NULL) AS verdicts, total % 2 = 0 AS judged,
 CASE WHEN total % 8 <> 0 THEN {_share("total", 1)} END AS rerank_score, CASE WHEN total % 10 <> 0 THEN {_share("total", 7)} END AS answer_score
 FROM (SELECT qid, sum(n)::BIGINT AS total, coalesce(list(id ORDER BY id) FILTER (role = 'user' AND turn % 4 = 0), []) AS relevant, list({{'id': id, 'context_for': CASE WHEN turn % 3 = 2 THEN prev_id END}} ORDER BY turn) AS retrieved, list({{'id': id, 'context_for': CASE WHEN turn % 3 = 2 THEN prev_id END}} ORDER BY n DESC, turn) AS reranked,
  list(CASE WHEN role = 'assistant' THEN coalesce(prev_id, 'talk:none#t0') END ORDER BY turn) AS cited, list(CASE WHEN role = 'assistant' THEN {_PICK("n % 3", "supported", "contradicted", "unsupported")} END ORDER BY turn) AS verdicts FROM turns GROUP BY qid) g)"""
