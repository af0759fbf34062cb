"""The steps of answering, each a table of questions or claims to a table. Probabilities and scores are 32-bit floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions import text as T
from quillstack.session import broadcast_small

CATEGORIES = ("boolean", "choice", "ranking", "open")
#: Cutoffs of admission: injection, relevance, contradiction, evidence.
CUTOFFS = (0.7, 0.45, 0.7, 0.55)


def f32(x: float) -> Column:
    return F.lit(x).cast("float")


def one_of(probabilities: list[str]) -> Column:
    """Place of the largest of the columns; of equals the last."""
    best = F.greatest(*probabilities)
    out = F.lit(None).cast("int")
    for i, p in enumerate(probabilities):
        out = F.when(F.col(p) == best, i).otherwise(out)
    return out


def classify(rows: DataFrame, least: float | None) -> DataFrame:
    """The likeliest category; one under `least` falls back to open and keeps its score."""
    p = [f"p_{c}" for c in CATEGORIES]
    raw = F.get(F.array(*map(F.lit, CATEGORIES)), one_of(p))
    rows = rows.withColumn("raw", raw).withColumn("score", F.greatest(*p))
    low = F.lit(False) if least is None else (F.col("score") < f32(least)) & (F.col("raw") != "open")
    return rows.withColumn("category", F.when(low, "open").otherwise(F.col("raw"))).withColumn("fallback_from", F.when(low, F.col("raw")))


def gate(rows: DataFrame, general: DataFrame, by_category: DataFrame) -> DataFrame:
    """`passed`, `declined` (under the threshold) or `failed` (a threshold but no score); a category's own threshold first."""
    own = by_category.select("step", "category", F.col("threshold").alias("own"))
    rows = rows.join(broadcast_small(general), "step", "left").join(broadcast_small(own), ["step", "category"], "left").withColumn("threshold", F.coalesce("own", "threshold")).drop("own")
    outcome = F.when(F.col("threshold").isNull(), "passed").when(F.col("score").isNull(), "failed").when(F.col("score") < F.col("threshold"), "declined").otherwise("passed")
    return rows.withColumn("outcome", outcome)


def _reciprocal(place: Column, authoritative: Column, penalty: int) -> Column:
    return (F.lit(1.0) / (60 + place + F.when(authoritative, 0).otherwise(penalty))).cast("float")


def rerank(matches: DataFrame, keep: int, penalty: int = 10, candidates: int | None = None) -> DataFrame:
    """The best matches of each question by place, evidence behind by `penalty` places, and the context of those kept.

    `place` is the order of retrieval. With `candidates`, the judged probability `p` of that many first matches has a
    place of its own, and both places count. Rows with `context_for` (the column may be absent) aren't ranked: they stay
    if their match does. `rank` has all matches before all context, `reading` each match before its own context;
    `step_score` is the best judged probability that was kept.
    """
    order = Window.partitionBy("qid")
    if "context_for" not in matches.columns:
        matches = matches.withColumn("context_for", F.lit(None).cast("string"))
    own = matches.where("context_for is null").withColumn("place", F.row_number().over(order.orderBy("place")) - 1)
    if candidates is None:
        scored = own.withColumn("key", _reciprocal(F.col("place"), F.col("authoritative"), penalty)).withColumn("score", F.lit(None).cast("float"))
    else:
        judged = own.where(F.col("place") < candidates).withColumn("judged", F.row_number().over(order.orderBy(F.desc("p"), "place")) - 1)
        both = _reciprocal(F.col("place"), F.col("authoritative"), penalty) + _reciprocal(F.col("judged"), F.col("authoritative"), penalty)
        scored = judged.withColumn("key", both.cast("float")).withColumn("score", F.col("p").cast("float")).drop("judged")
    best = scored.withColumn("match_rank", F.row_number().over(order.orderBy(F.desc("key"), "place"))).where(F.col("match_rank") <= keep).drop("key")
    riding = matches.where("context_for is not null").join(best.select("qid", F.col("id").alias("context_for"), "match_rank"), ["qid", "context_for"])
    rows = best.unionByName(riding, allowMissingColumns=True)
    context = F.col("context_for").isNotNull()
    number = lambda *by: F.row_number().over(order.orderBy(*by)).cast("long")
    rows = rows.withColumn("rank", number(context, "match_rank", "place")).withColumn("reading", number("match_rank", context, "place"))
    return rows.withColumn("step_score", F.max("score").over(order)).drop("match_rank")


def admit(rows: DataFrame, cutoffs: tuple[float, float, float, float] = CUTOFFS) -> DataFrame:
    """The route of each source: the first cutoff that is crossed. Context (context_for) follows its match unless it injects."""
    inj, rel, con, ev = map(f32, cutoffs)
    route = F.when(F.col("injection") > inj, "injection").when(F.col("relevance") < rel, "irrelevant").when(F.col("contradiction") > con, "conflict").when(F.col("evidence") >= ev, "admitted").otherwise("no_evidence")
    own = rows.withColumn("route", F.when(F.col("context_for").isNull(), route).when(F.col("injection") > inj, "injection"))
    match = own.where("context_for is null").select("qid", F.col("id").alias("context_for"), F.col("route").alias("followed"))
    out = own.join(match, ["qid", "context_for"], "left").withColumn("route", F.coalesce("route", "followed")).drop("followed")
    return out.withColumn("kept", F.col("route").isin("admitted", "conflict"))


def verdict(p: Column) -> tuple[Column, Column]:
    """(yes, confidence) of a judged probability."""
    return p >= f32(0.5), F.greatest(p, (F.lit(1).cast("float") - p)).cast("float")


def answer_state(sources: DataFrame, most: int = T.JUDGED) -> DataFrame:
    """(qid, state): numbered sources in order, cut at `most` characters in all."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("text"))
    lines = sources.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    return lines.select("qid", F.left(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit(most)).alias("state"))


def citations(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """A row a citation of claims (qid, claim, text, cited array): its place and whether the run has such a source (qid, id)."""
    cited = claims.select("qid", "claim", F.posexplode_outer("cited").alias("place", "id"))
    return cited.join(sources.select("qid", "id", F.lit(True).alias("found")), ["qid", "id"], "left").withColumn("known", F.coalesce("found", F.lit(False))).drop("found")


def membership(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Each claim's verdict: uncited, unknown_citation or passed."""
    by = citations(claims, sources).groupBy("qid", "claim").agg(F.count("id").alias("cited"), F.count_if(F.col("id").isNotNull() & ~F.col("known")).alias("unknown"))
    return by.withColumn("verdict", F.when(F.col("cited") == 0, "uncited").when(F.col("unknown") > 0, "unknown_citation").otherwise("passed"))


def quotes(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Does every quotation of a claim stand in one of its sources (qid, id, text)?"""
    held = citations(claims, sources).join(sources.select("qid", "id", F.col("text").alias("source_text")), ["qid", "id"], "left")
    texts = held.groupBy("qid", "claim").agg(F.collect_list("source_text").alias("texts"))
    return claims.join(texts, ["qid", "claim"]).select("qid", "claim", T.quotes_found(F.col("text"), F.col("texts")).alias("quotes_found"))


def support(judged: DataFrame, least: float) -> DataFrame:
    """Verdict of each claim from its citations (qid, claim, place, supports, contradicts): the first in order that supports
    it enough decides; else one that contradicts it enough; else it is unsupported."""
    first = F.min(F.when(F.col("supports") >= f32(least), F.col("place")))
    by = judged.groupBy("qid", "claim").agg(first.alias("first"), F.max(F.col("contradicts") >= f32(least)).alias("against"))
    return by.select("qid", "claim", F.when(F.col("first").isNotNull(), "supported").when(F.col("against"), "contradicted").otherwise("unsupported").alias("verdict"), F.col("first").cast("int").alias("by_place"))


def publish(claims: DataFrame, policy: str) -> DataFrame:
    """Outcome of each run from its claims' `passed`: decline at the first failed claim, or strip the failed ones."""
    by = claims.groupBy("qid").agg(F.count(F.lit(1)).alias("claims"), F.count_if("passed").alias("passed"))
    failed = F.col("claims") - F.col("passed")
    outcome = F.when(F.col("passed") == 0, "declined").when((failed > 0) & F.lit(policy == "decline"), "declined").otherwise("answered")
    return by.select("qid", "claims", "passed", F.when((outcome == "answered"), failed).otherwise(F.lit(0)).cast("long").alias("stripped"), outcome.alias("outcome"))


def verify(claims: DataFrame, sources: DataFrame, judged: DataFrame | None = None, least: float = 0.75) -> DataFrame:
    """(qid, claim, verdict, passed) of claims (qid, claim, text, cited) against their run's sources (qid, id, text).

    The first that applies: uncited, unknown_citation, misquoted; then, with `judged` (as `support` takes it), supported,
    contradicted or unsupported, where a claim that nobody judged is unsupported; without it, passed.
    """
    rows = membership(claims, sources).select("qid", "claim", F.col("verdict").alias("cites")).join(quotes(claims, sources), ["qid", "claim"], "left")
    backed = F.lit("passed")
    if judged is not None:
        rows = rows.join(support(judged, least).select("qid", "claim", F.col("verdict").alias("support")), ["qid", "claim"], "left")
        backed = F.coalesce("support", F.lit("unsupported"))
    verdict = F.when(F.col("cites") != "passed", F.col("cites")).when(~F.coalesce("quotes_found", F.lit(False)), "misquoted").otherwise(backed)
    return rows.select("qid", "claim", verdict.alias("verdict")).withColumn("passed", F.col("verdict").isin("passed", "supported"))


def number_citations(claims: DataFrame) -> DataFrame:
    """(qid, id, number): cited sources numbered by first use."""
    used = claims.select("qid", "claim", F.posexplode("cited").alias("place", "id")).groupBy("qid", "id").agg(F.min(F.struct("claim", "place")).alias("first"))
    return used.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("first")).cast("long").alias("number"))


def prompt(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """(qid, prompt): the escaped question and its sources in order (id, rank, title, heading, authoritative, text), as
    elements; a source's text can neither close its element nor begin another. Questions with a `verdict` are told it."""
    held = lambda name, c: F.concat(F.lit(f' {name}="'), T.escape_markup(c), F.lit('"'))
    heading = F.when(F.col("heading").isNotNull(), held("heading", F.col("heading"))).otherwise(F.lit(""))
    standing = F.when(F.col("authoritative"), "true").otherwise("false")
    one = F.concat(F.lit("<source"), held("chunk_id", F.col("id")), held("title", F.col("title")), heading, held("authoritative", standing), F.lit(">\n"), T.escape_markup(F.col("text")), F.lit("\n</source>\n"))
    by = sources.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", one.alias("x")))).alias("all")).select("qid", F.array_join(F.transform("all", lambda s: s["x"]), "").alias("sources"))
    said = F.lit("")
    if "verdict" in questions.columns:
        said = F.when(F.col("verdict").isNull(), "").otherwise(F.concat(F.lit("\n\n<verdict>"), F.when(F.col("verdict"), "yes").otherwise("no"), F.lit("</verdict>")))
    text = F.concat(F.lit("<question>\n"), T.escape_markup(F.col("question")), F.lit("\n</question>\n\n<sources>\n"), F.coalesce("sources", F.lit("")), F.lit("</sources>"), said)
    return questions.join(by, "qid", "left").select("qid", text.alias("prompt"))


def reply_schema(sources: DataFrame, verdict: bool = False) -> DataFrame:
    """(qid, schema): the JSON schema of a reply, in which claims cite the run's own sources (qid, id, rank) alone; replies
    that explain a verdict say whether the sources contradict it."""
    text = lambda **more: F.struct(F.lit("string").alias("type"), *[v.alias(k) for k, v in more.items()])
    closed = lambda properties, *required: F.struct(F.lit("object").alias("type"), properties.alias("properties"), F.array(*map(F.lit, required)).alias("required"), F.lit(False).alias("additionalProperties"))
    ids = F.struct(F.lit("array").alias("type"), text(enum=F.col("ids")).alias("items"), F.lit(1).alias("minItems"))
    claims = F.struct(F.lit("array").alias("type"), closed(F.struct(text().alias("text"), ids.alias("chunk_ids")), "text", "chunk_ids").alias("items"))
    flag = [F.struct(F.lit("boolean").alias("type")).alias("contradicts_verdict")] if verdict else []
    whole = closed(F.struct(claims.alias("claims"), *flag), *(["claims", "contradicts_verdict"] if verdict else ["claims"]))
    by = sources.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    return by.select("qid", F.to_json(whole).alias("schema"))


#: A chunk's id: a source, a colon, and a document and a locator parted by a number sign.
CHUNK_ID = "^[a-z0-9_-]+:[^#]*#"


def parse_explanation(rows: DataFrame) -> DataFrame:
    """Claims of a model's JSON reply `raw`: trimmed, citations once each; `contradicts` is its flag, and `problem` says what
    makes a reply unusable: malformed, no_claims, or the first claim's fault of blank_claim, blank_id and malformed_id."""
    schema = "claims array<struct<text: string, chunk_ids: array<string>>>, contradicts_verdict boolean, _bad string"
    parsed = rows.withColumn("_reply", F.from_json("raw", schema, {"columnNameOfCorruptRecord": "_bad"}))
    said = F.transform("_reply.claims", lambda c: F.struct(F.trim(c["text"]).alias("text"), F.array_distinct(F.transform(c["chunk_ids"], lambda i: F.trim(i))).alias("cited")))
    parsed = parsed.withColumn("claims", said).withColumn("contradicts", F.coalesce("_reply.contradicts_verdict", F.lit(False)))
    lacks = F.exists("claims", lambda c: c["text"].isNull() | c["cited"].isNull())
    id_fault = lambda c: F.get(F.filter(F.transform(c["cited"], lambda i: F.when(i == "", "blank_id").when(~i.rlike(CHUNK_ID), "malformed_id")), lambda x: x.isNotNull()), F.lit(0))
    faults = F.filter(F.transform("claims", lambda c: F.when(c["text"] == "", "blank_claim").otherwise(id_fault(c))), lambda x: x.isNotNull())
    problem = F.when(F.col("claims").isNull() | F.col("_reply._bad").isNotNull() | lacks, "malformed").when(F.size("claims") == 0, "no_claims").otherwise(F.get(faults, F.lit(0)))
    return parsed.withColumn("problem", problem).drop("_reply")


def run_pipeline(questions: DataFrame, matches: DataFrame, keep: int = 5, replies: DataFrame | None = None, judged: DataFrame | None = None, policy: str = "decline") -> DataFrame:
    """Classify, rerank, admit, decide, explain and verify for whole tables; a halted question takes no later step.

    `questions` has the category probabilities and p_yes; `matches` the retrieval order and the screens, and the texts
    if there are `replies` (qid, raw), which are then read and their claims verified against the admitted sources; a
    question without a reply, with an unusable one, or with one that contradicts its verdict, halts at explain. Returns qid, category, halted_at, outcome, sources.
    """
    q = classify(questions, 0.6).withColumn("halted_at", F.lit(None).cast("string"))
    ranked = rerank(matches, keep)
    some = ranked.select("qid").distinct().withColumn("retrieved", F.lit(True))
    q = q.join(some, "qid", "left").withColumn("halted_at", F.when(F.col("retrieved").isNull(), "retrieve"))
    kept = admit(ranked).where("kept")
    admitted = kept.groupBy("qid").agg(F.count(F.lit(1)).alias("sources"))
    q = q.join(admitted, "qid", "left").withColumn("halted_at", F.coalesce("halted_at", F.when(F.col("sources").isNull(), "admit")))
    yes, sure = verdict(F.col("p_yes"))
    q = q.withColumn("halted_at", F.coalesce("halted_at", F.when((F.col("category") == "boolean") & (sure < f32(0.7)), "answer")))
    if replies is not None:
        told = parse_explanation(replies.join(q.where("halted_at is null").select("qid"), "qid", "left_semi"))
        # An open question's flag means nothing; a verdict that the reply contradicts is declined, whatever else it says.
        told = told.join(q.select("qid", (F.col("category") == "boolean").alias("judged")), "qid")
        usable = told.where("problem is null and not (judged and contradicts)")
        claims = usable.select("qid", F.posexplode("claims").alias("claim", "c")).select("qid", "claim", "c.text", F.coalesce("c.cited", F.array().cast("array<string>")).alias("cited"))
        published = publish(verify(claims, kept.select("qid", "id", "text"), judged), policy).select("qid", F.col("outcome").alias("published"))
        q = q.join(usable.select("qid", F.lit(True).alias("explained")), "qid", "left").join(published, "qid", "left")
        late = F.when(F.col("explained").isNull(), "explain").when(F.col("published") == "declined", "verify")
        q = q.withColumn("halted_at", F.coalesce("halted_at", late))
    outcome = F.when(F.col("halted_at").isNotNull(), "declined").when(F.col("category") == "boolean", F.when(yes, "yes").otherwise("no")).otherwise("explained")
    return q.select("qid", "category", "halted_at", outcome.alias("outcome"), F.coalesce("sources", F.lit(0)).cast("long").alias("sources"))
