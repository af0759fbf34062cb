"""Queries over the corpus views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.functions import stemming
from quillstack.functions import text as T
from quillstack.operators import access as A
from quillstack.operators import retrieval as R
from quillstack.operators import vector_index as V
from quillstack.session import broadcast_small, materialize, table
from quillstack.sources import corpus as C
from quillstack.sources import derived as D

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None, views: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = (f"WITH {C.SQL}" + ("" if sql.startswith(",") else " ") if views else "") + sql
        return f

    return add


@query("current_chunks", "SELECT id, version, text FROM history WHERE NOT superseded")
def current_chunks(spark, d):
    return C.chunk_history(spark, d).where("not superseded").select("id", "version", "text")


@query("chunk_documents", "SELECT c.id, c.ordinal, x.title, x.url, x.external_id FROM chunks c JOIN docs x ON c.document_id = x.document_id")
def chunk_documents(spark, d):
    docs = C.documents(spark, d).select("document_id", "title", "url", "external_id")
    return C.chunks(spark, d).select("id", "ordinal", "document_id").join(docs, "document_id").select("id", "ordinal", "title", "url", "external_id")


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9_]+')"


@query("token_index", "SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: trim(x, '_')), lambda x: x <> '' AND len(x) < 64))), ' ') AS tokens FROM chunks")
def token_index(spark, d):
    return C.chunks(spark, d).select("id", F.array_join(F.array_sort(T.token_set(F.col("heading"), F.col("text"))), " ").alias("tokens"))


@query("term_postings", f"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_TOKENS}) AS term FROM chunks) GROUP BY id, term")
def term_postings(spark, d):
    return R.postings(C.chunks(spark, d))


@query("term_stats", f"SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest({_TOKENS}) AS term FROM chunks) GROUP BY term")
def term_stats(spark, d):
    return R.term_stats(C.chunks(spark, d))


@query("corpus_stats", f"SELECT count(*) AS chunks, round(avg(len({_TOKENS})), 6) AS avg_length FROM chunks")
def corpus_stats(spark, d):
    return R.corpus_stats(C.chunks(spark, d)).withColumn("avg_length", F.round("avg_length", 6))


@query("neighbours", "SELECT id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY ordinal)")
def neighbours(spark, d):
    return R.neighbours(C.chunks(spark, d)).select("id", "previous_id", "next_id")


@query("chunk_version", """SELECT id, sha256(CAST(to_json({'title': title, 'heading': heading, 'url': url, 'text': text, 'authoritative': authoritative, 'labels': {'acl': acl, 'sensitivity': sensitivity},
 'embedding_model': {'id': 'fixture', 'version': '1'}}) AS VARCHAR)) AS version FROM chunks""")
def chunk_version(spark, d):
    c = [F.col(x) for x in ("title", "heading", "url", "text", "authoritative", "acl", "sensitivity")]
    return C.chunks(spark, d).select("id", T.chunk_version(*c, *map(F.lit, C.MODEL)).alias("version"))


@query("embedding_input", "SELECT id, title || coalesce(chr(10) || heading, '') || chr(10) || chr(10) || text AS input FROM chunks")
def embedding_input(spark, d):
    return C.chunks(spark, d).select("id", T.embedding_input(F.col("title"), F.col("heading"), F.col("text")).alias("input"))


@query("token_estimate", "SELECT id, CAST(ceil(strlen(text) / 3.0) AS BIGINT) AS tokens FROM chunks")
def token_estimate(spark, d):
    return C.chunks(spark, d).select("id", T.token_estimate(F.col("text")).alias("tokens"))


_ASKED = """SELECT * FROM VALUES (1, 'Does A_OPCODE gate _ROLE_USERS_ or OP24, not op24? ACLS 2024'), (2, ''), (3, 'plain words only'), (4, 'x1 x1 y_2 __ _9_ 42')"""
_IDS = "list_sort(list_distinct(list_transform(list_filter(list_transform(string_split_regex({q}, '[^A-Za-z0-9_]+'), lambda w: trim(w, '_')), lambda w: len(w) < 64 AND regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[_0-9]')), lambda w: lower(w))))"


@query("identifier_terms", f"SELECT qid, array_to_string({_IDS.format(q='question')}, ' ') AS terms FROM (SELECT qid, question FROM questions UNION ALL {_ASKED.replace('SELECT * FROM VALUES', 'SELECT * FROM (VALUES')}) v(qid, question))")
def identifier_terms(spark, d):
    asked = C.questions(spark, d).union(spark.sql(f"{_ASKED} AS v(qid, question)"))
    return asked.select(F.col("qid").cast("long").alias("qid"), F.array_join(T.identifier_terms(F.col("question")), " ").alias("terms"))


@query("excerpt", "SELECT id, CASE WHEN len(trim(text)) > 200 THEN rtrim(left(trim(text), 200)) || '…' ELSE trim(text) END AS excerpt FROM chunks")
def excerpt(spark, d):
    return C.chunks(spark, d).select("id", T.excerpt(F.col("text")).alias("excerpt"))


@query("judged_text", "SELECT id, title || coalesce(' > ' || heading, '') || chr(10) || chr(10) || left(text, 16000) AS judged FROM chunks")
def judged_text(spark, d):
    return C.chunks(spark, d).select("id", T.judged_text(F.col("title"), F.col("heading"), F.col("text")).alias("judged"))


@query("last_user_question", "SELECT conv_id, max_by(text, turn) AS question FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id", views=False)
def last_user_question(spark, d):
    asked = table(spark, d, "conversations").where("role = 'user' and trim(text) <> ''")
    return asked.groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))


@query("model_uniformity", "SELECT superseded, model, count(*) AS chunks, min(model) OVER (PARTITION BY superseded) = max(model) OVER (PARTITION BY superseded) AS uniform FROM history GROUP BY superseded, model")
def model_uniformity(spark, d):
    by = C.chunk_history(spark, d).groupBy("superseded", "model").agg(F.count(F.lit(1)).alias("chunks"))
    span = by.groupBy("superseded").agg((F.min("model") == F.max("model")).alias("uniform"))
    return by.join(span, "superseded").select("superseded", "model", "chunks", "uniform")


@query("constraint_violations", """SELECT id, array_to_string(list_filter([CASE WHEN NOT regexp_matches(source, '^[a-z0-9_-]+$') THEN 'source' END, CASE WHEN sensitivity NOT IN ('public', 'internal') THEN 'sensitivity' END,
 CASE WHEN len(list_filter(acl, lambda x: NOT regexp_matches(x, '^role:[a-z]+$'))) > 0 THEN 'acl' END], lambda x: x IS NOT NULL), ',') AS broken FROM chunks WHERE NOT regexp_matches(source, '^[a-z0-9_-]+$') OR sensitivity NOT IN ('public', 'internal') OR len(list_filter(acl, lambda x: NOT regexp_matches(x, '^role:[a-z]+$'))) > 0""")
def constraint_violations(spark, d):
    """Against a stricter rule set than the corpus keeps, so that something breaks it."""
    checks = {"source": F.col("source").rlike("^[a-z0-9_-]+$"), "sensitivity": F.col("sensitivity").isin("public", "internal"), "acl": F.forall("acl", lambda x: x.rlike("^role:[a-z]+$"))}
    broken = F.concat_ws(",", *[F.when(~c, F.lit(n)) for n, c in checks.items()])
    return C.chunks(spark, d).select("id", broken.alias("broken")).where("broken <> ''")


_STOPPED = ", ".join(f"'{w}'" for w in stemming.STOP)
_WORDS = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"
#: Lexemes of all chunks by the chain of stem rules, as DuckDB's own columns.
_STEMMED = f"""spoken AS (SELECT id, unnest({_WORDS.format(c="coalesce(heading, '')")}) AS word, 1 AS head FROM chunks UNION ALL SELECT id, unnest({_WORDS.format(c="text")}), 0 FROM chunks),
wanted AS (SELECT qid, unnest(list_distinct({_WORDS.format(c="question")})) AS word FROM questions), kept AS (SELECT * FROM spoken WHERE word NOT IN ({_STOPPED})),
vocabulary AS (SELECT DISTINCT word FROM (SELECT word FROM kept UNION ALL SELECT word FROM wanted WHERE word NOT IN ({_STOPPED})) v), stems AS {stemming.stems_sql("vocabulary")},
stemmed AS (SELECT id, stem AS lexeme, sum(head)::BIGINT AS tf_heading, (count(*) - sum(head))::BIGINT AS tf_text, count(*) AS tf FROM kept JOIN stems USING (word) GROUP BY id, stem)"""


@query("stemmed_postings", f", {_STEMMED} SELECT id, lexeme, tf_heading, tf_text, tf FROM stemmed")
def stemmed_postings(spark, d):
    return R.stemmed_postings(C.chunks(spark, d))


@query("stemmed_topk", f""", {_STEMMED}, sought AS (SELECT DISTINCT qid, stem AS lexeme FROM wanted JOIN stems USING (word)), many AS (SELECT (SELECT count(*) FROM chunks) AS n, (SELECT sum(tf) FROM stemmed)::DOUBLE / (SELECT count(*) FROM chunks) AS mean),
dfs AS (SELECT lexeme, count(*) AS df FROM stemmed GROUP BY lexeme), sizes AS (SELECT id, sum(tf) AS length FROM stemmed GROUP BY id),
readable AS (SELECT id FROM chunks WHERE (len(acl) = 0 OR list_has_any(acl, ['role:fr'])) AND sensitivity IN ('public', 'internal')),
points AS (SELECT a.qid, p.id, round(sum(ln(1 + (s.n - x.df + 0.5) / (x.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.length / s.mean))), 6) AS score
 FROM sought a JOIN stemmed p USING (lexeme) JOIN dfs x USING (lexeme) JOIN sizes l ON l.id = p.id JOIN readable r ON r.id = p.id CROSS JOIN many s GROUP BY a.qid, p.id)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM points QUALIFY rank <= 50""")
def stemmed_topk(spark, d):
    """BM25 over the English analyzer's lexemes, in scope."""
    chunks = C.chunks(spark, d)
    scores = R.stemmed_scores(C.questions(spark, d), chunks, _open(spark, d, chunks))
    return R.top(scores, R.LIMIT, F.desc("score"), F.asc("id")).select("qid", "id", "score", "rank")


_BM25 = f"""len_ AS (SELECT id, len({_TOKENS}) AS length FROM chunks), stats AS (SELECT count(*) AS n, avg(length) AS mean FROM len_),
posted AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_TOKENS}) AS term FROM chunks) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
asked AS (SELECT qid, unnest(list_distinct(regexp_extract_all(lower(question), '[a-z0-9_]+'))) AS term FROM questions),
open_ AS (SELECT id FROM chunks WHERE (len(acl) = 0 OR list_has_any(acl, ['role:fr'])) AND sensitivity IN ('public', 'internal')),
scored AS (SELECT a.qid, p.id, round(sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.length / s.mean))), 6) AS score
 FROM asked a JOIN posted p ON a.term = p.term JOIN df d ON d.term = p.term JOIN len_ l ON l.id = p.id JOIN open_ o ON o.id = p.id CROSS JOIN stats s GROUP BY a.qid, p.id),
text_ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 50)"""


def _open(spark, d, chunks=None):
    """The rows of `chunks` that the scope may read, whole; without `chunks`, ids alone."""
    scope = spark.createDataFrame([(["role:fr"], ["public", "internal"])], "members array<string>, sensitivities array<string>")
    rows = (C.chunks(spark, d) if chunks is None else chunks).crossJoin(F.broadcast(scope)).where(A.in_scope("acl", "sensitivity", "members", "sensitivities"))  # scope: one row
    return rows.select("id") if chunks is None else rows.drop("members", "sensitivities")


def _bm25(spark, d):
    chunks = C.chunks(spark, d)
    return R.bm25(C.questions(spark, d), chunks, _open(spark, d, chunks))


@query("bm25_topk")
def bm25_topk(spark, d):
    return _bm25(spark, d).select("qid", "id", "score", "rank")


SQL["bm25_topk"] = f"WITH {C.SQL}, {_BM25} SELECT qid, id, score, rank FROM text_ranked"

#: Each of the first forty questions with the identifiers of every fortieth document.
_NAMED = f"""spelled AS (SELECT n, string_agg(term, ' ' ORDER BY term) AS ids FROM (SELECT DISTINCT doc_id % 40 AS n, unnest({_IDS.format(q="text")}) AS term FROM documents) x GROUP BY n), named_q AS (SELECT q.qid, q.question || ' ' || coalesce(s.ids, '') AS question FROM questions q LEFT JOIN spelled s ON s.n = q.qid),
ident AS (SELECT qid, unnest({_IDS.format(q="question")}) AS term FROM named_q), toks AS (SELECT id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: trim(x, '_')), lambda x: x <> '' AND len(x) < 64))) AS term FROM chunks),
matched AS (SELECT qid, id, count(*) AS matches FROM ident JOIN toks USING (term) GROUP BY qid, id)"""


def _named(spark, d):
    words = table(spark, d, "documents").select((F.col("doc_id") % 40).alias("n"), F.explode(T.identifier_terms(F.col("text"))).alias("term"))
    spelled = words.groupBy("n").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("ids"))
    rows = C.questions(spark, d).join(spelled, F.col("qid") == F.col("n"), "left")
    return materialize(rows.select("qid", F.concat("question", F.lit(" "), F.coalesce("ids", F.lit(""))).alias("question")), "named")  # documents are read once


@query("identifier_match", f", {_NAMED} SELECT qid, id, matches FROM matched")
def identifier_match(spark, d):
    return R.identifier_matches(_named(spark, d), C.chunks(spark, d))


_FULL = f"""{_BM25.replace("FROM questions)", "FROM named_q)")}, full_ranked AS (SELECT qid, id, coalesce(matches, 0) AS matches, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY qid ORDER BY coalesce(matches, 0) DESC, coalesce(score, 0) DESC, id) AS rank
 FROM scored FULL JOIN (SELECT m.* FROM matched m JOIN open_ o ON o.id = m.id) n USING (qid, id) QUALIFY rank <= 50)"""


@query("fulltext_topk", f", {_NAMED}, {_FULL} SELECT qid, id, matches, score, rank FROM full_ranked")
def fulltext_topk(spark, d):
    """Identifier matches before BM25. The SQL of bm25_topk and rrf_fusion is of BM25 alone, and so are they."""
    chunks = C.chunks(spark, d)
    return R.full_text(_named(spark, d), chunks, _open(spark, d, chunks)).select("qid", "id", "matches", "score", "rank")


_VECTOR = """near AS (SELECT q.vec_id AS qid, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
near_ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM near QUALIFY rank <= 50)"""


def _vectors(spark, d):
    v = table(spark, d, "embeddings")
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query")), v.select(F.col("vec_id").alias("id"), "embedding")


@query("vector_topk", f"WITH {_VECTOR} SELECT qid, id, score, rank FROM near_ranked", views=False)
def vector_topk(spark, d):
    return R.vector_top(*_vectors(spark, d)).select("qid", "id", "score", "rank")


@query("vector_index_topk")
def vector_index_topk(spark, d):
    """The same queries through the index. Approximate, so tests measure the share of near vectors it finds; SQL has nothing to compare."""
    queries, vectors = _vectors(spark, d)
    return V.search(V.build(vectors), queries).select("qid", "id", "score", "rank")


_PAIRED = """paired AS (SELECT c.id, x.external_id::BIGINT AS n FROM chunks c JOIN docs x ON x.document_id = c.document_id WHERE c.ordinal = 0),
near_paired AS (SELECT n.qid, p.id, row_number() OVER (PARTITION BY n.qid ORDER BY n.score DESC, p.id) AS rank FROM near n JOIN paired p ON p.n = n.id QUALIFY rank <= 50),
lists AS (SELECT qid, id, rank FROM text_ranked UNION ALL SELECT q.qid, r.id, r.rank FROM near_paired r JOIN questions q ON q.qid * 20 = r.qid),
fused AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 9) AS score, min(rank) AS best FROM lists GROUP BY qid, id),
fused_ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, best, id) AS rank FROM fused QUALIFY rank <= 50)"""


def _paired(spark, d):
    """A vector stands for the first line of the document with its number: a made pairing, since the test vectors have no texts."""
    queries, vectors = _vectors(spark, d)
    numbered = C.documents(spark, d).select("document_id", F.col("external_id").cast("long").alias("n"))
    place = C.chunks(spark, d).where("ordinal = 0").select("id", "document_id").join(numbered, "document_id").select("id", "n")
    queries = queries.withColumn("qid", (F.col("qid") / 20).cast("long")).join(C.questions(spark, d).select("qid"), "qid", "left_semi")
    return queries, vectors.withColumnRenamed("id", "n").join(place, "n").select("id", "embedding")


@query("rrf_fusion", None)
def rrf_fusion(spark, d):
    queries, vectors = _paired(spark, d)
    lists = _bm25(spark, d).select("qid", "id", "rank").unionByName(R.vector_top(queries, vectors).select("qid", "id", "rank"))
    return R.fuse(lists).select("qid", "id", "score", "best", "rank")


SQL["rrf_fusion"] = f"WITH {C.SQL}, {_BM25}, {_VECTOR}, {_PAIRED} SELECT qid, id, score, best, rank FROM fused_ranked"


#: The greedy fold of one question and document, as a list of steps: a hit, the row before it, the row after it.
_FOLD = """w AS (SELECT qid, document_id, id, row_number() OVER (PARTITION BY qid, document_id ORDER BY ordinal) AS k, count(*) OVER (PARTITION BY qid, document_id) AS n FROM fetched),
s AS (SELECT w.qid, w.document_id, w.n, w.k, h.score::FLOAT AS score, h.rank FROM w JOIN hits h ON h.qid = w.qid AND h.id = w.id),
o AS (SELECT qid, document_id, n, list({'taken': []::STRUCT(k BIGINT, score FLOAT, ctx BIGINT, rank BIGINT, slot BIGINT)[], 'k': k + CASE op WHEN 1 THEN -1 WHEN 2 THEN 1 ELSE 0 END, 'score': CASE WHEN op = 0 THEN score ELSE nextafter(score, '-infinity'::FLOAT) END, 'ctx': CASE WHEN op > 0 THEN k END, 'rank': rank, 'slot': op} ORDER BY rank, op) AS ops
 FROM s, (VALUES (0::BIGINT), (1), (2)) v(op) GROUP BY qid, document_id, n),
f AS (SELECT qid, document_id, list_reduce(ops, lambda a, x: {'taken': CASE WHEN len(list_filter(a.taken, lambda t: t.k = x.k)) > 0 THEN
   CASE WHEN x.slot > 0 THEN a.taken ELSE list_transform(a.taken, lambda t: CASE WHEN t.k = x.k AND t.ctx IS NOT NULL THEN {'k': t.k, 'score': greatest(t.score, x.score), 'ctx': NULL::BIGINT, 'rank': least(t.rank, x.rank), 'slot': CASE WHEN t.score >= x.score THEN t.slot ELSE 0 END} ELSE t END) END
  WHEN x.slot > 0 AND (x.k < 1 OR x.k > n OR len(a.taken) >= 3) THEN a.taken ELSE list_append(a.taken, {'k': x.k, 'score': x.score, 'ctx': x.ctx, 'rank': x.rank, 'slot': x.slot}) END,
  'k': x.k, 'score': x.score, 'ctx': x.ctx, 'rank': x.rank, 'slot': x.slot}, {'taken': []::STRUCT(k BIGINT, score FLOAT, ctx BIGINT, rank BIGINT, slot BIGINT)[], 'k': 0::BIGINT, 'score': 0::FLOAT, 'ctx': 0::BIGINT, 'rank': 0::BIGINT, 'slot': 0::BIGINT}) AS r FROM o),
t AS (SELECT qid, document_id, unnest(r.taken) AS t FROM f),
placed AS (SELECT t.qid, w.id, t.t.score AS score, c.id AS context_for, row_number() OVER (PARTITION BY t.qid ORDER BY t.t.score DESC, t.t.ctx IS NOT NULL, t.t.rank, t.t.slot, w.id) AS position
 FROM t JOIN w ON w.qid = t.qid AND w.document_id = t.document_id AND w.k = t.t.k LEFT JOIN w c ON c.qid = t.qid AND c.document_id = t.document_id AND c.k = t.t.ctx)"""

_HYBRID = f"""{_NAMED}, {_FULL}, near AS (SELECT q.vec_id AS vid, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
paired AS (SELECT c.id, x.external_id::BIGINT AS n FROM chunks c JOIN docs x ON x.document_id = c.document_id JOIN open_ o ON o.id = c.id WHERE c.ordinal = 0),
near_paired AS (SELECT n.vid, p.id, row_number() OVER (PARTITION BY n.vid ORDER BY n.score DESC, p.id) AS rank FROM near n JOIN paired p ON p.n = n.id QUALIFY rank <= 50),
lists AS (SELECT qid, id, rank FROM full_ranked UNION ALL SELECT q.qid, r.id, r.rank FROM near_paired r JOIN questions q ON q.qid * 20 = r.vid),
fused AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 9) AS score, min(rank) AS best FROM lists GROUP BY qid, id),
hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, best, id) AS rank FROM fused QUALIFY rank <= 50),
around AS (SELECT id, document_id, ordinal, lag(id) OVER v AS p, lead(id) OVER v AS x FROM chunks WINDOW v AS (PARTITION BY document_id ORDER BY ordinal)),
wanted AS (SELECT DISTINCT h.qid, unnest([a.id, a.p, a.x]) AS id FROM hits h JOIN around a ON a.id = h.id), fetched AS (SELECT w.qid, w.id, a.document_id, a.ordinal FROM wanted w JOIN around a ON a.id = w.id JOIN open_ o ON o.id = w.id), {_FOLD}"""


@query("hybrid_retrieve", f", {_HYBRID} SELECT qid, id, round(score::DOUBLE, 7) AS score, context_for, position FROM placed")
def hybrid_retrieve(spark, d):
    """Over stored chunks: lines are split and labelled once."""
    queries, vectors = _paired(spark, d)
    chunks = materialize(C.chunks(spark, d), "chunks")
    found = R.hybrid(_named(spark, d), chunks, queries, vectors, _open(spark, d, chunks))
    return found.withColumn("score", F.round(F.col("score").cast("double"), 7))


@query("context_expand", f""", hits AS (SELECT document_id AS qid, id, (length(text) * 13 % 97) / 100.0::DOUBLE AS score, row_number() OVER (PARTITION BY document_id ORDER BY length(text) * 13 % 97 DESC, ordinal) AS rank FROM chunks WHERE (length(text) * 7 + ordinal) % 3 = 0),
fetched AS (SELECT c.document_id AS qid, c.id, c.document_id, c.ordinal FROM chunks c WHERE c.document_id IN (SELECT qid FROM hits)), {_FOLD} SELECT qid, id, context_for, position FROM placed""")
def context_expand(spark, d):
    """Some lines of each document as hits, by their lengths, among all its lines."""
    rows = C.chunks(spark, d).select(F.col("document_id").alias("qid"), "id", "document_id", "ordinal", F.char_length("text").alias("n"))
    level = F.col("n") * 13 % 97
    rank = F.row_number().over(R.Window.partitionBy("qid").orderBy(level.desc(), "ordinal"))
    hits = rows.where((F.col("n") * 7 + F.col("ordinal")) % 3 == 0).select("qid", "id", (level / 100).cast("double").alias("score"), rank.alias("rank"))
    return R.expand(hits, rows.drop("n").join(hits.select("qid").distinct(), "qid", "left_semi"), 3).select("qid", "id", "context_for", "position")


def values(spark, text: str):
    """The inline rows that the SQL uses too."""
    return spark.sql("SELECT * FROM " + text.replace("(VALUES", "VALUES", 1)[: text.rindex(")", 0, text.rindex("(")) - 1] + " AS " + text[text.rindex(")", 0, text.rindex("(")) + 1 :])


_USERS = "(VALUES ('eve', NULL), ('ana', NULL), ('jose', NULL), ('maintainer', NULL), ('kim', 'auditor')) v(user_id, role)"
_MEMBERS = "(VALUES ('ana', 'auditor'), ('jose', 'maintainer')) v(user_id, role)"
_GRANTS = "(VALUES ('reader', 'internal'), ('auditor', 'confidential'), ('maintainer', 'confidential')) v(role, clearance)"
_SCOPES = f"""held AS (SELECT u.user_id, r.role FROM {_USERS.replace(' v(', ' u(')}, (SELECT 'reader' AS role) r UNION SELECT user_id, role FROM {_USERS} WHERE role IS NOT NULL UNION SELECT user_id, role FROM {_MEMBERS.replace(' v(', ' m(')}),
granted AS (SELECT h.user_id, h.role, g.clearance, list_position(['public', 'internal', 'confidential'], g.clearance) AS lvl FROM held h JOIN {_GRANTS.replace(' v(', ' g(')} ON h.role = g.role),
scopes AS (SELECT user_id, list_sort(list_append(list('role:' || role), 'user:' || user_id)) AS members, list(role || '=' || clearance ORDER BY role) AS grants, list(lvl ORDER BY role) AS lvls, list(role ORDER BY role) AS roles, max(lvl) AS top FROM granted GROUP BY user_id)"""


def _scopes(spark):
    users = values(spark, _USERS).select("user_id", F.when(F.col("role").isNotNull(), F.array("role")).alias("asserted"))
    return A.compile_scopes(users, values(spark, _MEMBERS), values(spark, _GRANTS), ("reader",))


@query("scope_compile", f""", u AS (SELECT document_id AS user_id, CASE WHEN source = 'src1' THEN 'auditor' END AS role FROM docs), m AS (SELECT d.document_id AS user_id, CASE WHEN l.toxic = 1 THEN 'auditor' WHEN l.quality = 1 THEN 'maintainer' ELSE 'guest' END AS role FROM labels l JOIN docs d ON d.external_id = l.doc_id::VARCHAR),
held AS (SELECT user_id, 'reader' AS role FROM u UNION SELECT user_id, role FROM u WHERE role IS NOT NULL UNION SELECT user_id, role FROM m), granted AS (SELECT h.*, g.clearance, list_position(['public', 'internal', 'confidential'], g.clearance) AS lvl FROM held h LEFT JOIN {_GRANTS.replace(" v(", " g(")} ON h.role = g.role),
scopes AS (SELECT user_id, list_sort(list_append(list('role:' || role), 'user:' || user_id)) AS members, coalesce(list(role || '=' || clearance ORDER BY role) FILTER (clearance IS NOT NULL), []) AS grants, coalesce(max(lvl), 0) AS top FROM granted GROUP BY user_id)
SELECT user_id, array_to_string(members, ',') AS members, array_to_string(grants, ',') AS grants, array_to_string(['public', 'internal', 'confidential'][1:top], ',') AS sensitivities FROM scopes""")
def scope_compile(spark, d):
    """A principal of each document; labels make some of them members of roles, one of which has no grant."""
    docs = C.documents(spark, d).select(F.col("document_id").alias("user_id"), "source", "external_id")
    labels = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("external_id"), F.when(F.col("toxic") == 1, "auditor").when(F.col("quality") == 1, "maintainer").otherwise("guest").alias("role"))
    members = docs.join(labels, "external_id").select("user_id", "role")
    users = docs.select("user_id", F.when(F.col("source") == "src1", F.array(F.lit("auditor"))).alias("asserted"))
    grants = F.transform("grants", lambda g: F.concat_ws("=", g["role"], g["clearance"]))
    scopes = A.compile_scopes(users, members, values(spark, _GRANTS), ("reader",))
    return scopes.select("user_id", F.array_join("members", ",").alias("members"), F.array_join(grants, ",").alias("grants"), F.array_join("sensitivities", ",").alias("sensitivities"))


@query("scope_filter", f", {_SCOPES} SELECT s.user_id, c.id FROM chunks c, scopes s WHERE (len(c.acl) = 0 OR list_has_any(c.acl, s.members)) AND list_position(['public', 'internal', 'confidential'], c.sensitivity) <= s.top")
def scope_filter(spark, d):
    return A.readable(C.chunks(spark, d).select("id", "acl", "sensitivity"), _scopes(spark)).select("user_id", "id")


@query("access_decisions", f""", {_SCOPES} SELECT s.user_id, c.id, CASE WHEN NOT (len(c.acl) = 0 OR list_has_any(c.acl, s.members)) THEN 'not_in_acl' WHEN list_position(['public', 'internal', 'confidential'], c.sensitivity) > s.top THEN 'no_grant'
 ELSE 'allowed by ' || s.roles[list_position(list_transform(s.lvls, lambda l: l >= list_position(['public', 'internal', 'confidential'], c.sensitivity)), true)] END AS decision FROM chunks c, scopes s""")
def access_decisions(spark, d):
    rows = C.chunks(spark, d).select("id", "acl", "sensitivity").crossJoin(broadcast_small(_scopes(spark)))
    return rows.select("user_id", "id", A.decision("acl", "sensitivity", "members", "grants").alias("decision"))


@query("run_access", f"WITH {D.SQL}, r AS (SELECT id, 'u' || turn % 5 AS user_id, 'u' || qid % 5 AS owner, ['any', 'own', NULL][(n % 3)::INT + 1] AS runs FROM turns) SELECT id, CASE WHEN runs = 'any' THEN 'allowed' WHEN runs = 'own' AND user_id = owner THEN 'allowed' WHEN runs = 'own' THEN 'not_owner' ELSE 'no_grant' END AS decision FROM r", views=False)
def run_access(spark, d):
    """Each turn as somebody's reading of the conversation's run."""
    runs = F.when(F.col("n") % 3 == 0, "any").when(F.col("n") % 3 == 1, "own")
    user, owner = F.concat(F.lit("u"), F.col("turn") % 5), F.concat(F.lit("u"), F.col("qid") % 5)
    return D.turns(spark, d).select("id", A.run_decision(runs, user, owner).alias("decision"))


def _paths(spark, d):
    """Language, source and id of all documents as paths."""
    lang = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("external_id"), "lang")
    return C.documents(spark, d).join(lang, "external_id").select("document_id", "source", "external_id", F.concat_ws("/", "lang", "source", "external_id").alias("path"))


_PATHS = "paths AS (SELECT d.document_id, d.source, d.external_id, x.lang || '/' || d.source || '/' || d.external_id AS path FROM docs d JOIN documents x ON x.doc_id::VARCHAR = d.external_id)"
_UNDER = "(prefix = '' OR path = prefix OR starts_with(path, prefix || '/'))"
_LABELLED = """covered AS (SELECT document_id, acl, sensitivity, rule FROM ruled JOIN rules USING (source) WHERE {under}), folded AS (SELECT document_id, list_reduce(list(acl ORDER BY rule) FILTER (len(acl) > 0), lambda a, b: list_intersect(a, b)) AS acl, max(list_position(['public', 'internal', 'confidential'], sensitivity)) AS lvl FROM covered GROUP BY document_id)
SELECT r.document_id, array_to_string(list_sort(coalesce(f.acl, [])), ',') AS acl, ['public', 'internal', 'confidential'][coalesce(f.lvl, 2)] AS sensitivity FROM ruled r LEFT JOIN folded f ON f.document_id = r.document_id"""
_RULE = "rule int, source string, prefix string, acl array<string>, sensitivity string"


@query("label_rules", f""", {_PATHS}, ruled AS (SELECT document_id, 'm' AS source, path FROM paths), rules AS (SELECT * FROM (VALUES (1, 'm', '', [], 'public'), (2, 'm', 'fr', ['role:hr', 'role:payroll'], 'internal'), (3, 'm', 'fr/src1', ['role:hr', 'user:ana'], 'confidential'), (4, 'm', 'd', ['role:none'], 'confidential'), (5, 'n', '', ['role:none'], 'confidential')) v(rule, source, prefix, acl, sensitivity)), {_LABELLED.format(under=_UNDER)}""")
def label_rules(spark, d):
    """Rules over paths of all documents; a prefix covers whole segments, so `d` isn't `de`."""
    rules = [(1, "m", "", [], "public"), (2, "m", "fr", ["role:hr", "role:payroll"], "internal"), (3, "m", "fr/src1", ["role:hr", "user:ana"], "confidential"), (4, "m", "d", ["role:none"], "confidential"), (5, "n", "", ["role:none"], "confidential")]
    docs = _paths(spark, d).select("document_id", F.lit("m").alias("source"), F.col("path").alias("external_id"))
    return A.apply_label_rules(docs, spark.createDataFrame(rules, _RULE)).select("document_id", F.array_join("acl", ",").alias("acl"), "sensitivity")


@query("layer_resolution", f""", {_PATHS}, layers AS (SELECT * FROM (VALUES ('', 'evidence'), ('fr', 'authoritative'), ('fr/src1', 'skip'), ('d', 'skip'), ('de/src0', 'authoritative')) v(prefix, standing)), best AS (SELECT path, arg_max(standing, length(prefix)) AS standing FROM paths JOIN layers ON {_UNDER} GROUP BY path) SELECT path, standing FROM best WHERE standing <> 'skip'""")
def layer_resolution(spark, d):
    layers = [("", "evidence"), ("fr", "authoritative"), ("fr/src1", "skip"), ("d", "skip"), ("de/src0", "authoritative")]
    return A.layer_of(_paths(spark, d).select("path"), spark.createDataFrame(layers, "prefix string, standing string"))


@query("label_rules_corpus", f""", ruled AS (SELECT document_id, source, external_id AS path FROM docs), rules AS (SELECT * FROM (VALUES (1, 'src0', '', [], 'public'), (2, 'src0', '10', ['role:hr', 'role:payroll'], 'internal'), (3, 'src1', '', ['role:hr', 'user:ana'], 'confidential'), (4, 'src1', '', ['role:hr'], 'public')) v(rule, source, prefix, acl, sensitivity)), {_LABELLED.format(under=_UNDER)}""")
def label_rules_corpus(spark, d):
    """All documents; only the rules are inline."""
    rows = [(1, "src0", "", [], "public"), (2, "src0", "10", ["role:hr", "role:payroll"], "internal"), (3, "src1", "", ["role:hr", "user:ana"], "confidential"), (4, "src1", "", ["role:hr"], "public")]
    labelled = A.apply_label_rules(C.documents(spark, d).select("document_id", "source", "external_id"), spark.createDataFrame(rows, _RULE))
    return labelled.select("document_id", F.array_join("acl", ",").alias("acl"), "sensitivity")


@query("layer_resolution_corpus", "SELECT source || '/' || external_id AS path, CASE WHEN source = 'src0' THEN 'authoritative' ELSE 'evidence' END AS standing FROM docs WHERE source <> 'src1'")
def layer_resolution_corpus(spark, d):
    """Source and id of all documents as paths; only the layers are inline."""
    layers = spark.createDataFrame([("", "evidence"), ("src0", "authoritative"), ("src1", "skip")], "prefix string, standing string")
    return A.layer_of(C.documents(spark, d).select(F.concat_ws("/", "source", "external_id").alias("path")), layers)
