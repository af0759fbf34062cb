"""Queries of ingestion and the glossary."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillstack.functions import markdown as M
from quillstack.functions import text as T
from quillstack.operators import glossary as G
from quillstack.operators import ingest as I
from quillstack.operators import retrieval as R
from quillstack.operators import store
from quillstack.plans.corpus_queries import _HYBRID, _open, _paired
from quillstack.plans.inline import Catalogue
from quillstack.session import materialize, shared_dir
from quillstack.sources import corpus as C
from quillstack.sources import derived as D

catalogue = Catalogue()

#: A snapshot made from the corpus by rule: edits, reverts, moves and removals.
DRAFTS = """drafts AS (SELECT id, source, document_id, CASE WHEN ordinal % 7 = 3 THEN text || ' edited' WHEN ordinal % 10 = 0 THEN text || ' (old)' ELSE text END AS text, sha256(CASE WHEN ordinal % 7 = 3 THEN text || ' edited' WHEN ordinal % 10 = 0 THEN text || ' (old)' ELSE text END) AS version,
 CASE WHEN ordinal % 13 = 12 THEN ordinal + 100 ELSE ordinal END AS ordinal FROM chunks WHERE ordinal % 11 <> 10)"""
DIFF = """now_ AS (SELECT * FROM history WHERE NOT superseded), was AS (SELECT DISTINCT id, version FROM history WHERE superseded),
diff AS (SELECT coalesce(d.id, n.id) AS id, coalesce(d.version, n.version) AS version, coalesce(d.ordinal, n.ordinal) AS ordinal, n.version AS old_version,
 CASE WHEN d.version IS NULL THEN 'stale' WHEN d.version = n.version AND d.ordinal = n.ordinal THEN 'same' WHEN d.version = n.version THEN 'moved' WHEN w.id IS NOT NULL THEN 'revived' ELSE 'fresh' END AS action
 FROM drafts d FULL OUTER JOIN now_ n ON d.id = n.id LEFT JOIN was w ON w.id = d.id AND w.version = d.version)"""


def drafts(spark, d):
    o = F.col("ordinal")
    text = F.when(o % 7 == 3, F.concat("text", F.lit(" edited"))).when(o % 10 == 0, F.concat("text", F.lit(" (old)"))).otherwise(F.col("text"))
    rows = C.chunks(spark, d).where(o % 11 != 10)
    return rows.select("id", "source", "document_id", text.alias("text"), F.sha2(text, 256).alias("version"), F.when(o % 13 == 12, o + 100).otherwise(o).alias("ordinal"))


@catalogue.add("scd2_diff", f"WITH {C.SQL}, {DRAFTS}, {DIFF} SELECT id, version, ordinal, action FROM diff")
def scd2_diff(spark, d):
    return I.diff(drafts(spark, d).select("id", "version", "ordinal"), C.chunk_history(spark, d).select("id", "version", "ordinal", "superseded")).drop("replaced")


@catalogue.add("scd2_apply", f"""WITH {C.SQL}, {DRAFTS}, {DIFF} SELECT id, version, ordinal, false AS superseded FROM diff WHERE action <> 'stale'
UNION ALL SELECT h.id, h.version, h.ordinal, true FROM history h WHERE NOT EXISTS (SELECT 1 FROM diff x WHERE x.id = h.id AND x.version = h.version AND x.action <> 'stale')""")
def scd2_apply(spark, d):
    return I.apply(drafts(spark, d).select("id", "version", "ordinal"), C.chunk_history(spark, d).select("id", "version", "ordinal", "superseded"))


@catalogue.add("scd2_missing_docs", f"WITH {C.SQL} SELECT id, version FROM history WHERE NOT superseded AND source = 'src3' AND document_id NOT IN (SELECT document_id FROM docs WHERE external_id NOT LIKE '%3')")
def scd2_missing_docs(spark, d):
    present = C.documents(spark, d).where("external_id not like '%3'").select("document_id")
    return I.supersede_missing(C.chunk_history(spark, d), "src3", present).select("id", "version")


@catalogue.add("scd2_other_models", f"WITH {C.SQL}, mixed AS (SELECT id, version, superseded, CASE WHEN ordinal % 4 = 1 THEN NULL WHEN ordinal % 4 = 2 THEN 'older' ELSE model END AS model FROM history) SELECT id, version, model, superseded OR model IS DISTINCT FROM 'fixture' AS superseded FROM mixed")
def scd2_other_models(spark, d):
    o = F.col("ordinal") % 4
    mixed = C.chunk_history(spark, d).withColumn("model", F.when(o == 1, F.lit(None)).when(o == 2, "older").otherwise(F.col("model")))
    return I.supersede_other_models(mixed, "fixture").select("id", "version", "model", "superseded")


#: Readers of one source each: src2's returns a document of src3, src4's returns some chunks twice.
_READ = f"""{DRAFTS}, handed AS (SELECT CASE WHEN source = 'src3' AND document_id LIKE '%7' THEN 'src2' ELSE source END AS reader, * FROM drafts UNION ALL SELECT source, * FROM drafts WHERE source = 'src4' AND ordinal % 9 = 2),
wrong AS (SELECT reader, min({{'document_id': document_id, 'what': what}}) AS f FROM (SELECT reader, document_id, 'foreign document' AS what FROM handed WHERE reader <> source UNION ALL SELECT reader, document_id, 'duplicate locator' FROM handed GROUP BY reader, document_id, id HAVING count(*) > 1) x GROUP BY reader),
readers AS (SELECT DISTINCT source AS reader FROM docs UNION SELECT 'nothing'), sound AS (SELECT reader FROM readers WHERE reader NOT IN (SELECT reader FROM wrong)),
taken AS (SELECT * FROM handed WHERE reader = source AND reader IN (SELECT reader FROM sound)), mine AS (SELECT * FROM history WHERE source IN (SELECT reader FROM sound)),
now_ AS (SELECT * FROM mine WHERE NOT superseded), was AS (SELECT DISTINCT id, version FROM mine WHERE superseded),
diff AS (SELECT coalesce(d.source, n.source) AS source, coalesce(d.id, n.id) AS id, coalesce(d.version, n.version) AS version, n.version AS old_version, coalesce(d.ordinal, n.ordinal) AS ordinal,
 CASE WHEN d.version IS NULL THEN 'stale' WHEN d.version = n.version AND d.ordinal = n.ordinal THEN 'same' WHEN d.version = n.version THEN 'moved' WHEN w.id IS NOT NULL THEN 'revived' ELSE 'fresh' END AS action
 FROM taken d FULL OUTER JOIN now_ n ON d.id = n.id LEFT JOIN was w ON w.id = d.id AND w.version = d.version)"""


def _read(spark, d):
    rows = materialize(drafts(spark, d).select("source", "document_id", "id", "version", "ordinal"), "drafts")  # lines are split once
    reader = F.when((F.col("source") == "src3") & F.col("document_id").like("%7"), "src2").otherwise(F.col("source"))
    twice = rows.where("source = 'src4' and ordinal % 9 = 2").withColumn("reader", F.col("source"))
    readers = C.documents(spark, d).select(F.col("source").alias("reader")).distinct().union(spark.createDataFrame([("nothing",)], "reader string"))
    history = materialize(C.chunk_history(spark, d).select("source", "id", "version", "ordinal", "superseded"), "history")
    return I.ingest(rows.withColumn("reader", reader).unionByName(twice).select("reader", "source", "document_id", "id", "version", "ordinal"), history, readers)


@catalogue.add("ingest_report", f"""WITH {C.SQL}, {_READ} SELECT r.reader, CASE WHEN w.reader IS NOT NULL THEN f.what || ' ' || f.document_id END AS fault, (SELECT count(DISTINCT document_id) FROM taken t WHERE t.reader = r.reader) AS documents,
 (SELECT count(*) FROM diff x WHERE x.source = r.reader AND action IN ('fresh', 'revived')) AS new_versions, (SELECT count(*) FROM diff x WHERE x.source = r.reader AND (action = 'stale' OR (action IN ('fresh', 'revived') AND old_version IS NOT NULL))) AS superseded
 FROM readers r LEFT JOIN wrong w ON w.reader = r.reader""")
def ingest_report(spark, d):
    """Two of the sources have a fault and are rejected alone; a reader that read nothing supersedes nothing of others."""
    return _read(spark, d)[0]


@catalogue.add("ingest_isolated", f"""WITH {C.SQL}, {_READ} SELECT source, id, version, ordinal, false AS superseded FROM diff WHERE action <> 'stale'
 UNION ALL SELECT source, id, version, ordinal, true FROM mine m WHERE NOT EXISTS (SELECT 1 FROM diff x WHERE x.id = m.id AND x.version = m.version AND x.action <> 'stale')
 UNION ALL SELECT source, id, version, ordinal, superseded FROM history WHERE source NOT IN (SELECT reader FROM sound)""")
def ingest_isolated(spark, d):
    """The history after it: sources with a fault are as they were."""
    return _read(spark, d)[1]


def _stored(spark, d):
    """A table of chunks and its term statistics after two snapshots."""
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    columns = ["document_id", "id", "text", "version", "ordinal"]
    rows = C.chunks(spark, d).withColumn("version", F.sha2("text", 256)).select(*columns)
    for n, snapshot in enumerate((rows, drafts(spark, d).select(*columns))):
        store.update_stats(*store.save(snapshot, f"{path}/chunks", first=n == 0), f"{path}/stats")
    return path


@catalogue.add("stored_history", f"""WITH {C.SQL}, {DRAFTS} SELECT id, version, ordinal, false AS superseded FROM drafts
 UNION ALL SELECT c.id, sha256(c.text), c.ordinal, true FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM drafts x WHERE x.id = c.id AND x.version = sha256(c.text))""")
def stored_history(spark, d):
    return store.read(spark, f"{_stored(spark, d)}/chunks", store.HISTORY).select("id", "version", "ordinal", "superseded")


@catalogue.add("stored_term_stats", f"WITH {C.SQL}, {DRAFTS} SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM drafts) x GROUP BY term")
def stored_term_stats(spark, d):
    return store.stored_terms(spark, f"{_stored(spark, d)}/stats")


@catalogue.add("stored_corpus_stats", f"WITH {C.SQL}, {DRAFTS} SELECT count(*) AS chunks, round(avg(len(regexp_extract_all(lower(text), '[a-z0-9_]+'))), 6) AS avg_length FROM drafts")
def stored_corpus_stats(spark, d):
    return store.stored_corpus(spark, f"{_stored(spark, d)}/stats").select("chunks", F.round("avg_length", 6).alias("avg_length"))


#: Runs of at most 8 texts and 400 estimated tokens: a text joins the run if the run has room for it, padded.
@catalogue.add("embed_batches", f"""WITH RECURSIVE {C.SQL}, t AS (SELECT document_id, ordinal, text, length(text) AS n, ((strlen(text) + 2) // 3)::BIGINT AS est FROM chunks),
r AS (SELECT document_id, ordinal, 0::BIGINT AS run, 1::BIGINT AS texts, est AS longest, n FROM t WHERE ordinal = 0
 UNION ALL SELECT t.document_id, t.ordinal, CASE WHEN r.texts = 8 OR greatest(r.longest, t.est) * (r.texts + 1) > 400 THEN r.run + 1 ELSE r.run END, CASE WHEN r.texts = 8 OR greatest(r.longest, t.est) * (r.texts + 1) > 400 THEN 1 ELSE r.texts + 1 END,
  CASE WHEN r.texts = 8 OR greatest(r.longest, t.est) * (r.texts + 1) > 400 THEN t.est ELSE greatest(r.longest, t.est) END, t.n FROM r JOIN t ON t.document_id = r.document_id AND t.ordinal = r.ordinal + 1)
SELECT document_id, run, count(*) AS texts, max(n) AS longest FROM r GROUP BY document_id, run""")
def embed_batches(spark, d):
    return I.embed_runs(C.chunks(spark, d), 8, 400)


_FENCE = "```\n# no heading\n```"


def files(spark, d):
    """(path, text): a Markdown file of each conversation, with front matter, a title, and a section a turn."""
    part = F.concat(F.lit("## "), F.col("role"), F.lit("\n"), F.col("text"), F.when(F.col("turn") % 4 == 3, F.lit(f"\n\n{_FENCE}")).otherwise(F.lit("")))
    by = D.turns(spark, d).groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("body"))
    return by.select(F.concat(F.lit("talk/"), F.col("qid"), F.lit(".md")).alias("path"), F.concat(F.lit("\n---\nowner: x\n---- more\n# Talk "), F.col("qid"), F.lit("\n"), F.col("body")).alias("text"))


_SECTIONS = f"""WITH {D.SQL}, parts AS (SELECT qid, turn, role, trim(text || CASE WHEN turn % 4 = 3 THEN chr(10) || chr(10) || '{_FENCE.replace(chr(10), "' || chr(10) || '")}' ELSE '' END, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM turns),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY turn) - 1 AS ordinal, row_number() OVER (PARTITION BY qid, role ORDER BY turn) AS same FROM parts WHERE text <> '')
SELECT 'talk/' || qid || '.md' AS path, 'Talk ' || qid AS title, 0 AS ordinal, 'intro' AS locator, NULL AS heading, '- more' AS text FROM totals
UNION ALL SELECT 'talk/' || qid || '.md' AS path, 'Talk ' || qid AS title, ordinal + 1, role || CASE WHEN same > 1 THEN '-' || same ELSE '' END AS locator, 'Talk ' || qid || ' > ' || role AS heading, text FROM k"""


@catalogue.add("ingest_sections", _SECTIONS)
def ingest_sections(spark, d):
    return M.section_rows(files(spark, d))


def _entries(spark, d):
    """Glossary tables, one a conversation with five words or more in ASCII letters in its first turn."""
    first = D.turns(spark, d).where("prev_id is null").select("qid", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0)).alias("w")).where("size(w) >= 5")
    w = [F.element_at("w", k) for k in range(1, 5)]
    short = F.upper(F.concat(*[F.left(x, F.lit(1)) for x in w]))
    name = F.concat(w[0], F.lit(" "), w[1], F.lit(" / "), w[2], F.lit(" "), w[3], F.lit(" ("), short, F.lit(")"))
    text = F.concat(F.lit("| Name | Meaning |\n|---|---|\n| "), name, F.lit(" | `code` "), F.array_join("w", " "), F.lit(" [tag] |"))
    return M.glossary_entries(first.select(F.col("qid").cast("string").alias("id"), F.lit(0).cast("long").alias("ordinal"), text.alias("text"))).withColumn("entry", F.col("id").cast("long"))


_STOP = ", ".join(f"'{w}'" for w in M.STOP)
_ENTRIES = f"""w AS (SELECT qid AS entry, regexp_extract_all(lower(text), '[a-z]{{2,}}') AS w FROM turns WHERE prev_id IS NULL), named AS (SELECT entry, w, upper(left(w[1], 1) || left(w[2], 1) || left(w[3], 1) || left(w[4], 1)) AS short FROM w WHERE len(w) >= 5),
entries AS (SELECT entry, short, list_distinct([w[1] || ' ' || w[2]] || [w[3] || ' ' || w[4]]) AS unordered, CASE WHEN w[1] || ' ' || w[2] = w[3] || ' ' || w[4] THEN [w[1] || ' ' || w[2]] ELSE [w[1] || ' ' || w[2], w[3] || ' ' || w[4]] END AS phrases, list_concat(w[1:4], [lower(short)], w) AS said FROM named),
spoken AS (SELECT entry, term, min(place) AS place FROM (SELECT entry, unnest(said) AS term, unnest(range(len(said))) AS place FROM entries) x WHERE term NOT IN ({_STOP}) GROUP BY entry, term)"""


@catalogue.add("glossary_rows", f"WITH {D.SQL}, {_ENTRIES} SELECT e.entry, 0::BIGINT AS line, array_to_string(phrases, ';') AS phrases, lower(short) AS acronyms, string_agg(term, ' ' ORDER BY place) AS terms FROM entries e JOIN spoken s ON s.entry = e.entry GROUP BY e.entry, phrases, short")
def glossary_rows(spark, d):
    return _entries(spark, d).select("entry", "line", F.array_join("phrases", ";").alias("phrases"), F.array_join("acronyms", ";").alias("acronyms"), F.array_join("terms", " ").alias("terms"))


def _asked(spark, d):
    """The benchmark's questions, some of which name an entry's acronym, in the letters of an identifier's neighbour."""
    short = _entries(spark, d).select(F.col("entry").alias("qid"), F.upper(F.element_at("acronyms", 1)).alias("short"))
    rows = C.questions(spark, d).join(short, "qid", "left")
    return rows.select("qid", F.when(F.col("short").isNotNull() & (F.col("qid") % 2 == 0), F.concat("question", F.lit(" 2x "), "short", F.lit("?"))).otherwise(F.col("question")).alias("question"))


_MATCHED = f"""{_ENTRIES}, q AS (SELECT qid, CASE WHEN short IS NOT NULL AND qid % 2 = 0 THEN question || ' 2x ' || short || '?' ELSE question END AS question FROM questions LEFT JOIN entries ON entry = qid),
own AS (SELECT qid, question, list_filter(list_transform(regexp_extract_all(question, '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)), lambda x: NOT regexp_matches(x, '[0-9]')) AS w, regexp_extract_all(question, '[\\p{{L}}\\p{{N}}]+') AS raw FROM q),
pairs AS (SELECT qid, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS key FROM own), caps AS (SELECT qid, lower(x) AS key FROM (SELECT qid, unnest(raw) AS x FROM own) y WHERE len(regexp_replace(x, '[^\\p{{Lu}}]', '', 'g')) >= 2 AND len(regexp_replace(x, '[^\\p{{Lu}}]', '', 'g')) >= len(regexp_replace(x, '[^\\p{{Ll}}]', '', 'g'))),
hits AS (SELECT qid, entry, min({{'place': place, 'key': key}}).key AS matched FROM (SELECT p.qid, e.entry, e.place, p.key FROM (SELECT DISTINCT * FROM pairs) p JOIN (SELECT entry, unnest(phrases) AS key, unnest(range(len(phrases))) AS place FROM entries) e ON e.key = p.key
 UNION ALL SELECT c.qid, e.entry, 9, c.key FROM (SELECT DISTINCT * FROM caps) c JOIN entries e ON lower(e.short) = c.key) x GROUP BY qid, entry)"""


@catalogue.add("glossary_match", f"WITH {C.SQL}, {D.SQL}, {_MATCHED} SELECT qid, entry, matched FROM hits")
def glossary_match(spark, d):
    return G.match(_asked(spark, d), _entries(spark, d))


@catalogue.add("glossary_expand", f"""WITH {C.SQL}, {D.SQL}, {_MATCHED}, f AS (SELECT h.qid, s.term, min({{'entry': h.entry, 'place': s.place}}) AS first FROM hits h JOIN spoken s ON s.entry = h.entry JOIN own o ON o.qid = h.qid WHERE NOT list_contains(o.w, s.term) GROUP BY h.qid, s.term),
k AS (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY first) AS n FROM f QUALIFY n <= 16), g AS (SELECT qid, string_agg(term, ' ' ORDER BY n) AS terms FROM k GROUP BY qid)
SELECT q.qid, coalesce(g.terms, '') AS terms, q.question || coalesce(' ' || g.terms, '') AS expanded FROM q LEFT JOIN g ON g.qid = q.qid""")
def glossary_expand(spark, d):
    return G.expand(_asked(spark, d), _entries(spark, d)).select("qid", F.array_join("terms", " ").alias("terms"), "expanded")


#: The whole retrieval of expanded questions; the inner names are those of the retrieval alone.
_INNER = _HYBRID[_HYBRID.index("ident AS") :].replace("AS term FROM named_q),\nopen_", "AS term FROM wider),\nopen_")


@catalogue.add("hybrid_expanded", f"""WITH {C.SQL}, {D.SQL}, {_MATCHED}, gained AS (SELECT h.qid, s.term, min({{'entry': h.entry, 'place': s.place}}) AS first FROM hits h JOIN spoken s ON s.entry = h.entry JOIN own x ON x.qid = h.qid WHERE NOT list_contains(x.w, s.term) GROUP BY h.qid, s.term),
numbered_terms AS (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY first) AS n FROM gained QUALIFY n <= 16), terms AS (SELECT qid, string_agg(term, ' ' ORDER BY n) AS terms FROM numbered_terms GROUP BY qid), wider AS (SELECT q.qid, q.question || coalesce(' ' || g.terms, '') AS question FROM q LEFT JOIN terms g ON g.qid = q.qid), plain AS (SELECT qid, question FROM q)
SELECT * FROM (WITH named_q AS (SELECT * FROM plain), {_INNER} SELECT qid, id, round(score::DOUBLE, 7) AS score, context_for, position FROM placed) z""")
def hybrid_expanded(spark, d):
    """The whole retrieval: a glossary's terms go to both sides, identifiers are of the question alone, scopes before ranks."""
    queries, vectors = _paired(spark, d)
    chunks = materialize(C.chunks(spark, d), "chunks")
    found = R.hybrid(_asked(spark, d), chunks, queries, vectors, _open(spark, d, chunks), entries=_entries(spark, d))
    return found.withColumn("score", F.round(F.col("score").cast("double"), 7))


@catalogue.add("github_anchor", rf"WITH {C.SQL} SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\s\p{{Z}}\x85-]', '', 'g'), '-[\s\p{{Z}}\x85]+', '-', 'g'), '[\s\p{{Z}}\x85]+', '-', 'g'), '-') AS anchor FROM chunks")
def github_anchor(spark, d):
    """Each line as a heading."""
    return C.chunks(spark, d).select("id", T.github_anchor(F.col("text")).alias("anchor"))
