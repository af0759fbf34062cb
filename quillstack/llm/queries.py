"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm.bpe import op1_byte_bpe
from quillstack.llm.brown import op8_lm_scores
from quillstack.llm.conversations import op12_conversation_repair
from quillstack.llm.decontaminate import op10_decontaminate
from quillstack.llm.fingerprints import op2_fingerprints
from quillstack.llm.importance import op13_importance
from quillstack.llm.jaccard import op5_jaccard_join
from quillstack.llm.line_dedup import op6_line_dedup
from quillstack.llm.main_text import op4_main_text
from quillstack.llm.pii import op3_pii
from quillstack.llm.quality import op7_quality
from quillstack.llm.secrets import op9_secrets
from quillstack.llm.vector_dedup import op11_vector_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_fingerprints": op2_fingerprints,
    "op3_pii": op3_pii,
    "op7_quality": op7_quality,
    "op8_lm_scores": op8_lm_scores,
    "op9_secrets": op9_secrets,
    "op4_main_text": op4_main_text,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_line_dedup": op6_line_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_vector_dedup": op11_vector_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_importance": op13_importance,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_GAPS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: The remainders of CRC-32 by each byte, and the sum of a text from them.
_CRC_TABLE = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS v FROM range(256) r(i)))"
_CRC = "xor(list_reduce(list_transform(range(1, len(hex({x})) // 2 + 1), lambda byte: ('0x' || substr(hex({x}), (2 * byte - 1)::INT, 2))::BIGINT), lambda c, b: xor(c // 256, crc.t[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295)"

#: The others take hashes, offsets of matches or models that SQL doesn't have; tests hold them against brute force.
SQL = {
    "op5_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s), p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, p.b FROM r JOIN p ON p.a = r.c)
SELECT s.doc_id, len(s.s) AS n_shingles, m.component_id FROM s JOIN (SELECT d, min(c) AS component_id FROM r GROUP BY d) m ON m.d = s.doc_id""",
    "op6_line_dedup": f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS n FROM d),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_GAPS})")} AS key FROM l), f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (coalesce(f.first < k.doc_id, false)) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT coalesce(f.first < k.doc_id, false)), '')) AS kept_sha256
 FROM k LEFT JOIN f ON f.key = k.key GROUP BY k.doc_id""",
    "op10_decontaminate": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM b WHERE len(w) > 0),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM i) z), g AS (SELECT doc_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS g FROM p),
h AS (SELECT g.doc_id, g.pos, g.n, i.item_id FROM g JOIN i ON i.n = g.n AND i.g = g.g), c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS q FROM h) u GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) y GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op11_vector_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT vec_id AS d, vec_id AS c FROM embeddings UNION SELECT r.d, p.b FROM r JOIN p ON p.a = r.c), m AS (SELECT d, min(c) AS component_id FROM r GROUP BY d), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept FROM embeddings e JOIN m ON m.d = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    # The lattice row by row: the best path to each end, an insertion right before the row that needs it or at the end.
    "op12_conversation_repair": f"""WITH RECURSIVE {_CRC_TABLE}, c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS raw FROM conversations),
k AS (SELECT * EXCLUDE (raw), {_CRC.format(x="raw")} % 20 AS k FROM c, crc), two AS (SELECT * FROM k WHERE k <> 0 UNION ALL SELECT * FROM k WHERE k = 3),
dam AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM two),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM dam), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS n FROM seen),
fl AS (SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN again THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault FROM o),
st AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated FROM fl GROUP BY conv_id),
il AS (SELECT conv_id, count(*) AS illegal FROM (SELECT conv_id, lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair FROM fl) x WHERE pair NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
e(a, ini, b, ins) AS (VALUES ('_', 's', 's', 0), ('_', 'u', 'u', 0), ('_', 'a', 'a', 1), ('s', 'u', 'u', 0), ('s', 'a', 'a', 1), ('u', 'a', 'a', 0), ('u', 'u', 'u', 1), ('a', 'u', 'u', 0), ('a', 'a', 'a', 1)),
p AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, '_' AS a, {{'cost': 0::BIGINT, 'audit': '', 'said': NULL::VARCHAR}} AS best FROM fl
 UNION ALL SELECT conv_id, n, a, min(best) FROM (
  SELECT f.conv_id, f.n, p.a, {{'cost': best.cost + 2, 'audit': best.audit || 'D', 'said': best.said}} AS best FROM p JOIN fl f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n + 1
  UNION ALL SELECT f.conv_id, f.n, e.b, {{'cost': best.cost + e.ins * 5 + CASE WHEN f.fault = 3 THEN 5 ELSE 0 END + r, 'audit': best.audit || CASE WHEN e.ins = 1 THEN 'I' ELSE '' END || CASE WHEN r = 1 THEN 'R' ELSE 'K' END,
   'said': concat_ws(chr(10), best.said, CASE WHEN e.ins = 1 THEN CASE e.ini WHEN 'u' THEN 'assistant:' ELSE 'user:' END END, CASE WHEN r = 0 THEN f.role WHEN e.ini = 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text)}}
   FROM p JOIN fl f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n + 1 AND f.fault NOT IN (1, 2) JOIN e ON e.a = p.a JOIN (VALUES (0), (1)) v(r) ON (r = 0 AND e.ini = f.i) OR (r = 1 AND e.ini <> 's')) x GROUP BY conv_id, n, a),
z AS (SELECT p.conv_id, min(CASE WHEN p.a = 'u' THEN {{'cost': best.cost + 5, 'audit': best.audit || 'I', 'said': concat_ws(chr(10), best.said, 'assistant:')}} WHEN p.a IN ('_', 'a') THEN best END) AS best FROM p JOIN (SELECT conv_id, max(n) AS last FROM fl GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND p.n = l.last GROUP BY p.conv_id)
SELECT d.conv_id, coalesce(st.gaps, 0) AS gaps, coalesce(st.blank, 0) AS blank, coalesce(st.duplicate, 0) AS duplicate, coalesce(st.truncated, 0) AS truncated, coalesce(il.illegal, 0) AS illegal, coalesce(z.best.cost, 0) AS cost, coalesce(z.best.audit, '') AS audit, sha256(coalesce(z.best.said, '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN il ON il.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM d.conv_id""",
    "op13_importance": f"""WITH {_CRC_TABLE}, d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark), x AS (SELECT doc_id, unnest(w) AS w FROM d),
v AS (SELECT w, {_CRC.format(x="w")} % 10000 AS b FROM (SELECT DISTINCT w FROM (SELECT w FROM x UNION ALL SELECT w FROM t)) u, crc), s AS (SELECT b, count(*) AS s FROM x JOIN v USING (w) GROUP BY b), t2 AS (SELECT b, count(*) AS t FROM t JOIN v USING (w) GROUP BY b),
g AS (SELECT s.b, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT sum(s) FROM s)::DOUBLE + 10000) / ((s::DOUBLE + 1) * (coalesce((SELECT sum(t) FROM t2), 0)::DOUBLE + 10000))))::BIGINT AS gain FROM s LEFT JOIN t2 ON t2.b = s.b),
m AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM x JOIN v USING (w) JOIN g ON g.b = v.b GROUP BY doc_id),
r AS (SELECT d.doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || d.doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN m ON m.doc_id = d.doc_id),
p AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS n, count(*) FILTER (n_features >= 20) OVER () AS able FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND n <= able * 10 // 100 THEN n END AS rank FROM p""",
}
