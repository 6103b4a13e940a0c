"""DuckDB SQL for the queries of this package that SQL can express."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LOW = _LOWER.format("coalesce(text, '')")

ORACLES: dict[str, str] = {}

ORACLES["op1_decontaminate"] = rf"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
sized AS (SELECT item, w, least(10, len(w)) AS m FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
docs AS (
  SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
  FROM docs, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m),
hits AS (
  SELECT p.doc_id, p.i, p.m, x.item
  FROM (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM places) p
  JOIN windows x ON x.m = p.m AND x.win = p.win),
words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS j FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

ORACLES["op2_line_dedup"] = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM split),
keyed AS (
  SELECT doc_id, pos, line,
         {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT k.*, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN shared s USING (key))
GROUP BY doc_id
"""

ORACLES["op5_topk_bsi"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (
  SELECT query_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLES["op10_chat_format"] = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         role IS NULL AS no_role, text IS NULL AS no_text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
prefixes AS (
  SELECT conv_id, place, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(no_role || ':' || no_text || ':' || length(role) || ':' || length(text) || ':' || role || text, '|')
           OVER (PARTITION BY conv_id ORDER BY place) AS prefix
  FROM turns),
whole AS (
  SELECT prefix, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM prefixes WHERE place = n GROUP BY prefix, n),
kept AS (
  SELECT w.* FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.place = w.n AND p.place < p.n AND p.prefix = w.prefix))
SELECT k.conv_id, CAST(k.n AS BIGINT) AS n_turns, CAST(k.n_copies AS BIGINT) AS n_copies,
       string_agg('<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10), '' ORDER BY t.place) AS text
FROM kept k JOIN turns t USING (conv_id) GROUP BY k.conv_id, k.n, k.n_copies
"""
