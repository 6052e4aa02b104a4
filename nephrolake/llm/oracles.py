"""DuckDB forms of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from . import line_dedup
from . import quality_rules as q

#: Windows of 50 bytes as hex, the smallest document of each, islands of covered bytes.
SUBSTRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS least FROM win) WHERE least < doc_id),
isle AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
    SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM dup)) GROUP BY doc_id, g),
gap AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM isle),
cut AS (SELECT g.doc_id, count(*) AS n_spans, sum(e - s)::BIGINT AS n_removed, max(e) AS last, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) AS head
    FROM gap g JOIN d ON g.doc_id = d.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id
"""

NGRAMS = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, k FROM (
  SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM met JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 75 * (a.n + b.n - o)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON d.doc_id = c.x
"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = v.vec_id AS kept
FROM v LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) l ON v.vec_id = l.x JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON v.vec_id = c.x
"""


def _quoted(phrases) -> str:
    return " OR ".join(f"contains(lower(line), '{p}')" for p in phrases)


QUALITY = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, coalesce(text, '') AS text FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win), range(5) t(j) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
m AS (SELECT *, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS solid, length(regexp_replace(line, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS letters,
  length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols, length(regexp_replace(line, '[^!?]', '', 'g')) AS shouts, length(regexp_replace(line, '[^|»›>]', '', 'g')) AS seps FROM l),
f AS (SELECT doc_id, sum(solid) FILTER (bad) AS lost, count(*) FILTER (solid > 0) - count(DISTINCT line) FILTER (solid > 0) AS dups, sum(symbols) AS symbols FROM (
  SELECT *, symbols > {q.SYMBOL_SHARE}::DOUBLE * solid OR shouts > {q.SHOUT_SHARE}::DOUBLE * solid OR seps >= {q.MIN_SEPARATORS} OR {_quoted(q.BOILERPLATE)}
    OR (length(line) <= {q.MENU_CHARS} AND regexp_matches(lower(line), '{q.MENU}')) OR letters < {q.LETTER_SHARE}::DOUBLE * solid AS bad FROM m) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, symbols::BIGINT AS n_symbols, dups AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w JOIN f ON w.doc_id = f.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PCT} * n_words AS base_failed,
  NOT (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PCT} * n_words) AND lost <= {q.MAX_LOST}::DOUBLE * word_chars AS kept
FROM c
"""

ORACLE_SQL = {
    "op1_substring_dedup": SUBSTRINGS,
    "op2_ngram_join": NGRAMS,
    "op6_vector_dedup": VECTORS,
    "op7_line_dedup": line_dedup.ORACLE,
    "op10_quality_rules": QUALITY,
}
