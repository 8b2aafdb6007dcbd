"""DuckDB SQL of the corpus queries that SQL can express."""

from tunelake.llm.quality_rules import STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP8 = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
tri AS (
  SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t)),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri), (VALUES (0), (1), (2)) AS o(k)
  WHERE n >= 2 GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) AS n_stop,
         len(list_filter(ls, lambda x: regexp_matches(x, '^ *[-*•] '))) AS n_bullet,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS n_cut
  FROM t LEFT JOIN rep ON t.doc_id = rep.doc_id),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2.0 * n_words AND 14.0 * n_words AND n_symbols / n_words <= 0.1
       AND n_stop / n_words >= 0.01 AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.3
       AND coalesce(n_bullet / nullif(n_lines, 0), 0) <= 0.9 AND coalesce(n_cut / nullif(n_lines, 0), 0) <= 0.3 AS kept
FROM f
"""

OP4 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM t WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id
    GROUP BY x.doc_id, y.doc_id) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * k >= 80 * (na.n + nb.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, t.doc_id = c.component_id AS kept
FROM t JOIN c ON t.doc_id = c.doc_id LEFT JOIN n ON n.doc_id = t.doc_id
"""

SQL = {"op4_tensor_dedup": OP4, "op8_quality_rules": OP8}
