"""SQL twins of operators that SQL can express."""

from __future__ import annotations

#: All pairs of equal lines, and the diagonals on which they follow each other.
OP5_SQL = r"""
WITH l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l0),
l2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS idx FROM l1 WHERE words > 0),
pairs AS (SELECT b.doc_id, b.pos, b.idx, b.words, a.doc_id AS other, b.idx - a.idx AS diagonal FROM l2 a JOIN l2 b ON a.line = b.line AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.idx < b.idx)),
runs AS (SELECT *, idx - row_number() OVER (PARTITION BY doc_id, other, diagonal ORDER BY idx) AS run FROM pairs),
long AS (SELECT doc_id, pos, sum(words) OVER (PARTITION BY doc_id, other, diagonal, run) AS n FROM runs),
gone AS (SELECT DISTINCT doc_id, pos FROM long WHERE n >= 10),
f AS (SELECT l1.*, CASE WHEN words > 0 THEN gone.pos IS NOT NULL END AS own FROM l1 LEFT JOIN gone ON gone.doc_id = l1.doc_id AND gone.pos = l1.pos),
g AS (SELECT *, coalesce(own, coalesce(last_value(own IGNORE NULLS) OVER before, false) AND coalesce(first_value(own IGNORE NULLS) OVER after, false)) AS goes FROM f
  WINDOW before AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '') AS text, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (goes) AS BIGINT) AS n_removed FROM g GROUP BY 1
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s0 AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s0),
e AS (SELECT doc_id, unnest(s) AS s FROM s0),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n_shingles + y.n_shingles - common)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS doc_id, a AS other FROM u UNION SELECT r.doc_id, u.b FROM reach r JOIN u ON u.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT n.doc_id, n_shingles, coalesce(component_id, n.doc_id) AS component_id, coalesce(component_id, n.doc_id) = n.doc_id AS kept FROM n LEFT JOIN c USING (doc_id)
"""
