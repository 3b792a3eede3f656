"""DuckDB formulations of the corpus queries that SQL can express."""

from __future__ import annotations

from seqlens.llm.licence_scan import BODIES, DICE, TEMPLATES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g GROUP BY 1, 2),
link AS (
  SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id
FROM documents d JOIN reach r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

_TEXT_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = rf"""
WITH d AS (SELECT doc_id, {_TEXT_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_TEXT_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[j:j + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS j FROM i WHERE len(w) > 0)),
seen AS (
  SELECT doc_id, k, j, array_to_string(w[j:j + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, k, j FROM seen JOIN windows USING (k, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(j, j + k)) AS p FROM hits) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(t, ',' ORDER BY t) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hits WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _bigrams(column: str) -> str:
    w = rf"string_split(trim(regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    return f"(SELECT list_distinct([x.w[i] || ' ' || x.w[i + 1] for i in range(1, len(x.w))]) FROM (SELECT {w} AS w) x)"


_VALUES = ", ".join(f"({n}, '{name}', '{words}', {n < len(TEMPLATES)})"
                    for n, (name, words) in enumerate(TEMPLATES + BODIES))
_PLAIN = r"string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"

# passages (lines, paragraphs, texts) against the notices; runs of a template's length,
# from any of its bigrams on, against notices and bodies; then the two BSD bodies
OP7 = rf"""
WITH t AS (
  SELECT id, name, whole, {_bigrams('words')} AS b, len(string_split(trim(regexp_replace(lower(words), '[^a-z0-9]+', ' ', 'g')), ' ')) - 1 AS length
  FROM (VALUES {_VALUES}) v(id, name, words, whole)),
ti AS (SELECT id, name, whole, len(b) AS n, unnest(b) AS g FROM t),
u AS (
  SELECT doc_id, unnest(string_split(text, chr(10)) || [text]
                        || [p for p in string_split_regex(text, '\n\s*\n') if contains(p, chr(10))]) AS p
  FROM documents WHERE text IS NOT NULL),
un AS (SELECT row_number() OVER () AS u, doc_id, b, len(b) AS n FROM (SELECT doc_id, {_bigrams('p')} AS b FROM u) WHERE len(b) > 0),
c AS (SELECT u, doc_id, un.n AS a, ti.id, ti.name, ti.n, count(*) AS c
      FROM (SELECT u, doc_id, n, unnest(b) AS g FROM un) un JOIN ti USING (g) WHERE ti.whole GROUP BY ALL),
f AS (SELECT doc_id, name, max(2.0::DOUBLE * c / (a + n)) AS dice FROM c WHERE 2 * c >= {DICE} * (a + n) GROUP BY 1, 2),
w AS (SELECT doc_id, [x.w[i] || ' ' || x.w[i + 1] for i in range(1, len(x.w))] AS p FROM (SELECT doc_id, {_PLAIN} AS w FROM documents WHERE text IS NOT NULL) x),
starts AS (
  SELECT DISTINCT h.doc_id, h.i, ti.id FROM (SELECT doc_id, unnest(p) AS g, generate_subscripts(p, 1) AS i FROM w) h JOIN ti USING (g)),
dense AS (  -- a run needs that many template bigrams
  SELECT doc_id, id FROM starts JOIN t USING (id) GROUP BY doc_id, id, len(t.b) HAVING count(*) >= len(t.b) * {DICE} / (2 - {DICE}) - 1e-9),
parts AS (
  SELECT s.doc_id, t.name, t.id, t.b, list_distinct(w.p[s.i:s.i + t.length - 1]) AS r
  FROM starts s JOIN dense USING (doc_id, id) JOIN t USING (id) JOIN w USING (doc_id)),
runs AS (
  SELECT doc_id, name, id, max(2.0::DOUBLE * len(list_intersect(r, b)) / (len(r) + len(b))) AS dice FROM parts GROUP BY ALL HAVING dice >= {DICE}),
best AS (SELECT doc_id, name, max(dice) AS dice FROM (SELECT doc_id, name, dice FROM f UNION ALL SELECT doc_id, name, dice FROM runs) GROUP BY 1, 2),
two AS (SELECT doc_id FROM best WHERE name = 'BSD-2-Clause'),
third AS (SELECT doc_id FROM runs WHERE id = (SELECT max(id) FROM t WHERE name = 'BSD-3-Clause')),
told AS (
  SELECT * FROM best
  WHERE NOT (name = 'BSD-2-Clause' AND doc_id IN (SELECT doc_id FROM third))
    AND NOT (name = 'BSD-3-Clause' AND doc_id IN (SELECT doc_id FROM two) AND doc_id NOT IN (SELECT doc_id FROM third))),
r AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names, max(dice) AS best FROM told GROUP BY 1)
SELECT d.doc_id, coalesce(r.n, 0) AS n_licences, coalesce(r.names, '') AS licences, coalesce(round(r.best, 9), 0.0::DOUBLE) AS best_dice
FROM documents d LEFT JOIN r USING (doc_id)"""

ORACLE = {"op1_ngram_jaccard_join": OP1, "op2_benchmark_decontamination": OP2, "op7_licence_scan": OP7}
