"""DuckDB SQL for the corpus queries that SQL can express, over whole tables and whole texts."""

#: The sets themselves decide which texts are one class; classes that share a shingle are compared in full, then what each class reaches.
OP6 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)])) END AS shingles FROM words
), classes AS (
  SELECT min(doc_id) AS class, shingles, len(shingles) AS n FROM sets WHERE len(shingles) > 0 GROUP BY shingles
), spread AS (
  SELECT class, n, unnest(shingles) AS shingle FROM classes
), pairs AS (
  SELECT a.class AS a, b.class AS b FROM spread a JOIN spread b ON a.shingle = b.shingle AND a.class < b.class
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach(node, seen) AS (
  SELECT class, class FROM classes UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a
), least AS (
  SELECT node, min(seen) AS component_id FROM reach GROUP BY node
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id, coalesce(l.component_id, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN classes c ON s.shingles = c.shingles LEFT JOIN least l ON l.node = c.class
"""

#: Every group and every lang gives each kept term its whole number p; a row of documents is a document.
OP11 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term
), sizes AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), totals AS (
  SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source
), grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0)::HUGEINT + 5 * s.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (s.total::HUGEINT + 5 * s.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes s ON g.lang = s.lang
  LEFT JOIN totals t ON g.lang = t.lang AND g.source = t.source LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM grid WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

#: As OP6 at a similarity of 0.8, without the column of kept rows.
OP13 = OP6.replace(">= 75 *", ">= 80 *").replace(", coalesce(l.component_id, s.doc_id) = s.doc_id AS kept", "")

ORACLES = {"op6_near_duplicates": OP6, "op11_divergence": OP11, "op13_prefix_join": OP13}
