"""DuckDB SQL with the same rows as the queries that SQL can express: windows, shingle sets and links by brute force."""

from __future__ import annotations

# A-Z alone; DuckDB's lower() folds other letters too.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLDED = f"translate(text, '{UPPER}', '{UPPER.lower()}')"

DECONTAMINATION = rf"""WITH d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
  b AS (SELECT item_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark WHERE text IS NOT NULL),
  g AS (SELECT DISTINCT item_id, least(len(w), 10) n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) g FROM b WHERE len(w) > 0),
  n AS (SELECT DISTINCT n FROM g),
  p AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) g FROM d, n WHERE len(w) >= n),
  h AS (SELECT r, i, p.n, item_id FROM p JOIN g ON p.g = g.g AND p.n = g.n),
  hit AS (SELECT r, count(DISTINCT x) n_hit FROM (SELECT r, unnest(range(i, i + n)) x FROM h) GROUP BY 1),
  met AS (SELECT r, count(*) n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) items FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY 1)
  SELECT doc_id, coalesce(len(w), 0) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN met USING (r)"""

# Every two documents that share a shingle are compared on their whole sets; links are followed to the end.
# A set's name is its least document; a row whose text has no words is alone.
NEAR_DUPLICATES = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x20\x09-\x0D]+') w FROM documents),
  s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' ')))) s FROM d WHERE len(w) > 0),
  own AS (SELECT s, min(doc_id) id, len(s) n FROM s GROUP BY ALL), home AS (SELECT doc_id, id FROM s JOIN own USING (s)),
  e AS (SELECT id, n, unnest(s) g FROM own),
  links AS (SELECT a.id a, b.id b FROM e a JOIN e b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
  sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach AS (SELECT id, id AS other FROM own UNION SELECT r.id, b.b FROM reach r JOIN sides b ON b.a = r.other),
  least AS (SELECT id, min(other) component_id FROM reach GROUP BY 1)
  SELECT d.doc_id, coalesce(len(s), 0) n_shingles, coalesce(component_id, d.doc_id) component_id, d.doc_id = coalesce(component_id, d.doc_id) kept
  FROM d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN home h ON h.doc_id = d.doc_id LEFT JOIN least l ON l.id = h.id"""

ORACLE_SQL = {"op7_decontamination": DECONTAMINATION, "op8_neardup": NEAR_DUPLICATES}
