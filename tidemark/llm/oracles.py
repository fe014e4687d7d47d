"""SQL twins of queries whose every column SQL can express."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = rf"regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+')"
ALNUM = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

NEAR_DUPLICATES = f"""WITH RECURSIVE worded AS (SELECT doc_id, {SPACED} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]))
  WHEN len(w) > 0 THEN [w] ELSE [] END AS s FROM worded),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM reached r JOIN edges e ON r.y = e.a),
lowest AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN lowest l ON l.x = s.doc_id"""

CONTAMINATION = f"""WITH docs AS (SELECT doc_id, {ALNUM} AS w FROM documents),
items AS (SELECT item_id, {ALNUM} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, w[i + 1:i + n] AS g FROM (
  SELECT item_id, w, least(13, len(w)) AS n, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT doc_id, n, i, w[i + 1:i + n] AS g FROM (
  SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN windows x ON p.g = x.g),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(l.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l.ids, '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN listed l USING (doc_id)"""
