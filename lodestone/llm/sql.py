"""SQL of those training-data queries that DuckDB can express on whole tables."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d)),
m AS (SELECT gram, min(doc_id) AS least FROM g GROUP BY gram),
c AS (SELECT DISTINCT doc_id, p FROM (SELECT g.doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m ON g.gram = m.gram WHERE m.least < g.doc_id)),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d),
k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.p) AS kept, count(*) AS n FROM w ANTI JOIN c ON w.doc_id = c.doc_id AND w.p = c.p GROUP BY w.doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP4 = """
SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to FROM (
  SELECT *, n >= 1000 AND page_id <> top AS again FROM (
    SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, ''))::BIGINT AS n, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages))
"""

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = rf"""
WITH i AS (SELECT item_id, {_ITEM_WORDS} AS words FROM benchmark),
q AS (SELECT DISTINCT item_id, size, array_to_string(words[k:k + size - 1], ' ') AS gram FROM (
  SELECT item_id, words, least(10, len(words)) AS size, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS k FROM i WHERE len(words) > 0)),
d AS (SELECT doc_id, {_ITEM_WORDS} AS words FROM documents),
g AS (SELECT doc_id, size, k, array_to_string(words[k:k + size - 1], ' ') AS gram FROM (
  SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM q) WHERE len(words) >= size)),
h AS (SELECT doc_id, item_id, k, g.size FROM g JOIN q ON g.gram = q.gram AND g.size = q.size),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
"""

OP12 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 80 * positive_score AND 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""

OP13 = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}') AS body FROM documents) WINDOW w AS (PARTITION BY body)
"""
