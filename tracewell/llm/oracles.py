"""DuckDB statements for the queries that SQL can express."""

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP6 = f"""
WITH item AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
grams AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k,
            array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS gram
          FROM item, range(1, len(ws) - least(len(ws), 10) + 2) r(i) WHERE len(ws) > 0),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
probe AS (SELECT r, i AS place, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS gram
          FROM doc, (SELECT DISTINCT k FROM grams) ks, range(1, len(ws) - k + 2) x(i)),
hit AS (SELECT r, place, k, item_id FROM probe JOIN grams USING (k, gram)),
hit_words AS (SELECT r, count(DISTINCT place + j) AS n_hit FROM (SELECT DISTINCT r, place, k FROM hit), range(0, k) x(j) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) + max(CAST(item_id IS NULL AS INT)) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (r) LEFT JOIN items USING (r)
"""

OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS u, vec_id AS r FROM embeddings UNION SELECT l.u, reach.r FROM links l JOIN reach ON reach.u = l.v),
comp AS (SELECT u, min(r) AS component_id FROM reach GROUP BY u), n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON comp.u = vec_id LEFT JOIN n ON n.u = vec_id
"""

ORACLES = {"op6_decontaminate": OP6, "op9_vectors": OP9}
