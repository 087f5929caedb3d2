"""DuckDB twins of the registered queries that SQL can express."""

from __future__ import annotations

#: CRC-32 of a string expression of ASCII characters, bit by bit.
CRC32 = """xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(len({0})), lambda i: ord({0}[i + 1])::BIGINT)),
    lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)),
                               lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

TOPK = """
WITH v AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.row_no, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.row_no <> c.row_no
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, vec_id, score,
         row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

DECONTAMINATION = r"""
WITH item_words AS (
  SELECT item_id, text, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10ffff}]+') AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
items AS (
  SELECT item_id, text, width, unnest(list_distinct(list_transform(range(len(w) - width + 1),
         lambda i: array_to_string(w[i + 1:i + width], ' ')))) AS shingle
  FROM (SELECT *, least(5, len(w)) AS width FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT item_id, text, count(*) AS n_item FROM items GROUP BY item_id, text),
doc_words AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10ffff}]+') AS w
  FROM documents WHERE text IS NOT NULL),
doc_shingles AS (
  SELECT row_no, doc_id, width, unnest(list_distinct(list_transform(range(len(w) - width + 1),
         lambda i: array_to_string(w[i + 1:i + width], ' ')))) AS shingle
  FROM doc_words JOIN (SELECT DISTINCT width FROM items) ON len(w) >= width),
shared AS (
  SELECT row_no, doc_id, item_id, text, count(*) AS n_shared
  FROM doc_shingles JOIN items USING (width, shingle) GROUP BY row_no, doc_id, item_id, text)
SELECT doc_id, s.item_id, n_shared::INTEGER AS n_shared, n_item::INTEGER AS n_item,
       n_shared::DOUBLE / n_item::DOUBLE AS containment
FROM shared s JOIN sizes z ON s.item_id IS NOT DISTINCT FROM z.item_id AND s.text = z.text
WHERE n_shared >= 0.8::DOUBLE * n_item - 1e-9
"""

MIXING = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, 'null')) AS rank
  FROM documents),
weighed AS (
  SELECT source, source_size, 3 * source_size AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
level AS (
  SELECT 0.0::DOUBLE AS water
  UNION
  SELECT (SELECT (sum(source_size) - coalesce(sum(cap) FILTER (WHERE cap <= water * weight), 0))::DOUBLE
                 / (sum(weight) FILTER (WHERE cap > water * weight))::DOUBLE FROM weighed)
  FROM level WHERE water IS NOT NULL),
goals AS (
  SELECT source, source_size, target, least(round(target)::BIGINT, cap) AS goal
  FROM (SELECT *, CASE WHEN cap <= (SELECT max(water) FROM level) * weight THEN cap::DOUBLE
                       ELSE (SELECT max(water) FROM level) * weight END AS target FROM weighed)),
placed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0::BIGINT ELSE
         (goal // source_size) * size + greatest(0, least(size, goal % source_size - start)) END::BIGINT AS taken
FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source
"""

TRIE = f"""
WITH turns AS (
  SELECT conv_id, turn, len(text)::BIGINT AS chars, substr(sha256(len(role)::VARCHAR || ':' || role || text), 1, 32) AS digest
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL)),
own AS (
  SELECT conv_id, list(digest ORDER BY turn NULLS FIRST, digest, chars) AS d,
         list(chars ORDER BY turn NULLS FIRST, digest, chars) AS c
  FROM turns GROUP BY conv_id),
headed AS (SELECT *, conv_id - conv_id % 100 AS base, {CRC32.format("(conv_id::VARCHAR)")} % 6 AS h FROM own),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.d[1:h], []), a.d[h + 1:]) AS d, list_concat(coalesce(b.c[1:h], []), a.c[h + 1:]) AS c
  FROM headed a LEFT JOIN own b ON b.conv_id = a.base),
prefixes AS (
  SELECT conv_id, k AS depth, array_to_string(d[1:k], '') AS key, CASE WHEN k > 0 THEN c[k] ELSE 0 END AS chars, k = len(d) AS ended
  FROM (SELECT *, unnest(range(len(d) + 1)) AS k FROM rebuilt)),
nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ended) AS ids
  FROM prefixes GROUP BY key, depth),
kids AS (SELECT substr(key, 1, 32 * (depth - 1)) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
sums AS (
  SELECT substr(key, 1, 32 * up) AS key, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT nodes.key, unnest(range(depth + 1)) AS up, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * chars AS saved
        FROM nodes LEFT JOIN kids ON nodes.key = kids.key)
  GROUP BY 1)
SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n_convs, coalesce(n, 0)::BIGINT AS n_children,
       n_leaves, saved_tokens, sha256(coalesce(a.ids, '')) AS ends_sha256
FROM nodes a LEFT JOIN nodes p ON a.depth > 0 AND p.key = substr(a.key, 1, 32 * (a.depth - 1))
LEFT JOIN kids ON kids.key = a.key JOIN sums ON sums.key = a.key
"""

ORACLE: dict[str, str] = {
    "op2_topk": TOPK,
    "op6_decontamination": DECONTAMINATION,
    "op11_mixing": MIXING,
    "op13_trie": TRIE,
}
