"""DuckDB SQL of the queries that SQL can express."""

#: a query with several rows counts by the least of its vectors; candidates are all rows of another id
EXACT_TOPK = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM q JOIN v c ON c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: runs of words of each window's length are joined with the windows
DECONTAMINATION = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM b, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS t(i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS rn, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT rn, i AS pos, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM d, (SELECT DISTINCT size FROM win) AS s, unnest(range(1, len(w) - size + 2)) AS t(i) WHERE len(w) >= size),
occ AS (SELECT DISTINCT rn, pos, g.size, item FROM g JOIN win ON win.size = g.size AND win.gram = g.gram),
hit AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(pos, pos + size)) AS p FROM occ) GROUP BY rn),
found AS (SELECT rn, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items FROM (SELECT DISTINCT rn, item FROM occ) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rn) LEFT JOIN found USING (rn)
"""

#: a document's failed filters as bits, then sums over all 120 orders
FILTER_AUDIT = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
), w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d), l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(first < doc_id, false) AS INT) AS mask
  FROM w LEFT JOIN l USING (doc_id)
), c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(k, bit)),
o AS (
  SELECT a.k || b.k || c.k || d.k || e.k AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a JOIN f b ON b.k <> a.k JOIN f c ON c.k NOT IN (a.k, b.k) JOIN f d ON d.k NOT IN (a.k, b.k, c.k) JOIN f e ON e.k NOT IN (a.k, b.k, c.k, d.k)
), s AS (
  SELECT filter_order, i AS step, bits[i] AS bit, CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS INT) AS before FROM o, range(1, 6) AS t(i)
)
SELECT part, filter_order, CAST(step AS INT) AS step,
  CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN mask & bit <> 0 THEN n * (120 // bit_count(mask)) ELSE 0 END) AS BIGINT) AS shapley
FROM c, s GROUP BY part, filter_order, step
"""

#: nodes are paths of turns, named by the digests of the turns; sums over subtrees by way of each node's smallest member
PREFIX_TRIE = """
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS c, turn, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS g,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT c, list({g: g, w: w} ORDER BY turn NULLS FIRST, g) AS own FROM t GROUP BY c),
bits AS (SELECT i AS v, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS crc FROM range(256) AS x(i)),
tab AS (SELECT list(crc ORDER BY v) AS tab FROM bits),
h AS (
  SELECT c, own, CAST(xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1]))) % 4 AS INT) AS h
  FROM o, tab
), r AS (SELECT h.c, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS turns FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20),
p AS (
  SELECT c, CAST(d AS BIGINT) AS depth, array_to_string(list_transform(turns[1:d], lambda x: x.g), '') AS path, array_to_string(list_transform(turns[1:d - 1], lambda x: x.g), '') AS up,
    CASE WHEN d > 0 THEN turns[d].w ELSE 0 END AS w, d = len(turns) AS whole
  FROM r, range(0, len(turns) + 1) AS x(d)
), n AS (
  SELECT depth, path, min(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (whole), '')) AS ends_sha256
  FROM p GROUP BY depth, path
), k AS (SELECT depth - 1 AS depth, up AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, path)),
s AS (
  SELECT a.depth, a.path, sum((m.n_convs - 1) * m.w) AS saved_tokens, count(*) FILTER (m.n_children = 0) AS n_leaves
  FROM m JOIN p a ON a.c = m.conv_id AND a.depth <= m.depth GROUP BY a.depth, a.path
)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s USING (depth, path) LEFT JOIN n u ON u.depth = m.depth - 1 AND u.path = m.up
"""
