"""The results of operators that SQL can express, as SQL over the same tables."""

DECONTAMINATION = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[j:j + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS j FROM bs)),
dw AS (SELECT r, j, n, array_to_string(w[j:j + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS j
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT r, j, n, item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(j, j + n)) AS p FROM (SELECT DISTINCT r, j, n FROM m)) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS digest
  FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)"""

NEAR_DEDUP = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[j:j + 4], ' ') AS g FROM (
  SELECT r, w, unnest(range(1, greatest(2, CAST(len(w) - 3 AS BIGINT)))) AS j FROM d
  WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS s FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r
  GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y
  WHERE 100 * s >= 75 * (a.n + b.n - s)),
c AS (SELECT r AS x, r AS y FROM n UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x),
k AS (SELECT c.x AS r, min(doc_id) AS component_id FROM c JOIN d ON d.r = c.y GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles,
  CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id,
  doc_id IS NOT DISTINCT FROM CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)"""

SUBSTRINGS = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT r, p, hash(b[p:p + 199]) AS h, md5(b[p:p + 199]) AS m
  FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS p FROM d
        WHERE octet_length(b) >= 200)),
t AS (SELECT r, p FROM s JOIN (SELECT h, m FROM s GROUP BY 1, 2 HAVING count(*) > 1) USING (h, m)),
i AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS island FROM (
  SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END
    AS fresh FROM t)),
x AS (SELECT r, min(p) AS a, max(p) + 200 AS z FROM i GROUP BY r, island),
k AS (SELECT r, a AS place, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 1) AS f, a - 1 AS l
  FROM x UNION ALL SELECT r, max(z) + 1, max(z), NULL FROM x GROUP BY r),
c AS (SELECT r, sha256(unhex(string_agg(hex(b[f:coalesce(l, octet_length(b))]), ''
    ORDER BY place))) AS digest FROM k JOIN d USING (r) GROUP BY r),
n AS (SELECT r, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM x GROUP BY r)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, coalesce(digest, sha256(b)) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r)"""

RANKED_SEARCH = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
total AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
q AS (SELECT item, t, count(*) AS many FROM (SELECT item, unnest(w) AS t FROM i) GROUP BY 1, 2),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
x AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS wt
  FROM f, total GROUP BY t, n_docs),
s AS (SELECT item, r, CAST(sum(many * wt * ((1000000000 * tf) // (1000 * tf
    + 8 * (25 + (75 * len(d.w) * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM f JOIN d USING (r) JOIN x USING (t) JOIN q USING (t), total GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank
  FROM s JOIN i USING (item) JOIN d USING (r) WHERE score > 0) WHERE rank <= 10"""
