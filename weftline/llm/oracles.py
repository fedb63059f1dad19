"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

OP6 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^ \t\n\x0B\f\r]+', 'w', 'g'), '[ \t\n\x0B\f\r]+', '', 'g')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) AS cap, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS step FROM s),
l AS (
  SELECT *, ((SELECT sum(CAST(source_size AS DOUBLE)) FROM s) - coalesce(sum(cap) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (
  SELECT source, source_size, least(cap, w * (SELECT level FROM l WHERE level * w <= cap ORDER BY step LIMIT 1)) AS target FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS passes FROM t),
r AS (
  SELECT *, CASE WHEN passes < 3 THEN least(greatest(CAST(round(target - passes * source_size) AS BIGINT), 0), source_size) ELSE 0 END AS rest FROM p),
c AS (
  SELECT source, h, sum(size) AS words, count(*) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h),
b AS (
  SELECT c.source, c.h AS threshold, CAST((r.rest - c.upto + c.words) // c.n AS BIGINT) AS share
  FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source
  WHERE r.rest > 0 AND c.upto >= r.rest AND c.upto - c.words < r.rest)
SELECT d.doc_id, d.size, r.source_size, r.target,
       CAST(r.passes * d.size + CASE WHEN d.h < b.threshold THEN d.size WHEN d.h = b.threshold THEN b.share ELSE 0 END AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""

OP3 = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT payload_digest, max(page_id) AS holder FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.holder <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.holder <> p.page_id THEN f.holder END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 1000
"""

OP7 = """
WITH e AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(q.v, e.v) AS BIGINT) AS score
  FROM e AS q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP11 = """
WITH s AS (
  SELECT *, CAST(floor(100 * coalesce(total, 0) + 0.5) AS BIGINT) AS cents, arrived_at + INTERVAL 240 MINUTE AS known,
         sold_at + to_seconds(xor(4294967295, list_reduce(
           list_concat([CAST(4294967295 AS BIGINT)], flatten([[(ascii(ch) >> i) & 1 FOR i IN range(8)] FOR ch IN string_split(coalesce(CAST(sale_id AS VARCHAR), ''), '')])),
           lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1)))) % 259200) AS t
  FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
c AS (
  SELECT *, CAST(floor(100 * coalesce(value, 0) + 0.5) AS BIGINT) AS cents, arrived_at + INTERVAL 240 MINUTE AS known FROM (SELECT DISTINCT * FROM clicks)),
p AS (
  SELECT sale_id, client_id, t, d, t - to_days(d) AS since FROM s, (VALUES (2), (14)) AS w(d)),
a AS (
  SELECT p.sale_id, p.d, count(*) AS n_clicks, count(*) FILTER (c.kind = 'purchase') AS n_purchases, sum(c.cents) AS click_cents,
         max(struct_pack(ts := c.ts, id := coalesce(c.click_id, -9223372036854775808))).id AS last_click_id
  FROM p JOIN c ON c.client_id = p.client_id AND c.ts > p.since AND c.ts <= p.t AND c.known <= p.t GROUP BY ALL),
b AS (
  SELECT p.sale_id, p.d, count(*) AS n_sales, sum(s.cents) AS sale_cents
  FROM p JOIN s ON s.client_id = p.client_id AND s.sold_at > p.since AND s.sold_at <= p.t AND s.known <= p.t GROUP BY ALL),
l AS (
  SELECT s.client_id, s.sold_at, s.known, x.shipped_at, x.item_id, CAST(floor(100 * coalesce(x.amount, 0) + 0.5) AS BIGINT) AS cents FROM sale_lines AS x JOIN s USING (sale_id)),
e AS (
  SELECT p.sale_id, p.d, count(*) AS n_lines, count(DISTINCT l.item_id) AS n_items, sum(l.cents) AS line_cents
  FROM p JOIN l ON l.client_id = p.client_id AND l.sold_at > p.since AND l.sold_at <= p.t AND l.known <= p.t AND l.shipped_at <= p.t GROUP BY ALL),
f AS (
  SELECT DISTINCT p.sale_id FROM p JOIN s ON s.client_id = p.client_id AND s.sold_at > p.t AND s.sold_at <= p.t + INTERVAL 7 DAY)
SELECT p.sale_id, CAST(p.d AS INTEGER) AS d, epoch_us(p.t) AS t_us, f.sale_id IS NOT NULL AS label,
       coalesce(n_clicks, 0) AS n_clicks, coalesce(n_purchases, 0) AS n_purchases, CAST(coalesce(click_cents, 0) AS BIGINT) AS click_cents,
       nullif(last_click_id, -9223372036854775808) AS last_click_id, coalesce(n_sales, 0) AS n_sales, CAST(coalesce(sale_cents, 0) AS BIGINT) AS sale_cents,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_items, 0) AS n_items, CAST(coalesce(line_cents, 0) AS BIGINT) AS line_cents
FROM p LEFT JOIN a USING (sale_id, d) LEFT JOIN b USING (sale_id, d) LEFT JOIN e USING (sale_id, d) LEFT JOIN f ON f.sale_id = p.sale_id
"""

OP13 = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
g AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM g GROUP BY doc_id),
z AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
m AS (SELECT doc_id, 10 + (90 * n * docs) // terms AS m FROM n, z),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM g, z GROUP BY term),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (
  SELECT q.item_id, g.doc_id, CAST(sum(w.w * ((1000000000 * g.tf) // (1000 * g.tf + 8 * m.m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN g USING (term) JOIN m USING (doc_id) GROUP BY ALL HAVING score > 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op3_warc": OP3, "op6_mixing": OP6, "op7_knn": OP7, "op11_point_in_time": OP11, "op13_lexical": OP13}
