"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest FROM p),
g AS (SELECT digest, n, max(page_id) AS largest FROM d WHERE n >= 1000 GROUP BY 1, 2)
SELECT page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest, CASE WHEN largest IS NULL OR largest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN largest <> page_id THEN largest END AS refers_to
FROM d LEFT JOIN g ON d.digest = g.digest AND d.n = g.n"""

MIX = """
WITH RECURSIVE c AS (SELECT coalesce('s:' || source, 'null') AS key, count(*) AS n FROM documents GROUP BY 1),
i AS (SELECT key, power(CAST(n AS DOUBLE), 0.7) / sum(power(CAST(n AS DOUBLE), 0.7)) OVER () * (1000 - count(*) OVER ()) AS ideal, count(*) OVER () AS m FROM c),
w AS (SELECT *, floor(round(ideal, 9)) AS whole FROM i),
h AS (SELECT key, CAST(1 + whole + CASE WHEN row_number() OVER (ORDER BY round(ideal - whole, 9) DESC, key) <= 1000 - m - sum(whole) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share FROM w),
s AS (SELECT list(struct_pack(key := key, share := share) ORDER BY key) AS s FROM h),
e(t, done, pick) AS (
  SELECT 0, list_transform(s, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS BIGINT) FROM s
  UNION ALL SELECT t + 1, list_transform(done, lambda d, i: CASE WHEN i = p THEN d + 1 ELSE d END), p FROM (
    SELECT t, done, list_min(list_filter(list_transform(s, lambda x, i: CASE WHEN done[i] < x.share AND floor(done[i] * 1000 / x.share) <= t THEN struct_pack(deadline := CAST(ceil((done[i] + 1) * 1000 / x.share) AS BIGINT), i := CAST(i AS BIGINT)) END), lambda o: o IS NOT NULL)).i AS p
    FROM e, s WHERE t < 1000)),
q AS (SELECT t - 1 AS slot, s[pick].key AS key, s[pick].share AS share, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM e, s WHERE t > 0),
r AS (SELECT doc_id, source, coalesce('s:' || source, 'null') AS key, row_number() OVER (PARTITION BY coalesce('s:' || source, 'null') ORDER BY md5(CAST(doc_id AS STRING))) - 1 AS n FROM documents),
b AS (SELECT *, n // 8 AS block, n % 8 AS place FROM r)
SELECT doc_id, source, block, CAST(block // h.share * 1000 + floor(k * 1000 / h.share) AS BIGINT) AS release, CAST(block // h.share * 1000 + ceil((k + 1) * 1000 / h.share) AS BIGINT) AS deadline, block // h.share * 1000 + slot AS slot, place
FROM b JOIN h ON b.key = h.key JOIN q ON q.key = b.key AND q.k = b.block % h.share"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents), i AS (SELECT CAST(item_id AS STRING) AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS win FROM i, unnest(range(1, greatest(1, len(w) - 12) + 1)) t(k) WHERE len(w) > 0),
dw AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS win FROM d, (SELECT DISTINCT n FROM iw) l, unnest(range(1, len(w) - n + 2)) t(k)),
m AS (SELECT doc_id, k, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, k + j AS at FROM (SELECT DISTINCT doc_id, k, n FROM m), unnest(range(0, n)) t(j)) GROUP BY 1),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN x ON d.doc_id = x.doc_id"""

LINES = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, k, trim(ls[k], ' ') AS a, trim(ls[k + 1], ' ') AS b, trim(ls[k + 2], ' ') AS c FROM l, unnest(range(1, len(ls) - 1)) t(k)),
f AS (SELECT a, b, c, min(struct_pack(d := doc_id, k := k)) AS first FROM w GROUP BY 1, 2, 3),
r AS (SELECT doc_id, list(DISTINCT k + j) AS gone FROM w JOIN f ON w.a = f.a AND w.b = f.b AND w.c = f.c, (VALUES (0), (1), (2)) v(j) WHERE first <> struct_pack(d := doc_id, k := k) GROUP BY 1)
SELECT l.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ls ELSE list_filter(ls, lambda x, i: NOT list_contains(gone, i)) END, chr(10))) AS kept_sha256
FROM l LEFT JOIN r ON l.doc_id = r.doc_id"""

# unsigned crc32 of a text's UTF-8 bytes: a fold over bytes with the table of its 256 remainders
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc"
_BYTES = "list_transform(range(1, strlen(s) + 1), lambda i: 16 * (strpos('0123456789ABCDEF', substr(hex(s), 2 * i - 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(hex(s), 2 * i, 1)) - 1)"
_LOWER = "translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPELLING = f"""
WITH RECURSIVE t AS MATERIALIZED ({_CRC_TABLE}),
r AS (SELECT coalesce(CAST(doc_id AS STRING), '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS r FROM documents),
s AS (SELECT w, id || ':' || w AS s, m FROM (SELECT id, {_LOWER} AS w, count(*) AS m FROM r WHERE length(r) >= 7 GROUP BY 1, 2)),
h AS (SELECT w, m, xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, b: xor(c >> 8, crc[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) AS h FROM s, t),
n AS MATERIALIZED (SELECT w, CAST(sum(m) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS w, m FROM h) WHERE length(w) >= 7 GROUP BY 1 HAVING sum(m) >= 2),
d AS MATERIALIZED (SELECT w, length(w) AS l, k, substr(w, 1, k - 1) || substr(w, k + 1) AS v FROM n, unnest(range(1, length(w) + 1)) u(k)),
p AS (SELECT a.w, b.w AS x FROM d a JOIN d b ON a.k = b.k AND a.v = b.v AND a.l = b.l AND a.w <> b.w UNION SELECT d.v, d.w FROM d JOIN n ON n.w = d.v UNION SELECT d.w, d.v FROM d JOIN n ON n.w = d.v),
q AS (SELECT p.w, n.n, n.w AS x, count(*) OVER (PARTITION BY p.w) AS near, row_number() OVER (PARTITION BY p.w ORDER BY n.n DESC, n.w) AS i FROM p JOIN n ON n.w = p.x),
f AS MATERIALIZED (SELECT n.w AS word, CASE WHEN q.n >= 10 * n.n THEN q.x END AS form, n.n, coalesce(near, 0) AS n_near, CASE WHEN q.n >= 10 * n.n THEN q.n END AS form_n FROM n LEFT JOIN q ON q.w = n.w AND i = 1),
g(word, root) AS (SELECT word, word FROM f UNION SELECT g.word, f.form FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, g.root, f.n, f.n_near, f.form_n FROM f JOIN g USING (word) JOIN f e ON e.word = g.root AND e.form IS NULL"""

_HARD = "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))"
HARD_NEGATIVES = f"""
WITH e AS MATERIALIZED ({_HARD}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor, other, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) AS INT) AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3"""

SQL = {"op11_hard_negatives": HARD_NEGATIVES, "op13_spelling": SPELLING, "op2_warc": WARC, "op6_mix": MIX, "op7_decontaminate": DECONTAMINATION, "op8_line_dedup": LINES}
