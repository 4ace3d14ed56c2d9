"""SQL that gives the rows of opN_ queries, where SQL can say them."""

from __future__ import annotations

#: Exact similarity of 5-word shingle sets, connected rows by recursion, classes of equal sets.
NGRAM_JACCARD_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' ')))) END AS grams FROM w
), k AS MATERIALIZED (
  SELECT min(r) AS c, grams, len(grams) AS n, min(doc_id) AS copy_id, count(*) AS copies FROM s GROUP BY grams
), g AS MATERIALIZED (
  SELECT c, n, unnest(grams) AS gram FROM k
), p AS MATERIALIZED (
  SELECT a.c AS a, b.c AS b FROM g a JOIN g b ON a.gram = b.gram AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING 10 * count(*) >= 8 * (a.n + b.n - count(*))
), t AS (
  SELECT c AS a, c AS b FROM k UNION SELECT t.a, p.b FROM t JOIN p ON t.b = p.a
), h AS (
  SELECT t.a AS c, min(k.copy_id) AS class_id FROM t JOIN k ON k.c = t.b GROUP BY t.a
), l AS (
  SELECT p.a AS c, sum(k.copies) AS links FROM p JOIN k ON k.c = p.b GROUP BY p.a
)
SELECT s.doc_id, h.class_id, k.copy_id, k.copies::BIGINT AS copies, (coalesce(l.links, 0) + k.copies - 1)::BIGINT AS links
FROM s JOIN k ON s.grams = k.grams JOIN h ON h.c = k.c LEFT JOIN l ON l.c = k.c
"""

#: Sizes, base-32 digests (four letters of every five hexadecimal digits) and the last page of each payload.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
l AS (SELECT h, max(page_id) AS m FROM p GROUP BY h),
d AS (SELECT page_id, h, m, sha1(h) AS x FROM p JOIN l USING (h))
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
    lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, (5 * i + 1)::BIGINT, 5))::BIGINT >> b) & 31)::BIGINT, 1)), '')), '') AS payload_digest,
  CASE WHEN m = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN m <> page_id THEN m END AS refers_to
FROM d
"""


_UPPER = "".join(map(chr, [*range(0x41, 0x5B), *(c for c in range(0xC0, 0xDF) if c != 0xD7)]))
_WORDS = rf"regexp_extract_all(translate(%s, '{_UPPER}', '{_UPPER.lower()}'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')"

#: BM25 shares of all passages and items, then overlaps of word triples of question and answer; the best passage of each.
BENCHMARK_DECONTAMINATION = f"""
WITH i AS (
  SELECT coalesce(item_id, -1) AS item_id, text, {_WORDS % "text"} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), items AS MATERIALIZED (
  SELECT row_number() OVER () AS r, item_id, text, w, len(w) AS n, (64 * pow(2, greatest(0, ceil(log2(len(w) / 64.0)))))::BIGINT AS stride FROM i WHERE len(w) > 0
), total AS (
  SELECT count(*) AS n, avg(n) AS mean FROM items
), tf AS (
  SELECT r, t, count(*) AS tf, any_value(n) AS n, any_value(stride) AS stride FROM (SELECT r, n, stride, unnest(w) AS t FROM items) GROUP BY r, t
), df AS (
  SELECT t, count(*) AS df FROM tf GROUP BY t
), score AS (
  SELECT r, t, stride, ln(1 + (total.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * tf.n / mean)) AS s FROM tf JOIN df USING (t), total
), share AS MATERIALIZED (
  SELECT r, t, stride, s / sum(s) OVER (PARTITION BY r) AS share FROM score
), d AS (
  SELECT row_number() OVER () AS rd, doc_id, {_WORDS % "coalesce(text, '')"} AS w FROM documents
), starts AS (
  SELECT rd, doc_id, w, stride, unnest(range(0, (greatest(1, ceil(len(w) / stride::DOUBLE)::BIGINT - 1) * stride)::BIGINT, stride)) AS start FROM d, (SELECT DISTINCT stride FROM items)
), passage AS MATERIALIZED (
  SELECT rd, doc_id, stride, start, w[start + 1:start + 2 * stride] AS w FROM starts
), hit AS MATERIALIZED (
  SELECT rd, start, p.stride, r, sum(share) AS bm25_share FROM (SELECT rd, start, stride, unnest(list_distinct(w)) AS t FROM passage) p JOIN share USING (t, stride) GROUP BY rd, start, p.stride, r HAVING sum(share) >= 0.5 - 1e-9
), cut AS (
  SELECT *, string_split(regexp_replace(trimmed, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS sentences, string_split_regex(trimmed, '\\s+') AS plain
  FROM (SELECT r, w, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS trimmed FROM items)
), halves AS (
  SELECT r, w, CASE WHEN len(sentences) > 1 THEN array_to_string(sentences[:-2], ' ') ELSE array_to_string(plain[:len(plain) - greatest(1, len(plain) // 3)], ' ') END AS q,
    CASE WHEN len(sentences) > 1 THEN sentences[-1] ELSE array_to_string(plain[len(plain) - greatest(1, len(plain) // 3) + 1:], ' ') END AS a FROM cut
), parts AS (
  SELECT r, CASE WHEN len(q) > 0 THEN q ELSE w END AS q, CASE WHEN len(a) > 0 THEN a ELSE w END AS a FROM (SELECT r, w, {_WORDS % "q"} AS q, {_WORDS % "a"} AS a FROM halves)
), grams AS (
  SELECT r, least(3, len(q)) AS nq, least(3, len(a)) AS na, q, a FROM parts
), wanted AS (
  SELECT r, nq, na, list_distinct(list_transform(range(1, len(q) - nq + 2), lambda i: array_to_string(q[i:i + nq - 1], ' '))) AS q, list_distinct(list_transform(range(1, len(a) - na + 2), lambda i: array_to_string(a[i:i + na - 1], ' '))) AS a FROM grams
), seen AS (
  SELECT h.*, p.doc_id, g.q, g.a, list_transform(range(1, len(p.w) - nq + 2), lambda i: array_to_string(p.w[i:i + nq - 1], ' ')) AS pq, list_transform(range(1, len(p.w) - na + 2), lambda i: array_to_string(p.w[i:i + na - 1], ' ')) AS pa
  FROM hit h JOIN passage p USING (rd, start, stride) JOIN wanted g USING (r)
), measured AS (
  SELECT *, len(list_intersect(q, pq)) / len(q)::DOUBLE AS question_overlap, len(list_intersect(a, pa)) / len(a)::DOUBLE AS answer_overlap FROM seen
)
SELECT doc_id, item_id, start AS passage, round(bm25_share, 6) AS bm25_share, question_overlap, answer_overlap FROM measured JOIN items USING (r)
WHERE least(question_overlap, answer_overlap) >= 0.5
QUALIFY row_number() OVER (PARTITION BY rd, r ORDER BY least(question_overlap, answer_overlap) DESC, start) = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard_join": NGRAM_JACCARD_JOIN, "op5_benchmark_decontamination": BENCHMARK_DECONTAMINATION, "op7_warc": WARC}
