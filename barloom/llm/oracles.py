"""DuckDB SQL of the queries that SQL can state, written apart from the Spark operators."""

from __future__ import annotations

from barloom.llm import licenses

_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
          r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

TOP_K = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

HARD_NEGATIVES = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
a AS MATERIALIZED (SELECT min(r) AS a, vec_id AS anchor_id, label, e FROM v WHERE vec_id % 50 = 0 GROUP BY ALL),
s AS MATERIALIZED (
  SELECT a, anchor_id, vec_id, a.label = v.label AS same, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score
  FROM a JOIN v ON anchor_id <> vec_id AND len(a.e) = len(v.e)),
p AS (SELECT * FROM (SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY a, place ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (a) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
WHERE rank <= 3
"""

REVISITS = """
WITH p AS MATERIALIZED (
  SELECT row_number() OVER () AS r, page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha,
    [instr('0123456789abcdef', substr(sha, CAST(i AS INTEGER) + 1, 1)) - 1 for i in range(40)] AS nibbles FROM pages),
b AS (SELECT *, [(nibbles[i // 4 + 1] >> CAST(3 - i % 4 AS INTEGER)) & 1 for i in range(160)] AS bits FROM p),
d AS (SELECT r, page_id, url, html, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + 16 * bits[5 * i + 1] + 8 * bits[5 * i + 2] + 4 * bits[5 * i + 3] + 2 * bits[5 * i + 4] + bits[5 * i + 5] AS INTEGER), 1)
    for i in range(32)], '') AS payload_digest FROM b),
o AS (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first_page FROM d
  WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS FIRST, r))
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN first_page END AS refers_to
FROM o
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT r, hash(list_slice(w, i, i + 4)) AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
l AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.r <> y.r GROUP BY ALL)
  JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 10 * c >= 8 * (na.n + nb.n - c)),
reach AS (SELECT r AS node, r AS other FROM d UNION SELECT node, b FROM reach JOIN l ON other = a),
c AS (SELECT node, min(doc_id) AS class_id, count(*) AS class_size FROM reach JOIN d ON d.r = other GROUP BY node)
SELECT doc_id, class_id, coalesce(k, 0) AS n_links, class_size
FROM d JOIN c ON c.node = d.r LEFT JOIN (SELECT a, count(*) AS k FROM l GROUP BY a) ON a = d.r
"""

REPEATED_STRINGS = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS MATERIALIZED (SELECT r, i, hash(array_slice(b, i, i + 199)) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d)),
u AS (SELECT r, i FROM p JOIN (SELECT h FROM p GROUP BY h HAVING count(*) > 1) USING (h)),
e AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM u),
s AS (SELECT r, min(i) AS a, max(i) + 199 AS z FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM e) GROUP BY r, run),
k AS (SELECT r, count(*) AS n_spans, sum(z - a + 1) AS n_removed FROM s GROUP BY r),
f AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS x, a - 1 AS y FROM s UNION ALL SELECT r, max(z) + 1, NULL FROM s GROUP BY r),
t AS (SELECT r, string_agg(hex(array_slice(b, x, coalesce(y, octet_length(b)))), '' ORDER BY x) AS kept
  FROM f JOIN d USING (r) WHERE x <= coalesce(y, octet_length(b)) GROUP BY r)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN b ELSE unhex(coalesce(kept, '')) END) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN t USING (r)
"""

_TEMPLATES = ", ".join(
    f"({t}, '{label}', {i}, '{word}', {str((licenses._key_bits(t) >> i) & 1 == 1).lower()})"
    for t, (label, text, _) in enumerate(licenses.TEMPLATES) for i, word in enumerate(text.split()))
_BASE = ", ".join(f"('{phrase}', '{label}')" for phrase, label in licenses.BASE.items())

LICENSES = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
tok AS MATERIALIZED (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
tem AS MATERIALIZED (SELECT * FROM (VALUES {_TEMPLATES}) v(t, label, place, word, needed)),
idf AS MATERIALIZED (
  SELECT word, round(ln(((SELECT count(*) FROM d) + 1) / (count(DISTINCT r) + 1)) + 1, 9) AS idf
  FROM (SELECT DISTINCT word FROM tem) LEFT JOIN tok USING (word) GROUP BY word),
rare AS (SELECT t, word FROM (SELECT DISTINCT t, word, idf FROM tem JOIN idf USING (word))
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY idf DESC, word) <= {licenses.RARE_WORDS}),
sums AS (SELECT t, label, sum(idf) AS total, count(*) FILTER (needed) AS needed FROM tem JOIN idf USING (word) GROUP BY ALL),
hit AS (
  SELECT r, tem.t, pos - place AS shift, sum(idf) AS got, count(*) FILTER (tem.needed) AS have, bool_or(rare.word IS NOT NULL) AS rare
  FROM tok JOIN tem USING (word) JOIN idf USING (word) LEFT JOIN rare ON rare.t = tem.t AND rare.word = tok.word GROUP BY ALL),
file AS (
  SELECT r, max(got / total) AS share, list(DISTINCT label) FILTER (have = needed AND got / total >= {licenses.LEAST_SHARE}) AS more
  FROM hit JOIN sums USING (t) WHERE rare GROUP BY r),
place AS (
  SELECT r, i - 1 AS pos, label FROM (SELECT r, w, label, string_split(phrase, ' ') AS p, unnest(range(1, len(w) + 1)) AS i
    FROM d, (VALUES {_BASE}) b(phrase, label)) WHERE list_slice(w, i, i + len(p) - 1) = p),
base AS (SELECT r, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS names FROM place GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(names, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(names, []), coalesce(more, [])))), ','), '') AS labels,
  round(CASE WHEN n > 0 THEN 1.0 ELSE least(coalesce(share, 0.0), 1.0) END, 6) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN file USING (r)
"""
