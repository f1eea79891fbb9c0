"""SQL for the operators that SQL can express, independent of their methods: joins on whole shingles, windows and edits."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
g AS (SELECT page_id, strlen(t) AS n, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p),
d AS (SELECT *, [('0x' || substr(h, 1 + 5 * i, 5))::BIGINT FOR i IN range(8)] AS v FROM g)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v[1 + k // 4] >> (15 - 5 * (k % 4))) & 31)::INT, 1) FOR k IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d"""

OP7 = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
want AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT item_id, w, least(len(w), 10) AS k FROM item WHERE len(w) > 0))),
size AS (SELECT DISTINCT k FROM want),
win AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, size WHERE len(w) >= k)),
hit AS (SELECT DISTINCT doc_id, item_id, k, i FROM win JOIN want USING (k, s)),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def components(percent: int, last: str) -> str:
    """Components of the documents whose sets of 5-word shingles are similar enough; equal sets are one node."""
    return f"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_sort(list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)])) END AS s FROM doc),
node AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
token AS (SELECT id, n, unnest(s) AS t FROM node),
pair AS (
  SELECT x.id AS a, y.id AS b FROM token x JOIN token y ON x.t = y.t AND x.id < y.id AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
  GROUP BY ALL HAVING 100 * count(*) >= {percent} * (any_value(x.n) + any_value(y.n) - count(*))),
edge AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT id AS a, id AS b FROM node UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
named AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a),
final AS (
  SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
  FROM sets d LEFT JOIN node n ON n.s = d.s LEFT JOIN named c ON c.id = n.id)
SELECT doc_id, n_shingles, component_id{last} FROM final"""


OP9 = components(75, "")
OP13 = components(85, ", doc_id = component_id AS kept")

#: crc32 of a string's UTF-8 bytes, a byte at a time over a table of 256 remainders.
_CRC_TABLE = """
crc AS (
  SELECT list(c ORDER BY k) AS t FROM (
    SELECT k, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k) AS c FROM range(256) r(k)))"""


def _crc(s: str) -> str:
    return (
        f"xor(4294967295, list_reduce([('0x' || substr(hex({s}), 2 * i + 1, 2))::BIGINT FOR i IN range(strlen({s}))], "
        f"lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295))"
    )


OP11 = f"""
WITH {_CRC_TABLE.strip()},
doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w, {_crc('doc_id::VARCHAR')} AS h FROM documents, crc),
cut AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM doc),
made AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
         THEN [CASE WHEN i >= a THEN w[1 + a + (i - a) % (1 + (n - a) // (3 + g % 8))] ELSE w[1 + i] END FOR i IN range(n)] ELSE w END AS w FROM cut),
word AS (SELECT doc_id, n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM made),
same AS (SELECT x.doc_id, y.i - x.i AS p, x.i AS i FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.x = y.x AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
part AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM (
  SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM same) GROUP BY doc_id, p, island),
run AS (SELECT doc_id, start, length, min(p) AS period FROM part WHERE length >= greatest(6, 4 * p) GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS s FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n_repeated FROM gone GROUP BY doc_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS rn FROM run) WHERE rn = 1),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM run GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_words, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(listed.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256,
       coalesce(n_repeated, 0)::BIGINT AS n_repeated
FROM made LEFT JOIN listed USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""

OP12 = f"""
WITH RECURSIVE {_CRC_TABLE.strip()},
found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
each AS (SELECT w, c, {_crc("(doc_id || ':' || w)")} AS h FROM (SELECT doc_id, w, count(*) AS c FROM found WHERE length(w) >= 7 GROUP BY ALL), crc),
vocab AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT c, CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM each)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
less AS (SELECT DISTINCT word, n, left(word, i::INT) || substr(word, i::INT + 2) AS short, i FROM (SELECT *, unnest(range(length(word))) AS i FROM vocab)),
near AS (
  SELECT DISTINCT x.word, y.word AS near, y.n FROM less x JOIN less y ON x.short = y.short AND x.i = y.i AND x.word <> y.word
  UNION
  SELECT DISTINCT x.word, v.word, v.n FROM less x JOIN vocab v ON v.word = x.short
  UNION
  SELECT DISTINCT v.word, x.word, x.n FROM less x JOIN vocab v ON v.word = x.short),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS top FROM near GROUP BY word),
form AS (
  SELECT word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 10 * v.n THEN near END AS form, CASE WHEN top >= 10 * v.n THEN top END AS form_n
  FROM vocab v LEFT JOIN best USING (word)),
chain AS (
  SELECT word, form AS last_form, 1 AS step FROM form WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN form f ON f.word = c.last_form WHERE f.form IS NOT NULL),
root AS (SELECT word, last(last_form ORDER BY step) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n::BIGINT AS form_n FROM form LEFT JOIN root USING (word)"""

ORACLES = {
    "op6_warc": OP6, "op7_winnowing": OP7, "op9_ngram_jaccard": OP9, "op11_periodic_runs": OP11, "op12_spelling_variants": OP12, "op13_minhash_stars": OP13,
}
