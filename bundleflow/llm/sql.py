"""SQL that gives the rows of the corpus queries, where SQL can express them."""

from __future__ import annotations

from .licenses import NOTICES, SPELLINGS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    clean = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    clean = rf"regexp_replace({clean}, '(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*', chr(10), 'g')"
    clean = rf"regexp_replace({clean}, '[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')"
    for a, b in SPELLINGS:
        clean = rf"regexp_replace({clean}, '\b{a}\b', '{b}', 'g')"
    known = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in NOTICES)
    lines = f"list_filter(list_transform(string_split({clean}, chr(10)), lambda l: trim(l)), lambda l: l <> '')"
    return f"""
WITH known_texts(license_id, text) AS (VALUES {known}),
known AS (SELECT min(license_id) AS license_id, sha256(array_to_string({lines}, ' ')) AS digest FROM known_texts GROUP BY 2),
docs AS (SELECT row_number() OVER () AS r, doc_id, {lines} AS lines FROM documents),
hits AS (
  SELECT r, count(*) AS n_notices, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT r, unnest(lines) AS line FROM docs) JOIN known ON known.digest = sha256(line) GROUP BY r)
SELECT d.doc_id, sha256(array_to_string(d.lines, ' ')) AS digest, k.license_id,
  coalesce(h.n_notices, 0) AS n_notices, coalesce(h.notices, '') AS notices
FROM docs d LEFT JOIN hits h USING (r) LEFT JOIN known k ON k.digest = sha256(array_to_string(d.lines, ' '))
"""


LICENSE_SQL = _license_sql()


def _leak_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"list_filter(regexp_split_to_array({lower}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents),
items AS (SELECT cast(item_id AS varchar) AS item, {words} AS words FROM benchmark),
windows AS (
  SELECT item, words[s : s + 9] AS win FROM (SELECT item, words, unnest(range(1, len(words) - 8)) AS s FROM items WHERE len(words) >= 10)
  UNION SELECT item, words FROM items WHERE len(words) BETWEEN 1 AND 9),
lengths AS (SELECT DISTINCT len(win) AS n FROM windows),
seen AS (
  SELECT r, s, n, words[s : s + n - 1] AS win
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM docs, lengths WHERE len(words) >= n)),
hits AS (SELECT r, s, n, item FROM seen JOIN windows USING (win)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM hits)) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""


LEAK_SQL = _leak_sql()

WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS kept FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN kept IS DISTINCT FROM page_id AND kept IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN kept IS DISTINCT FROM page_id THEN kept END AS refers_to
FROM d LEFT JOIN k USING (payload_digest)
"""

TOOL_SQL = """
WITH a AS (
  SELECT row_number() OVER () AS r, conv_id, turn, length(coalesce(text, '')) AS n, regexp_extract(coalesce(text, ''), '[a-z]+') AS w
  FROM conversations WHERE role = 'assistant'),
calls AS (
  SELECT conv_id, turn, 1 AS step, 'a' || turn AS call_id, 'search' AS name, '' AS errors, '{"limit":' || (n % 50) || ',"query":"' || w || '"}' AS args FROM a
  UNION ALL
  SELECT conv_id, turn, 2, 'c' || turn, 'fetch', '', '{"deep":true,"id":' || n || '}' FROM a
  UNION ALL
  SELECT conv_id, turn, 3, 'b' || turn, 'count', CASE WHEN n % 5 = 0 THEN 'missing:source,type:unit' ELSE '' END,
    CASE WHEN n % 5 = 0 THEN '{"unit":7}' ELSE '{"source":"c' || turn || '","unit":"word"}' END FROM a),
results AS (
  SELECT conv_id, turn, kind || (turn - 1) AS call_id, md5(coalesce(text, '')) AS content
  FROM conversations, (VALUES ('a'), ('b'), ('c')) AS k(kind) WHERE role = 'user' AND turn >= 1 AND (kind <> 'b' OR turn % 4 <> 2)),
answers AS (SELECT conv_id, call_id, count(*) AS n_results, min(content) AS content FROM results GROUP BY 1, 2),
repeated AS (SELECT conv_id, call_id, count(*) AS n_calls FROM calls GROUP BY 1, 2)
SELECT conv_id, turn, step, call_id, name,
  CASE WHEN n_calls > 1 THEN 'duplicate_call' WHEN errors <> '' THEN 'invalid_arguments' WHEN n_results IS NULL THEN 'no_result' ELSE 'ok' END AS status,
  errors, coalesce(n_results, 0) AS n_results,
  '{"arguments":' || args || ',"id":"' || call_id || '","name":"' || name || '","result":' || coalesce('"' || content || '"', 'null') || '}' AS canonical
FROM calls LEFT JOIN answers USING (conv_id, call_id) LEFT JOIN repeated USING (conv_id, call_id)
UNION ALL
SELECT conv_id, turn, NULL, call_id, NULL, 'orphan_result', '', 1, '{"id":"' || call_id || '","result":"' || content || '"}'
FROM results WHERE NOT EXISTS (SELECT 1 FROM calls WHERE calls.conv_id = results.conv_id AND calls.call_id = results.call_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _split(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


ANCHOR_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_split("coalesce(text, '')")} AS words FROM documents),
windows AS (
  SELECT r, doc_id, s, md5(array_to_string(words[s : s + 49], ' ')) AS h
  FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM docs WHERE len(words) >= 50)),
lowest AS (SELECT h, min(doc_id) AS low FROM windows GROUP BY h),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(s, s + 50)) AS p FROM windows JOIN lowest USING (h) WHERE low < doc_id)),
counts AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r),
kept AS (
  SELECT r, string_agg(w, ' ' ORDER BY p) AS kept
  FROM (SELECT r, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS p FROM docs) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN counts USING (r) LEFT JOIN kept USING (r)
"""

# Windows of bytes as hexadecimal text; removed starts closer than a window form one removed run.
REPEAT_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT r, s, cast(doc_id AS hugeint) * 4294967296 + s AS place, md5(substr(h, cast(2 * s + 1 AS bigint), 200)) AS k
  FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS s FROM docs WHERE length(h) >= 200)),
lowest AS (SELECT k, min(place) AS low FROM windows GROUP BY k),
starts AS (SELECT r, s, coalesce(s > lag(s) OVER (PARTITION BY r ORDER BY s) + 100, false) AS apart FROM windows JOIN lowest USING (k) WHERE low < place),
numbered AS (SELECT r, s, count_if(apart) OVER (PARTITION BY r ORDER BY s) AS run FROM starts),
runs AS (SELECT r, run, min(s) AS a, max(s) + 100 AS b FROM numbered GROUP BY r, run),
counts AS (SELECT r, cast(sum(b - a) AS bigint) AS n_removed, count(*) AS n_spans, max(b) AS last FROM runs GROUP BY r),
before AS (SELECT r, a, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS since FROM runs),
pieces AS (SELECT r, string_agg(substr(h, cast(2 * since + 1 AS bigint), cast(2 * (a - since) AS bigint)), '' ORDER BY a) AS kept FROM before JOIN docs USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, cast(2 * coalesce(last, 0) + 1 AS bigint)))) AS kept_sha256
FROM docs LEFT JOIN counts USING (r) LEFT JOIN pieces USING (r)
"""

JACCARD_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_split(_LOWER)} AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[s : s + 2], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS s FROM docs WHERE len(words) >= 3)
  UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM docs WHERE len(words) BETWEEN 1 AND 2),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
linked AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT reach.doc_id, y FROM reach JOIN linked ON x = other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""

# A checksum of `<id>:<run>` byte by byte; near words meet where one letter is left out of either or both.
SPELLING_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
raw AS (SELECT run, n, hex(encode(coalesce(cast(doc_id AS varchar), '') || ':' || run)) AS h FROM runs WHERE length(run) >= 7),
summed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2),
    lambda i: (16 * (instr('0123456789ABCDEF', substr(h, cast(2 * i + 1 AS bigint), 1)) - 1) + instr('0123456789ABCDEF', substr(h, cast(2 * i + 2 AS bigint), 1)) - 1)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM raw, crc_table),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, cast(h % length(run) AS bigint)) || substr(run, cast(h % length(run) + 2 AS bigint)) ELSE run END AS word, n FROM summed),
words AS (SELECT word, cast(sum(n) AS bigint) AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
named AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 10 * w.n THEN b.top END AS form_n,
    (SELECT min(other) FROM near WHERE near.word = w.word AND near.other_n = b.top AND b.top >= 10 * w.n) AS form
  FROM words w LEFT JOIN best b USING (word)),
walk AS (
  SELECT word, word AS at FROM named
  UNION ALL SELECT walk.word, named.form FROM walk JOIN named ON named.word = walk.at WHERE named.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN named ON named.word = walk.at WHERE named.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM named JOIN ends USING (word)
"""
