"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

# Words of ASCII letters, digits and characters above U+007F, with A-Z lower-cased.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, n, i FROM places JOIN windows USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

# Word runs between space and U+0009 to U+000D; A-Z lower-cased.
OP6 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT DISTINCT x AS doc_id, x AS r FROM both_ways UNION SELECT b.x, r FROM reach JOIN both_ways b ON b.y = reach.doc_id WHERE r < b.x),
roots AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(r, doc_id), doc_id) AS component_id, coalesce(least(r, doc_id), doc_id) = doc_id AS kept
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id)
"""

# The pages' one template: an article whose blocks are h1 and p. Character
# references as they occur, the ampersand last.
_TEXT = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
OP3 = rf"""
WITH parts AS (
  SELECT page_id, url, list_filter(list_transform(string_split_regex({_TEXT}, '</?(p|h1)>'),
    lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks
  FROM pages)
SELECT page_id, url, t AS text, CAST(length(t) AS BIGINT) AS n_chars
FROM (SELECT page_id, url, regexp_replace(array_to_string(blocks, chr(10)), '&amp;?', '&', 'g') AS t FROM parts)
"""

# crc32 is computed byte by byte through its table of 256 entries. Near words
# are found as words that become equal when one loses a letter, or both the letter at the same place.
OP12 = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce(list_prepend(i, range(1, 9)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM (SELECT unnest(range(256)) AS i)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS name, run, count(*) AS k FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(name)), lambda i: CAST('0x' || substr(hex(encode(name)), 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM counted, bits),
spelt AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
less AS (
  SELECT word, n, 0 AS i, word AS v FROM words
  UNION ALL SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b USING (v) WHERE a.word <> b.word AND (a.i = b.i OR a.i = 0 OR b.i = 0)),
best AS (
  SELECT word, n_near, other, other_n
  FROM (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r FROM near) WHERE r = 1),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
onward AS (SELECT word, form AS root FROM forms WHERE form IS NOT NULL UNION SELECT o.word, f.form FROM onward o JOIN forms f ON f.word = o.root WHERE f.form IS NOT NULL),
ends AS (SELECT o.word, o.root FROM onward o JOIN forms f ON f.word = o.root WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)
"""

SQL = {"op3_html_text": OP3, "op4_decontaminate": OP4, "op6_minhash": OP6, "op12_spelling": OP12}
