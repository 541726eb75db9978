"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

#: The table of CRC-32 by its rule.
_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) AS r(i))"""


def _crc(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes; crc_table must be joined."""
    code = f"hex(encode({text}))"
    octets = f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr({code}, 2 * i + 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(t[CAST(xor(c % 256, b) + 1 AS BIGINT)], c // 256)))"


OP12 = f"""WITH {_CRC_TABLE},
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, h, least(h, coalesce(n, 0)) AS taken, head
  FROM (SELECT conv_id, conv_id - conv_id % 100 AS head, {_crc("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table)
  LEFT JOIN (SELECT conv_id AS head, count(*) AS n FROM turns GROUP BY conv_id) USING (head)),
rebuilt AS (
  SELECT c.conv_id, t.place + 1 AS depth, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.head AND t.place < c.h
  UNION ALL SELECT c.conv_id, t.place - c.h + c.taken + 1, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place >= c.h),
steps AS (
  SELECT conv_id, depth, length(text) AS n_chars, list(md5(role) || md5(text)) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, [] FROM convs),
ends AS (SELECT conv_id, max(depth) AS depth FROM steps GROUP BY conv_id),
nodes AS (
  SELECT path, s.depth, min(s.conv_id) AS conv_id, count(*) AS n_convs, any_value(n_chars) AS n_chars,
         sha256(coalesce(string_agg(CAST(s.conv_id AS VARCHAR), ',' ORDER BY s.conv_id) FILTER (WHERE s.depth = e.depth), '')) AS ends_sha256
  FROM steps s JOIN ends e USING (conv_id) GROUP BY path, s.depth),
kids AS (SELECT path[:-2] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT a.path, CAST(sum((n.n_convs - 1) * n.n_chars) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE k.path IS NULL) AS n_leaves
  FROM (SELECT path AS whole, path[:CAST(d AS BIGINT)] AS path FROM (SELECT path, unnest(range(depth + 1)) AS d FROM nodes)) a
  JOIN nodes n ON n.path = a.whole LEFT JOIN kids k ON k.path = a.whole GROUP BY a.path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (path) LEFT JOIN kids k USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[:-2]"""

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP13 = f"""WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, translate(run, '{_CAPITALS}', '{_CAPITALS.lower()}') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents) GROUP BY 1, 2),
hashed AS (SELECT run, n, {_crc("(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run)")} AS h FROM runs, crc_table),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -other_n, other := encode(other))) AS b FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 10 * n THEN decode(b.other) END AS form, CASE WHEN -b.less >= 10 * n THEN -b.less END AS form_n
  FROM words w LEFT JOIN best USING (word)),
followed AS (
  SELECT word, word AS root FROM forms
  UNION SELECT f.word, g.form FROM followed f JOIN forms g ON g.word = f.root WHERE g.form IS NOT NULL),
roots AS (SELECT f.word, f.root FROM followed f JOIN forms g ON g.word = f.root WHERE g.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""
