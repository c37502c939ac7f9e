"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

QUALITY = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format(text="coalesce(text, '')")} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), numbered AS (SELECT row_number() OVER () AS r, * FROM base),
windows AS (
  SELECT r, unnest(range(1, len(w) - 3)) AS p, w FROM numbered WHERE len(w) >= 5
), grams AS (SELECT r, p, w[p:p + 4] AS g FROM windows),
twice AS (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM grams),
repeated AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2, p + 3, p + 4]) AS q FROM twice WHERE n > 1) GROUP BY r
), counted AS (
  SELECT doc_id, text, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words
  FROM numbered LEFT JOIN repeated USING (r)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words)
  AND NOT (word_chars < 2 * n_words OR word_chars > 20 * n_words)
  AND NOT (2 * n_dup_lines > n_lines)
  AND NOT (2 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]', '', 'g')))
  AND NOT (4 * length(regexp_replace(text, '[^!]', '', 'g')) > n_words)
  AND NOT (2 * length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) < word_chars) AS kept
FROM judged
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, w[p:p + 3] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1) LEFT JOIN sizes USING (doc_id)
"""

CHAT = r"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS text FROM conversations
), named AS (
  SELECT *, regexp_replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') AS name FROM raw
), m AS (
  SELECT *, CAST(coalesce(sum(length(text) + length(name) + 23) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1048576 AS INTEGER) AS part FROM named
), people AS (SELECT DISTINCT conv_id, role AS speaker FROM m WHERE role <> 'system'),
seen AS (
  SELECT m.*, speaker, CASE WHEN role = 'system' THEN '<|system|>' WHEN role = speaker THEN '<|assistant|>' ELSE '<|user name=' || name || '|>' END || chr(10) AS head
  FROM m JOIN people USING (conv_id)
), placed AS (
  SELECT *, row_number() OVER o AS k, coalesce(sum(length(head) + length(text) + 8) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS spot
  FROM seen WINDOW o AS (PARTITION BY conv_id, part, speaker ORDER BY turn, role, text)
)
SELECT conv_id, speaker, part, min(turn) AS first_turn, count(*) AS n_messages, count(*) FILTER (role = speaker) AS n_spoken,
  string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY k) AS text,
  coalesce(string_agg(CAST(CAST(spot AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(spot + length(text) AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (role = speaker), '') AS mask
FROM placed GROUP BY conv_id, part, speaker
"""

#: Unsigned CRC32 of the UTF-8 bytes of a text, a byte and then a bit at a time.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, octet_length(encode({text}))), lambda b: CAST('0x' || substr(hex(encode({text})), 2 * b + 1, 2) AS BIGINT))),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(i AS BIGINT) for i in range(8)]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

TRIE = rf"""
WITH own AS (
  SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i
  FROM (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (SELECT c, {_CRC32.format(text="CAST(c AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT c FROM own)),
heads AS (SELECT convs.c, own.i, role, text FROM convs JOIN own ON own.c = convs.c - convs.c % 20 AND own.i <= convs.h),
taken AS (SELECT convs.c, h, count(heads.i) AS m FROM convs LEFT JOIN heads ON heads.c = convs.c GROUP BY 1, 2),
turns AS (SELECT c, i AS d, role, text FROM heads UNION ALL SELECT own.c, own.i - h + m, role, text FROM own JOIN taken ON taken.c = own.c WHERE own.i > h),
paths AS (
  SELECT c, d, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY c ORDER BY d)) AS node, len({_WORDS.format(text="text")}) AS words FROM turns
  UNION ALL SELECT c, 0, '', 0 FROM convs
), nodes AS (SELECT node, d, min(c) AS c, count(*) AS n, any_value(words) AS words FROM paths GROUP BY 1, 2),
ups AS (SELECT v.node, v.d, above.c AS parent, above.node AS up FROM nodes v JOIN paths q ON q.c = v.c AND q.d = v.d - 1 JOIN nodes above ON above.node = q.node AND above.d = q.d),
below AS (SELECT up AS node, d - 1 AS d, count(*) AS children FROM ups GROUP BY 1, 2),
ends AS (SELECT node, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT *, max(d) OVER (PARTITION BY c) AS last FROM paths) WHERE d = last GROUP BY 1, 2),
sums AS (
  SELECT q.node, q.d, count(*) FILTER (below.children IS NULL) AS leaves, sum((v.n - 1) * v.words) AS saved
  FROM nodes v LEFT JOIN below ON below.node = v.node AND below.d = v.d JOIN paths q ON q.c = v.c AND q.d <= v.d GROUP BY 1, 2
)
SELECT v.c AS conv_id, CAST(v.d AS BIGINT) AS depth, ups.parent AS parent_conv_id, v.n AS n_convs, coalesce(children, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes v LEFT JOIN ups ON ups.node = v.node AND ups.d = v.d LEFT JOIN below ON below.node = v.node AND below.d = v.d LEFT JOIN ends ON ends.node = v.node AND ends.d = v.d JOIN sums ON sums.node = v.node AND sums.d = v.d
"""

SPELLING = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), each AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
drawn AS (SELECT run, n, {_CRC32.format(text="(doc_id || ':' || run)")} AS h FROM each),
counted AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM drawn)
  WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2
), cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM counted)),
pairs AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, cut.word FROM counted c JOIN cut ON cut.rest = c.word UNION SELECT cut.word, c.word FROM counted c JOIN cut ON cut.rest = c.word
), best AS (SELECT p.word, count(*) AS n_near, arg_min(near, (-m.n, near)) AS near, max(m.n) AS most FROM pairs p JOIN counted m ON m.word = near GROUP BY 1),
formed AS (SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * c.n THEN near END AS form, CASE WHEN most >= 10 * c.n THEN most END AS form_n FROM counted c LEFT JOIN best ON best.word = c.word),
chain AS (SELECT word, word AS spot, 0 AS step FROM formed UNION ALL SELECT chain.word, form, step + 1 FROM chain JOIN formed ON formed.word = spot WHERE form IS NOT NULL)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(spot, step) AS root FROM chain GROUP BY 1) r ON r.word = formed.word
"""

ORACLES = {"op2_quality": QUALITY, "op4_near_duplicates": NEAR_DUPLICATES, "op10_chat": CHAT, "op11_trie": TRIE, "op12_spelling": SPELLING}
