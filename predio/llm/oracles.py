"""DuckDB SQL for the queries that SQL can express."""

_BLANK = "[^\\x20\\x09-\\x0D]"

OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_BLANK}+') AS words,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_BLANK}')) AS lines FROM d),
windows AS (
  SELECT r, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS w3
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w3) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r),
c AS (
  SELECT doc_id, source, len(words) AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(repeated.n, 0) AS n_repeat_words
  FROM w LEFT JOIN repeated USING (r)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         10 * n_symbols > word_chars OR 10 * n_dup_lines > n_words AS other FROM c),
h AS (SELECT source, count(*) AS n, sum((base_failed OR other)::INT) AS k FROM f GROUP BY source),
m AS (SELECT avg(k / n) AS mean, avg(k / n * (k / n)) AS square FROM h),
p AS (SELECT mean, CASE WHEN square - mean * mean > 1e-12 AND mean * (1 - mean) > square - mean * mean
                        THEN mean * (1 - mean) / (square - mean * mean) - 1 ELSE 1 END AS weight FROM m),
v AS (SELECT source, (k + mean * weight) / (n + weight) < 0.5 AS fine FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND fine AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

OP10 = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS (SELECT doc_id, source, encode(coalesce(text, '')) AS b FROM documents),
k AS (
  SELECT doc_id, source, octet_length(b) + 8 AS size,
         xor(list_reduce(list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i + 1, 2))::BIGINT),
             lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM d, crc),
h AS (SELECT *, md5('0:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM k),
s AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h) - 1 + 0.5::DOUBLE)
                / count(*) OVER (PARTITION BY source) AS f FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY f, h) - 1 AS p, count(*) OVER () AS n FROM s)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p * 24 // n)::INT AS shard,
       p - ((p * 24 // n) * n + 23) // 24 AS slot, NULL::INT AS grown_shard
FROM p
"""

OP7 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANK}+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3),
                        lambda i: array_to_string(w[i:i + 4], chr(10))))
                      WHEN len(w) > 0 THEN [array_to_string(w, chr(10))] ELSE [] END AS sh FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
sides AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc, sides.b FROM r JOIN sides ON r.other = sides.a),
c AS (SELECT doc, min(other) AS component_id FROM r GROUP BY doc)
SELECT doc_id, len(sh) AS n_shingles, component_id FROM s JOIN c ON s.doc_id = c.doc
"""

OP11 = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
rows AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS n, role, text FROM rows),
convs AS (
  SELECT c, c - c % 20 AS base,
         xor(list_reduce(list_transform(range(length(c::VARCHAR)), lambda i: ord(substr(c::VARCHAR, i + 1, 1))::BIGINT),
             lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM own), crc),
built AS (
  SELECT convs.c, 0 AS side, n, role, text FROM convs JOIN own ON own.c = base WHERE base <> convs.c AND n <= h
  UNION ALL
  SELECT convs.c, 1, n, role, text FROM convs JOIN own USING (c) WHERE base = c OR n > h),
turns AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY side, n) AS depth, md5(role) || md5(text) AS hash,
         len(regexp_extract_all(text, '{_BLANK}+')) AS words FROM built),
prefixes AS (
  SELECT c, depth, string_agg(hash, '') OVER (PARTITION BY c ORDER BY depth) AS p, words FROM turns
  UNION ALL SELECT c, 0, '', 0 FROM convs),
nodes AS (SELECT depth, p, min(c) AS conv_id, count(*) AS n_convs, min(words) AS words FROM prefixes GROUP BY ALL),
kin AS (
  SELECT nodes.depth, nodes.p, nodes.conv_id, n_convs, nodes.words, up.p AS above,
         (SELECT min(x.conv_id) FROM nodes x WHERE x.depth = up.depth AND x.p = up.p) AS parent_conv_id
  FROM nodes LEFT JOIN prefixes up ON up.c = nodes.conv_id AND up.depth = nodes.depth - 1),
children AS (SELECT depth - 1 AS depth, above AS p, count(*) AS n_children FROM kin WHERE depth > 0 GROUP BY ALL),
facts AS (SELECT kin.*, coalesce(n_children, 0) AS n_children FROM kin LEFT JOIN children USING (depth, p)),
below AS (
  SELECT up.depth, up.p, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * facts.words) AS saved_tokens
  FROM facts JOIN prefixes up ON up.c = facts.conv_id AND up.depth <= facts.depth GROUP BY ALL),
ends AS (
  SELECT depth, p, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids
  FROM (SELECT c, max(depth) AS depth FROM prefixes GROUP BY c) JOIN prefixes USING (c, depth) GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM facts JOIN below USING (depth, p) LEFT JOIN ends USING (depth, p)
"""

_CONTROL = "\\\\|### |</turn>|<\\|"
_TRICKY = "\\### Assistant: </turn> ok"
OP13 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{_TRICKY}'),
e AS (SELECT *, length(regexp_replace(role, '({_CONTROL}|: )', 'x\\1', 'g')) + length(regexp_replace(text, '({_CONTROL})', 'x\\1', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

SQL = {
    "op6_quality_rules": OP6, "op7_ngram_jaccard": OP7, "op10_sharding": OP10, "op11_prefix_trie": OP11, "op13_chat_format": OP13,
}
