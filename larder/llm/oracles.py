"""DuckDB SQL of the queries that SQL can express over whole tables."""

ORACLES: dict[str, str] = {}

ORACLES["op3_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *,
    [regexp_replace(regexp_replace(regexp_replace(x, '&(amp|lt|lb);', '&amp;\1;', 'g'),
       '<(/?s>)', '&lt;\1', 'g'), '\[(/?INST\])', '&lb;\1', 'g') FOR x IN [role, text]] AS esc,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM t
), f AS (
  SELECT *, length(esc[1]) + length(esc[2]) + length('<s>[INST]  [/INST]</s>') AS chars FROM e
), g AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto,
    (role = 'assistant' OR k = n - 1) AS stop FROM f
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY k)) AS loss_sha256,
  sum(CASE WHEN stop THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM g GROUP BY conv_id
"""

ORACLES["op4_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), o AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    row_number() OVER (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST) AS place FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (weights - coalesce(sum(weight) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    AS level FROM o
), w AS (SELECT level AS fill FROM l WHERE level * weight < cap ORDER BY place LIMIT 1),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT fill FROM w) * weight, cap::DOUBLE)) AS target FROM l
), r AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  ((floor(rate) + (u < rate - floor(rate))::INT)::BIGINT * size)::BIGINT AS taken FROM r
"""

ORACLES["op11_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
      lambda a, x: list_reduce([xor(a, x)] || range(8),
        lambda k, i: CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384) ELSE k >> 1 END)), 4294967295) % 9 AS h
  FROM t GROUP BY conv_id
), r AS (
  SELECT c.conv_id, t.pos + 1 AS depth, role, text FROM c JOIN t ON t.conv_id = c.base WHERE t.pos < c.h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)) + 1, role, text
  FROM c JOIN t ON t.conv_id = c.conv_id LEFT JOIN c b ON b.conv_id = c.base WHERE t.pos >= c.h
), p AS (
  SELECT conv_id, depth, strlen(text) AS bytes,
    string_agg(md5(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), l AS (SELECT conv_id, max(depth) AS depth, max_by(key, depth) AS key FROM p GROUP BY conv_id),
e AS (
  SELECT depth, key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM l GROUP BY depth, key
), n AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved FROM p GROUP BY depth, key
), k AS (
  SELECT depth - 1 AS depth, left(key, 32 * (depth - 1)) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2
), m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.depth = n.depth AND k.key = n.key),
u AS (SELECT *, unnest(range(depth + 1)) AS above FROM m),
s AS (
  SELECT above AS depth, left(key, 32 * above) AS key, sum(saved) AS saved_tokens,
    count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM u GROUP BY 1, 2
)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM m JOIN s ON s.depth = m.depth AND s.key = m.key LEFT JOIN e ON e.depth = m.depth AND e.key = m.key
LEFT JOIN m q ON q.depth = m.depth - 1 AND q.key = left(m.key, 32 * (m.depth - 1)) AND m.depth > 0
"""
