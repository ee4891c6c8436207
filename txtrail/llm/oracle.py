"""Check SQL of the operators whose rows SQL can express."""

from __future__ import annotations

CRC_TABLE = """crc AS (
    SELECT [list_reduce([n] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
            for n in range(256)] AS steps
)"""


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text, with `steps` of CRC_TABLE in reach."""
    code = f"hex(encode({text}))"
    octets = f"[CAST(concat('0x', substr({code}, i, 2)) AS BIGINT) for i in range(1, length({code}), 2)]"
    register = f"list_reduce([4294967295] || {octets}, lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8))"
    return f"xor({register}, 4294967295)"


ORACLE: dict[str, str] = {}

ORACLE["op11_importance_resampling"] = rf"""
WITH {CRC_TABLE}, d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), b AS (
    SELECT unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
    FROM benchmark
), w AS (
    SELECT r, word, count(*) AS n FROM (SELECT r, unnest(words) AS word FROM d) GROUP BY ALL
), k AS (
    SELECT word, {crc32("word")} % 10000 AS bucket
    FROM (SELECT word FROM w UNION SELECT word FROM b), crc
), s AS (
    SELECT bucket, sum(n) AS s FROM w JOIN k USING (word) GROUP BY bucket
), t AS (
    SELECT bucket, count(*) AS t FROM b JOIN k USING (word) GROUP BY bucket
), g AS (
    SELECT bucket, CAST(floor(1000 * ln(
        (CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST((SELECT sum(s) FROM s) AS DOUBLE) + 10000)
        / ((CAST(s AS DOUBLE) + 1) * (CAST((SELECT coalesce(sum(t), 0) FROM t) AS DOUBLE) + 10000)))) AS BIGINT) AS gain
    FROM s LEFT JOIN t USING (bucket)
), x AS (
    SELECT r, CAST(sum(n * gain) AS BIGINT) AS weight FROM w JOIN k USING (word) JOIN g USING (bucket) GROUP BY r
), y AS (
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
               (CAST(concat('0x', substr(sha256(concat('2024:', doc_id)), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE
           ))) AS BIGINT) AS score
    FROM d LEFT JOIN x USING (r)
), z AS (
    SELECT *, row_number() OVER (
        PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features DESC, weight DESC) AS place
    FROM y
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM y WHERE n_features >= 20) * 10 // 100
            THEN place END AS rank
FROM z
"""

# The clamped sources are those that come first by cap per weight, as many as keep the level above their own.
ORACLE["op13_source_mixing"] = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5(concat('mix-2024:', doc_id)) AS h
    FROM documents
), s AS (
    SELECT source, source_size, 2 * source_size AS cap,
           [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)
), o AS (
    SELECT *, coalesce(sum(cap) OVER w, 0) AS held, (SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER w, 0) AS free
    FROM s
    WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
    SELECT coalesce(arg_min(level, own), 0) AS level FROM (
        SELECT (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) * 150 / 100 - CAST(held AS DOUBLE)) / CAST(free AS DOUBLE) AS level,
               cap / weight AS own
        FROM o)
    WHERE level <= own
), t AS (
    SELECT source, source_size, CASE WHEN weight * level > cap THEN CAST(cap AS DOUBLE) ELSE weight * level END AS target
    FROM s, v
), x AS (
    SELECT doc_id, size, source_size, target,
           CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
           CAST(floor(target) AS BIGINT) AS words,
           CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS LAST, size
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       whole * size + greatest(0, least(size, words - whole * source_size - start)) AS taken
FROM x
"""

# A node is the list of its turns; its totals come to it from the rows of each node's smallest member.
ORACLE["op12_conversation_trie"] = f"""
WITH {CRC_TABLE}, o AS (
    SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
    SELECT o.conv_id, o.t, coalesce(b.t, []) AS base, {crc32("CAST(o.conv_id AS VARCHAR)")} % 6 AS h
    FROM crc, o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 100
), r AS (
    SELECT conv_id, list_concat(base[1:h], t[h + 1:]) AS t FROM h
), p AS (
    SELECT conv_id, len(t) AS length, unnest(range(0, len(t) + 1)) AS depth, t FROM r
), k AS (
    SELECT conv_id, length, depth, md5(CAST(t[1:depth] AS VARCHAR)) AS node,
           CASE WHEN depth > 0 THEN md5(CAST(t[1:depth - 1] AS VARCHAR)) END AS parent,
           CASE WHEN depth > 0 THEN length(t[depth][2]) ELSE 0 END AS chars
    FROM p
), n AS (
    SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, min(parent) AS parent, max(chars) AS chars,
           coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = depth), '') AS ends
    FROM k GROUP BY depth, node
), c AS (
    SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL
), s AS (
    SELECT k.depth, k.node, CAST(sum((n.n_convs - 1) * n.chars) AS BIGINT) AS saved_tokens,
           count(*) FILTER (c.n_children IS NULL) AS n_leaves
    FROM n LEFT JOIN c ON c.depth = n.depth AND c.node = n.node
    JOIN k ON k.conv_id = n.conv_id AND k.depth <= n.depth
    GROUP BY k.depth, k.node
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs,
       coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN s ON s.depth = n.depth AND s.node = n.node
LEFT JOIN c ON c.depth = n.depth AND c.node = n.node
LEFT JOIN n u ON u.depth = n.depth - 1 AND u.node = n.parent
"""
