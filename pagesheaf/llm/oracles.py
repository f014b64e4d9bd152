"""Independent SQL for the queries of this subpackage that SQL can express."""

# Every prefix as a list of turns; CRC-32 is folded bit by bit over the characters of the id.
CONVERSATION_TRIE = r"""
WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
bits AS (
    SELECT conv_id, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda a, b: list_reduce(
            list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda r, z: xor(r >> 1, CASE WHEN r % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))) AS crc
    FROM ids),
heads AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(crc, 4294967295::BIGINT) % 4 AS h FROM bits),
turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
               sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (
    SELECT h.conv_id, 0 AS part, t.pos, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.base AND t.pos <= h.h
    UNION ALL
    SELECT h.conv_id, 1, t.pos, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.pos > h.h),
chain AS (
    SELECT conv_id, row_number() OVER w AS depth, text,
           list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING) AS prefix
    FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
members AS (
    SELECT conv_id, depth, prefix, text FROM chain
    UNION ALL SELECT conv_id, 0, [], '' FROM ids),
lengths AS (SELECT conv_id, max(depth) AS length FROM members GROUP BY conv_id),
nodes AS (
    SELECT depth, prefix, min(m.conv_id) AS conv_id, count(*) AS n_convs,
           len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS words,
           sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (WHERE l.length = m.depth), '')) AS ends_sha256
    FROM members m JOIN lengths l ON l.conv_id = m.conv_id GROUP BY depth, prefix),
placed AS (
    SELECT m.conv_id, m.depth, n.conv_id AS least, n.n_convs, n.words, n.ends_sha256
    FROM members m JOIN nodes n ON n.depth = m.depth AND n.prefix = m.prefix),
kids AS (
    SELECT p.least AS conv_id, p.depth, count(*) AS n_children
    FROM nodes c JOIN placed p ON p.conv_id = c.conv_id AND p.depth = c.depth - 1 GROUP BY ALL),
below AS (
    SELECT p.least AS conv_id, p.depth, sum((c.n_convs - 1) * c.words) AS saved_tokens, count(*) FILTER (WHERE k.conv_id IS NULL) AS n_leaves
    FROM nodes c JOIN placed p ON p.conv_id = c.conv_id AND p.depth <= c.depth
    LEFT JOIN kids k ON k.conv_id = c.conv_id AND k.depth = c.depth GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.least AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
       b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.conv_id = n.conv_id AND b.depth = n.depth
LEFT JOIN kids k ON k.conv_id = n.conv_id AND k.depth = n.depth
LEFT JOIN placed up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1
"""

ORACLES: dict[str, str] = {"op12_trie": CONVERSATION_TRIE}
