"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

OP3 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)),
                     lambda x: length(translate(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS ls
  FROM d
), wins AS (
  SELECT r, i, md5(array_to_string(ws[i:i+7], ' ')) AS h
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS n FROM wins) WHERE n > 1
), covered AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r
), failed AS (
  SELECT r, sum(length(translate(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13), ''))) AS lost
  FROM (SELECT r, unnest(ls) AS line FROM w)
  WHERE NOT regexp_matches(line, '[.!?…。][\"'')\]»”]*([\x20\x09-\x0D]|$)')
     OR len(regexp_extract_all(line, '[\p{P}\p{S}]')) > 0.12 * length(line)
     OR len(regexp_extract_all(line, '[|›»•>]')) >= 3
     OR regexp_matches(line, '(?i)all rights reserved|copyright|©|\blicensed under\b|\breleased under the\b|\bcookies?\b|privacy policy|terms of (use|service)|\bsubscribe\b|\bsign (up|in)\b|\blog in\b|click here|read more|javascript')
  GROUP BY r
), counted AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN covered USING (r) LEFT JOIN failed USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost <= 0.5 * word_chars AS kept
FROM counted
"""

#: Level of the sources below their limit, and for each source the nearest sum of
#: whole groups of equal hashes, found by sorting.
OP10 = """
WITH d AS (
  SELECT doc_id, source,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), p AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM s
), w AS (
  SELECT *, [5, 2, 1][(place % 3 + 1)::INT] AS weight, 3 * source_size AS most FROM p
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
         row_number() OVER o AS k
  FROM w WINDOW o AS (ORDER BY most / weight, encode(source) NULLS LAST)
), f AS (
  SELECT *, (SELECT min(k) FROM l WHERE level * weight <= most) AS first FROM l
), t AS (
  SELECT source, source_size,
         coalesce(least((SELECT level FROM f WHERE k = first) * weight, most::DOUBLE), most::DOUBLE) AS target
  FROM f
), c AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), g AS (
  SELECT d.source, h, sum(size) AS n, any_value(target - whole * source_size) AS rest
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source GROUP BY d.source, h
), r AS (
  SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM g
), b AS (
  SELECT source, h, upto <= rest OR (upto - n <= rest AND upto - rest < rest - (upto - n)) AS fits FROM r
)
SELECT d.doc_id, d.size, c.source_size, c.target,
       (d.size * (c.whole + CASE WHEN b.fits THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
JOIN b ON d.source IS NOT DISTINCT FROM b.source AND d.h = b.h
"""

#: Every window of 50 words with the smallest document that it starts in.
OP4 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), w AS (
  SELECT r, doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS h
  FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50 AND doc_id IS NOT NULL)
), f AS (
  SELECT h, min(doc_id) AS earliest FROM w GROUP BY h
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 50)) AS k FROM w JOIN f USING (h) WHERE earliest < doc_id
), kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY k) AS rest, count(*) AS n
  FROM (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS k FROM d) ANTI JOIN gone USING (r, k) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

#: All pairs with a common shingle, and who is reached over the links.
OP7 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT r, doc_id, array_to_string(ws[i:i+4], ' ') AS shingle
  FROM (SELECT r, doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) AS i FROM d)
), n AS (
  SELECT r, count(*) AS size FROM s GROUP BY r
), pairs AS (
  SELECT a.r AS a, b.r AS b, count(*) AS shared
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.r <> b.r AND a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * shared >= 75 * (x.size + y.size - shared)
), reached AS (
  SELECT r, r AS other FROM d
  UNION
  SELECT reached.r, b FROM reached JOIN links ON links.a = other
)
SELECT d.doc_id, coalesce(any_value(size), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id,
       coalesce(d.doc_id = min(o.doc_id), true) AS kept
FROM d LEFT JOIN n USING (r) JOIN reached USING (r) JOIN d o ON o.r = other GROUP BY d.r, d.doc_id
"""

OP11 = r"""
WITH t AS (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, coalesce(text, '') AS x
  FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos, k,
         len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words
  FROM t
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))
         ), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM numbered)
), heads AS (
  SELECT c.conv_id, n.pos AS depth, n.k, n.words FROM convs c JOIN numbered n ON n.conv_id = c.base AND n.pos <= c.h
), lead_in AS (
  SELECT conv_id, count(*) AS m FROM heads GROUP BY conv_id
), turns AS (
  SELECT * FROM heads
  UNION ALL
  SELECT n.conv_id, n.pos - c.h + coalesce(m, 0), n.k, n.words
  FROM numbered n JOIN convs c USING (conv_id) LEFT JOIN lead_in USING (conv_id) WHERE n.pos > c.h
), paths AS (
  SELECT conv_id, depth, words, md5(string_agg(k, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS p,
         depth = max(depth) OVER (PARTITION BY conv_id) AS last
  FROM turns
  UNION ALL
  SELECT c.conv_id, 0, 0, '', t.conv_id IS NULL FROM convs c LEFT JOIN (SELECT DISTINCT conv_id FROM turns) t USING (conv_id)
), nodes AS (
  SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM paths GROUP BY depth, p
), edges AS (
  SELECT n.*, up.p AS parent, parent.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN paths up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1
               LEFT JOIN nodes parent ON parent.depth = up.depth AND parent.p = up.p
), kids AS (
  SELECT depth - 1 AS depth, parent AS p, count(*) AS n_children FROM edges WHERE depth > 0 GROUP BY ALL
), own AS (
  SELECT e.*, coalesce(n_children, 0) AS n_children FROM edges e LEFT JOIN kids k USING (depth, p)
), sums AS (
  SELECT up.depth, up.p, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * own.words) AS saved_tokens
  FROM own JOIN paths up ON up.conv_id = own.conv_id AND up.depth <= own.depth GROUP BY up.depth, up.p
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM own JOIN sums USING (depth, p)
"""

ORACLES = {
    "op3_quality_lines": OP3,
    "op4_seed_extend": OP4,
    "op7_superminhash": OP7,
    "op10_mix_sources": OP10,
    "op11_prefix_trie": OP11,
}
