"""DuckDB SQL of the corpus queries that SQL can express."""

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id AS id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_docs FROM d GROUP BY source),
p AS (SELECT *, (row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1)::BIGINT AS place, source_size * 3 AS cap FROM s),
w AS (SELECT *, (place % 3 + 1)::DOUBLE AS w FROM p),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER o AS turn
  FROM w WINDOW o AS (ORDER BY cap / w, place)),
v AS (SELECT arg_min(level, turn) AS level FROM l WHERE level * w <= cap),
t AS (
  SELECT source AS s, source_size, source_docs, least(cap::DOUBLE, coalesce(v.level * w, cap::DOUBLE)) AS target FROM l LEFT JOIN v ON true),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END::BIGINT AS certain FROM t),
e AS (SELECT *, greatest(0.0::DOUBLE, target - certain * source_size) AS "open" FROM c),
q AS (
  SELECT d.*, e.source_size, e.target, e.certain, e."open",
    least(greatest(CASE WHEN e.source_size > 0 THEN e."open" / e.source_size * least(greatest(size * source_docs / e.source_size, 0.5::DOUBLE), 2.0::DOUBLE) ELSE 0 END, 1e-9::DOUBLE), (1 - 1e-9)::DOUBLE) AS p,
    (('0x' || substr(md5('29:' || coalesce(id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.s),
r0 AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS q, false AS kept FROM q),
f1 AS (SELECT *, max("open") OVER w - sum(CASE WHEN kept THEN size ELSE 0 END) OVER w AS room FROM r0 WINDOW w AS (PARTITION BY source)),
r1 AS MATERIALIZED (
  SELECT * EXCLUDE (kept, room), kept OR (room > 0 AND size <= room AND
    sum(CASE WHEN NOT kept AND size <= room THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q, id, size ROWS UNBOUNDED PRECEDING) <= room) AS kept FROM f1),
f2 AS (SELECT *, max("open") OVER w - sum(CASE WHEN kept THEN size ELSE 0 END) OVER w AS room FROM r1 WINDOW w AS (PARTITION BY source)),
r2 AS MATERIALIZED (
  SELECT * EXCLUDE (kept, room), kept OR (room > 0 AND size <= room AND
    sum(CASE WHEN NOT kept AND size <= room THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q, id, size ROWS UNBOUNDED PRECEDING) <= room) AS kept FROM f2),
f3 AS (SELECT *, max("open") OVER w - sum(CASE WHEN kept THEN size ELSE 0 END) OVER w AS room FROM r2 WINDOW w AS (PARTITION BY source)),
r3 AS MATERIALIZED (
  SELECT * EXCLUDE (kept, room), kept OR (room > 0 AND size <= room AND
    sum(CASE WHEN NOT kept AND size <= room THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q, id, size ROWS UNBOUNDED PRECEDING) <= room) AS kept FROM f3),
g AS (SELECT source AS s, max("open") - sum(CASE WHEN kept THEN size ELSE 0 END) AS gap FROM r3 GROUP BY source),
x AS (
  SELECT source AS s, arg_min(id, struct_pack(a := abs(gap - size), b := q, c := id)) AS extra
  FROM r3 JOIN g ON r3.source IS NOT DISTINCT FROM g.s WHERE NOT kept AND abs(gap - size) < gap AND certain < 3 GROUP BY source)
SELECT id AS doc_id, size, source_size, target, size * (certain + CASE WHEN kept OR coalesce(id = extra, false) THEN 1 ELSE 0 END)::BIGINT AS taken,
  source, (certain + CASE WHEN kept OR coalesce(id = extra, false) THEN 1 ELSE 0 END)::INTEGER AS copies
FROM r3 LEFT JOIN x ON r3.source IS NOT DISTINCT FROM x.s
"""

MANIFEST_SQL = r"""
WITH RECURSIVE told AS (
  SELECT doc_id AS id, coalesce('=' || source, '') AS grp,
    coalesce(octet_length(encode(doc_id::VARCHAR))::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(octet_length(encode(source))::VARCHAR || ':' || source, '-')
      || coalesce(octet_length(encode(lang))::VARCHAR || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR))::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
    text,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) AS crc
  FROM documents),
leaf AS (
  SELECT id, grp, sha256(head || coalesce(octet_length(encode(text))::VARCHAR || ':' || text, '-')) AS leaf,
    sha256(head || CASE WHEN text IS NULL THEN '-' WHEN (xor(crc, 4294967295) & 1) = 0
      THEN octet_length(encode(replace(text, chr(10), '')))::VARCHAR || ':' || replace(text, chr(10), '') ELSE octet_length(encode(text))::VARCHAR || ':' || text END) AS now
  FROM told),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaf),
low AS (
  SELECT grp, 0 AS level, pos, n, leaf AS node FROM placed
  UNION ALL
  SELECT grp, level + 1, pos // 3, (n + 2) // 3, sha256(node || coalesce(second, '') || coalesce(third, '')) FROM (
    SELECT *, lead(node) OVER run AS second, lead(node, 2) OVER run AS third, row_number() OVER run AS slot FROM low WHERE n > 1
    WINDOW run AS (PARTITION BY grp, level, pos // 3 ORDER BY pos)) WHERE slot = 1),
subs AS (SELECT grp, node AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, pos, n, subroot AS node FROM subs
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(node || coalesce(second, '') || coalesce(third, '')) FROM (
    SELECT *, lead(node) OVER run AS second, lead(node, 2) OVER run AS third, row_number() OVER run AS slot FROM high WHERE n > 1
    WINDOW run AS (PARTITION BY level, pos // 3 ORDER BY pos)) WHERE slot = 1),
low_links AS (
  SELECT a.grp, a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS "left", coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS "right"
  FROM low a JOIN low b ON a.grp = b.grp AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
high_links AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS "left", coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS "right"
  FROM high a JOIN high b ON a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
steps AS (
  SELECT p.grp, p.pos, l.level, l."left", l."right" FROM placed p JOIN low_links l ON p.grp = l.grp AND l.pos = p.pos // power(3, l.level)::BIGINT
  UNION ALL
  SELECT p.grp, p.pos, 1000 + h.level, h."left", h."right" FROM placed p JOIN subs s USING (grp) JOIN high_links h ON h.pos = s.pos // power(3, h.level)::BIGINT),
paths AS (SELECT grp, pos, list({'l': "left", 'r': "right"} ORDER BY level) AS path FROM steps GROUP BY grp, pos),
done AS (
  SELECT p.id, p.leaf, s.subroot, (SELECT node FROM high WHERE n = 1) AS root, coalesce(q.path, []) AS path, p.now
  FROM placed p JOIN subs s USING (grp) LEFT JOIN paths q ON p.grp = q.grp AND p.pos = q.pos),
folded AS (
  SELECT *, list_reduce(list_prepend({'l': now, 'r': ''}, path), lambda a, x: {'l': sha256(x.l || a.l || x.r), 'r': ''}).l AS folded_root FROM done)
SELECT id AS doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256, folded_root,
  folded_root = root AS verified, len(path)::INTEGER AS levels
FROM folded
"""
