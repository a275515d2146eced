"""DuckDB twins of the run detection and the conversation repair queries."""

from __future__ import annotations

SPACE = r"\x20\x09-\x0D"

#: crc32 (reflected polynomial 0xEDB88320) by a table that SQL derives from the polynomial.
SQL_CRC_TABLE = """crc_tab AS (SELECT list(list_reduce([n] || range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))
                               ORDER BY n) AS tab FROM (SELECT unnest(range(256)) AS n) x)"""


def sql_crc32(ascii_text: str) -> str:
    """crc32 of a short ASCII expression; ``crc_tab`` has to be in the FROM list."""
    steps = f"[4294967295::BIGINT] || list_transform(string_split({ascii_text}, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(list_reduce({steps}, lambda a, b: xor(a >> 8, crc_tab.tab[(xor(a, b) & 255) + 1])), 4294967295)"


SQL_OP11 = f"""
WITH {SQL_CRC_TABLE},
src AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS w,
               coalesce({sql_crc32("CAST(doc_id AS VARCHAR)")}, 1) AS h FROM documents, crc_tab),
par AS (SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS hit, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS k FROM src),
txt AS (SELECT r, doc_id, n, CASE WHEN hit THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // k) ELSE i END])
                               ELSE w END AS w FROM par),
wd AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS w FROM txt),
eq AS (SELECT x.r, y.i - x.i AS q, x.i FROM wd x JOIN wd y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isl AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM eq),
str AS (SELECT r, q, min(i) AS s, count(*) + q AS len FROM isl GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT r, s, len, min(q) AS q FROM str GROUP BY r, s, len),
top AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(len AS DOUBLE) / q DESC, s, q) = 1),
told AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY r),
cut AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT wd.r, string_agg(wd.w, ' ' ORDER BY wd.i) AS t FROM wd ANTI JOIN cut ON wd.r = cut.r AND wd.i = cut.i GROUP BY wd.r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(top.s AS BIGINT) AS start, CAST(top.len AS BIGINT) AS length, CAST(top.q AS BIGINT) AS period,
       CAST(1000 * top.len // top.q AS BIGINT) AS exponent_milli, sha256(coalesce(told.lines, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM txt LEFT JOIN told USING (r) LEFT JOIN top USING (r) LEFT JOIN kept USING (r)"""

SQL_OP12 = rf"""
WITH RECURSIVE {SQL_CRC_TABLE},
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {sql_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations, crc_tab),
dmg AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
               CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM src WHERE f <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
               regexp_extract(text, '([^{SPACE}])[{SPACE}]*$', 1) AS last FROM dmg),
flt AS (SELECT *, last = '' AS blank, last <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
               substr(role, 1, 1) AS c, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM num),
stp AS (SELECT *, NOT blank AND NOT dup AND last NOT IN ('.', '!', '?') AS trunc FROM flt),
ins(s, k, s2, e, added) AS (VALUES (0, 0, 0, '', CAST([] AS VARCHAR[])), (0, 1, 2, 'I', ['user:']), (0, 2, 3, 'II', ['user:', 'assistant:']),
  (1, 0, 1, '', CAST([] AS VARCHAR[])), (1, 1, 2, 'I', ['user:']), (1, 2, 3, 'II', ['user:', 'assistant:']),
  (2, 0, 2, '', CAST([] AS VARCHAR[])), (2, 1, 3, 'I', ['assistant:']), (2, 2, 2, 'II', ['assistant:', 'user:']),
  (3, 0, 3, '', CAST([] AS VARCHAR[])), (3, 1, 2, 'I', ['user:']), (3, 2, 3, 'II', ['user:', 'assistant:'])),
ops(op) AS (VALUES ('D'), ('K'), ('R')),
ways AS (SELECT stp.*, ins.s, ins.k, ins.e || ops.op AS ed, ins.added, ops.op,
                CASE op WHEN 'D' THEN s2 WHEN 'R' THEN CASE WHEN s2 = 2 THEN 3 ELSE 2 END
                  ELSE CASE WHEN c = 's' AND s2 = 0 THEN 1 WHEN c = 'u' AND s2 <> 2 THEN 2 WHEN c = 'a' AND s2 = 2 THEN 3 END END AS dest,
                3 * k + CASE op WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN trunc AND op <> 'D' THEN 3 ELSE 0 END AS price,
                CASE op WHEN 'D' THEN added WHEN 'R' THEN added || [CASE WHEN s2 = 2 THEN 'assistant:' ELSE 'user:' END || text]
                  ELSE added || [role || ':' || text] END AS lines
         FROM stp, ins, ops WHERE op = 'D' OR NOT (blank OR dup)),
best AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS done FROM conversations
         UNION ALL
         SELECT conv_id, i, dest, cost, audit, done FROM (
           SELECT b.conv_id, w.i, w.dest, b.cost + w.price AS cost, b.audit || w.ed AS audit, b.done || w.lines AS done,
                  row_number() OVER (PARTITION BY b.conv_id, w.dest ORDER BY b.cost + w.price, b.audit || w.ed) AS rn
           FROM best b JOIN ways w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.i = b.i + 1 AND w.s = b.s WHERE w.dest IS NOT NULL) x WHERE rn = 1),
ends AS (SELECT b.conv_id, b.cost + 3 * k AS cost, b.audit || e AS audit, b.done || added AS done,
                row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + 3 * k, b.audit || e) AS rn
         FROM best b JOIN ins ON ins.s = b.s AND ins.s2 IN (0, 3)
         LEFT JOIN (SELECT conv_id, max(i) AS m FROM stp GROUP BY conv_id) z ON z.conv_id IS NOT DISTINCT FROM b.conv_id WHERE b.i = coalesce(z.m, 0)),
stat AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate,
                count_if(trunc) AS truncated, count_if(before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM stp GROUP BY conv_id)
SELECT ends.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
       sha256(array_to_string(done, chr(10))) AS repaired_sha256
FROM ends LEFT JOIN stat ON stat.conv_id IS NOT DISTINCT FROM ends.conv_id WHERE rn = 1"""
