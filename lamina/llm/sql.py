"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from lamina.llm import mixing
from lamina.llm import quality_rules as qr

#: Words of a text, in DuckDB: the text is split on the same white space, empty parts dropped.
WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))"


def quality_rules_sql() -> str:
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in qr._any_case(qr.STOP_WORDS))
    rules = " OR ".join(r.failed_sql() for r in qr.RULES)
    return f"""
WITH parts AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, {WORDS} AS w, {LINES} AS l FROM documents),
windows AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM parts),
keyed AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows),
covered AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM keyed WHERE n > 1) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bangs,
    len(list_filter(w, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
    len(l)::BIGINT AS n_lines,
    len(list_filter(l, lambda x: starts_with(x, '-') OR starts_with(x, '*') OR starts_with(x, '•')))::BIGINT AS n_bullet_lines,
    len(list_filter(l, lambda x: ends_with(x, '...') OR ends_with(x, '…')))::BIGINT AS n_ellipsis_lines
  FROM parts LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < {qr.MIN_WORDS} OR n_repeat_words * 100 > n_words * {qr.MAX_REPEAT_PCT} AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({rules}) AS kept, n_bangs, n_stop_words, n_lines, n_bullet_lines, n_ellipsis_lines
FROM b"""


LINE_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS k, doc_id, text FROM documents),
lines AS (SELECT r, k, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT r, k, string_split(text, chr(10)) AS x FROM d WHERE length(text) > 0)),
marked AS (SELECT *, sum(CASE WHEN regexp_matches(line, '[^\x20\x09-\x0D]') THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS u0 FROM lines),
units AS (SELECT r, k, dense_rank() OVER (PARTITION BY r ORDER BY u0) - 1 AS u, string_agg(line, chr(10) ORDER BY i) AS t FROM marked GROUP BY r, k, u0),
keyed AS (SELECT r, k, u, t, trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS g FROM units),
trio AS (SELECT r, k, u, g, lead(g) OVER w AS g2, lead(g, 2) OVER w AS g3, lead(u, 2) OVER w AS has FROM keyed WINDOW w AS (PARTITION BY r ORDER BY u)),
occ AS (SELECT r, k, u, min(k) OVER p AS owner, count(*) OVER p AS n, row_number() OVER (PARTITION BY r, g, g2, g3 ORDER BY u) AS nth
        FROM trio WHERE has IS NOT NULL WINDOW p AS (PARTITION BY g, g2, g3)),
cut AS (SELECT DISTINCT r, unnest([u, u + 1, u + 2]) AS u FROM occ WHERE n > 1 AND (k <> owner OR nth > 1)),
kept AS (SELECT units.r, count(*) AS n_units, count(cut.u) AS n_removed, string_agg(CASE WHEN cut.u IS NULL THEN units.t END, chr(10) ORDER BY units.u) AS t
         FROM units LEFT JOIN cut ON units.r = cut.r AND units.u = cut.u GROUP BY units.r)
SELECT d.doc_id, CASE WHEN n_removed > 0 THEN coalesce(t, '') ELSE d.text END AS text, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM d LEFT JOIN kept USING (r)"""


def mixing_sql() -> str:
    """Rows equal in source, size and doc_id are ordered by a hash that SQL lacks; it plays no part where doc_ids differ."""
    rate = f"CASE WHEN source_size - seen > 0 THEN least(greatest((target - taken) / (source_size - seen), 0.0::DOUBLE), {mixing.MAX_COPIES}.0::DOUBLE) ELSE plain END"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w::DOUBLE, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(w) OVER (ORDER BY source_size / w::DOUBLE, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM w),
c AS (SELECT *, 3 * source_size * rest_w <= (total - before) * w AS capped FROM o),
f AS (SELECT *, total - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER () AS free, sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS free_w FROM c),
g AS (SELECT sid, source, source_size::BIGINT AS source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (w * free)::DOUBLE / free_w::DOUBLE END AS target,
        ('0x' || substr(md5('{mixing.SEED}:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM f),
t AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS plain FROM g),
k AS (SELECT doc_id, size, t.*, row_number() OVER (PARTITION BY sid ORDER BY size DESC, doc_id ASC NULLS LAST) - 1 AS k, size * {mixing.LARGE} > source_size AS large
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT sid, source_size, target, plain, u, (-1)::BIGINT AS k, 0.0::DOUBLE AS p, 0::BIGINT AS copies, 0::BIGINT AS taken, 0::BIGINT AS seen FROM t
  UNION ALL SELECT sid, source_size, target, plain, u, k, p + r, n, taken + n * size, seen + size FROM
    (SELECT *, (floor(p + r + u) - floor(p + u))::BIGINT AS n FROM (SELECT e.* EXCLUDE (k), x.k, x.size, {rate} AS r FROM e JOIN (SELECT sid, k, size FROM k WHERE large) x ON x.sid = e.sid AND x.k = e.k + 1))),
l AS (SELECT sid, max(k) + 1 AS n_large, max(p) AS p, arg_max({rate}, k) AS rate FROM e GROUP BY sid)
SELECT k.doc_id, k.size, k.source_size, k.target,
  (CASE WHEN k.large THEN e.copies ELSE floor(l.p + (k.k - n_large + 1)::DOUBLE * rate + k.u) - floor(l.p + (k.k - n_large)::DOUBLE * rate + k.u) END * k.size)::BIGINT AS taken
FROM k JOIN l ON k.sid = l.sid LEFT JOIN e ON e.sid = k.sid AND e.k = k.k"""
