"""DuckDB SQL for the contract queries that SQL can express on whole tables."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

_WORDS_1 = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL["op1_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS_1}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS_1} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS i FROM b WHERE len(w) > 0)
),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)
),
hits AS (SELECT doc_id, item_id, i, bw.k AS k FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLE_SQL["op7_mix"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE (rk - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
-- clamp and redistribute, round by round, until no open source is above its cap
fill AS (
  SELECT 0 AS round, source, weight, cap, false AS clamped, (SELECT sum(size) * 1.5::DOUBLE FROM d) / (SELECT sum(weight) FROM w) AS level FROM w
  UNION ALL
  SELECT round + 1, source, weight, cap, clamped OR cap <= weight * level,
         greatest((SELECT sum(size) * 1.5::DOUBLE FROM d) - sum(CASE WHEN clamped OR cap <= weight * level THEN cap ELSE 0 END) OVER (), 0)
           / nullif(sum(CASE WHEN clamped OR cap <= weight * level THEN 0 ELSE weight END) OVER (), 0)
  FROM fill WHERE round < 40
),
t AS (
  SELECT w.source, w.source_size, CASE WHEN f.clamped OR f.level IS NULL THEN f.cap ELSE least(f.cap, f.weight * f.level) END AS target
  FROM fill f JOIN w ON w.source IS NOT DISTINCT FROM f.source WHERE round = 40
),
o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS run
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN size > 0 AND run - size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL["op11_search"] = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
q AS (SELECT item_id, t, CAST(count(*) AS BIGINT) AS c FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
p AS (
  SELECT doc_id, t, n, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t, n
),
f AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
s AS (
  SELECT item_id, doc_id, CAST(sum(q.c * f.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l)))) AS BIGINT) AS score
  FROM p JOIN q USING (t) JOIN f USING (t), c GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
