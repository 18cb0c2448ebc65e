"""DuckDB SQL of the operators that SQL can express, over whole texts."""

from __future__ import annotations

QUALITY_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g) x WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, unnest([0, 1, 2]) AS k FROM rep) x GROUP BY r),
ln AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT d.r, doc_id, source, CAST(len(ws) AS bigint) AS n_words, CAST(length(array_to_string(ws, '')) AS bigint) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS bigint) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS bigint) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS bigint) AS n_repeat_words, len(ls) AS n_lines
      FROM d JOIN w USING (r) JOIN ln USING (r) LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 10 * n_symbols > n_words AS f3,
        10 * n_dup_lines > 3 * n_lines AS f4, word_chars < 3 * n_words OR word_chars > 12 * n_words AS f5 FROM m),
u AS (SELECT source, rule, count(*) AS n, sum(CAST(bad AS int)) AS fails
      FROM (SELECT source, unnest(['1', '2', '3', '4', '5']) AS rule, unnest([f1, f2, f3, f4, f5]) AS bad FROM f WHERE source IS NOT NULL) x GROUP BY source, rule),
p AS (SELECT rule, sum(fails) / sum(n) AS mean, var_pop(fails / n) - (sum(fails) / sum(n)) * (1 - sum(fails) / sum(n)) * avg(1 / n) AS spread FROM u GROUP BY rule),
k AS (SELECT rule, mean, CASE WHEN spread > 0 THEN least(1e6, greatest(1.0, mean * (1 - mean) / spread - 1)) ELSE 1e6 END AS strength FROM p),
bad AS (SELECT DISTINCT source FROM u JOIN k USING (rule) WHERE (fails + mean * strength) / (n + strength) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
  NOT (f1 OR f2) AND coalesce(source NOT IN (SELECT source FROM bad), TRUE) AS kept FROM f"""

SUFFIX_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, p, hash(substr(h, 2 * p + 1, 400)) AS x FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM d)),
hit AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY x) AS c FROM w) y WHERE c > 1),
run AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS n
        FROM (SELECT r, p, CAST(coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p) > 200, TRUE) AS int) AS new FROM hit) y),
gone AS (SELECT r, min(p) AS s, max(p) + 200 AS e FROM run GROUP BY r, n),
part AS (SELECT r, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY s) AS a, s AS b FROM gone
         UNION ALL SELECT d.r, coalesce(max(e), 0), length(any_value(h)) // 2 FROM d LEFT JOIN gone USING (r) GROUP BY d.r),
kept AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM part JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS bigint) AS n_bytes, CAST((length(h) - length(k)) // 2 AS bigint) AS n_removed,
  CAST((SELECT count(*) FROM gone WHERE gone.r = d.r) AS bigint) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM d JOIN kept USING (r)"""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, o, p, hash(array_to_string(list_slice(ws, p, p + 49), ' ')) AS x FROM (SELECT r, o, ws, unnest(range(1, len(ws) - 48)) AS p FROM d)),
hit AS (SELECT r, p FROM (SELECT r, o, p, min(o) OVER (PARTITION BY x) AS least FROM w) y WHERE o > least),
word AS (SELECT r, i, ws[i] AS v FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
run AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS n
        FROM (SELECT r, p, CAST(coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p) > 50, TRUE) AS int) AS new FROM hit) y),
gone AS (SELECT r, min(p) AS s, max(p) + 50 AS e FROM run GROUP BY r, n),
stay AS (SELECT word.r, i, v FROM word WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = word.r AND i >= s AND i < e)),
kept AS (SELECT r, count(*) AS c, string_agg(v, ' ' ORDER BY i) AS k FROM stay GROUP BY r)
SELECT doc_id, CAST(len(ws) AS bigint) AS n_words, CAST(len(ws) - coalesce(c, 0) AS bigint) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""

LEXICAL_SEARCH = r"""
WITH small AS (SELECT row_number() OVER () AS r, doc_id,
                 translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM small),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM w GROUP BY r, doc_id, term),
len AS (SELECT r, CAST(sum(tf) AS bigint) AS n FROM tf GROUP BY r),
tot AS (SELECT count(*) AS big_n, CAST(sum(n) AS bigint) AS big_l FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wt AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS double) / (2 * df + 1))) AS bigint) AS w FROM df, tot),
q AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark) b),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS bigint) AS score
      FROM q JOIN tf USING (term) JOIN wt USING (term) JOIN len USING (r), tot GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(rank AS int) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0) x WHERE rank <= 50
"""
