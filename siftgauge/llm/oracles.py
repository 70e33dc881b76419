"""DuckDB SQL for the queries whose rows it can express."""

from __future__ import annotations

from . import op2_quality as quality

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(value: str) -> str:
    """A string as an SQL expression, control characters by their codes."""
    parts = [f"chr({ord(c)})" if c < " " else "'" + c.replace("'", "''") + "'" for c in value]
    return "(" + " || ".join(parts) + ")"


_SPACE_WORDS = r"'[^\x20\x09-\x0D]+'"

#: Windows of 200 bytes by a 64-bit hash of their digits; runs of repeated ones are islands of starts at most 200 apart.
OP1 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT rid, 500 * j AS base, substr(h, 1000 * j + 1, 1398) AS h FROM (SELECT rid, h, unnest(generate_series(0, (len(h) // 2 - 200) // 500)) AS j FROM d WHERE len(h) >= 400) x),
w AS (SELECT rid, base + k AS k, hash(substr(h, 2 * k - 1, 400)) AS v FROM (SELECT rid, base, h, unnest(generate_series(1, len(h) // 2 - 199)) AS k FROM p) x),
hot AS (SELECT v FROM w GROUP BY v HAVING count(*) > 1),
s AS (SELECT rid, k FROM w WHERE v IN (SELECT v FROM hot)),
m AS (SELECT rid, k, CASE WHEN k - lag(k) OVER (PARTITION BY rid ORDER BY k) <= 200 THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT rid, k, sum(fresh) OVER (PARTITION BY rid ORDER BY k) AS island FROM m),
r AS (SELECT rid, min(k) AS a, max(k) + 199 AS b FROM i GROUP BY rid, island),
e AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM r),
g AS (SELECT d.rid, count(*) AS n_spans, sum(b - a + 1) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM e JOIN d ON e.rid = d.rid GROUP BY d.rid)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN g ON d.rid = g.rid
"""


def _count(chars: str) -> str:
    return f"length(t) - length(translate(t, {_text(chars)}, ''))"


def _vote(part: str, whole: str, low: float, good_from: float | None, good_to: float | None, high: float) -> str:
    share = f"{part} / CAST({whole} AS DOUBLE)"
    good = "" if good_from is None else f" WHEN {share} >= {good_from} AND {share} <= {good_to} THEN 1"
    return f"CASE WHEN {whole} = 0 THEN 0 WHEN {share} < {low} OR {share} > {high} THEN -1{good} ELSE 0 END"


_M = len(quality.RULES)
_odds = lambda v, s: f"(1 / (1 + exp(-(ln({s}.prior / (1 - {s}.prior)) + list_sum(list_transform(range(1, {_M + 1}), lambda j: {v}[j] * ln({s}.acc[j] / (1 - {s}.acc[j]))))))))"
_clamp = lambda x, a, b: f"least({b}, greatest({a}, {x}))"
OP2 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT rid, doc_id, regexp_extract_all(t, {_SPACE_WORDS}) AS w, length(translate(t, {_text(quality.SPACE)}, '')) AS word_chars, {_count(quality.SYMBOLS)} AS n_symbols,
  len(regexp_extract_all(t, '[#*$%&|<>]+')) AS n_symbol_runs, {_count(quality.ODD)} AS n_odd, len(regexp_extract_all(t, '[.!?]+[\\x20\\x09-\\x0D"]|[.!?]$')) AS n_ends, {_count(quality.UPPER)} AS n_upper,
  list_filter(string_split(t, chr(10)), lambda x: translate(x, {_text(quality.SPACE)}, '') <> '') AS lines FROM d),
g AS (SELECT rid, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS v FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS k FROM c) x),
z AS (SELECT rid, v FROM g GROUP BY rid, v HAVING count(*) > 1),
p AS (SELECT rid, count(DISTINCT k + j) AS n FROM (SELECT g.rid, g.k, unnest([0, 1, 2]) AS j FROM g JOIN z ON g.rid = z.rid AND g.v = z.v) y GROUP BY rid),
q AS (SELECT c.*, len(w) AS n_words, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words FROM c LEFT JOIN p ON c.rid = p.rid),
v AS (SELECT rid, [{', '.join(_vote(*r[1:]) for r in quality.RULES)}] AS v FROM q),
l AS (SELECT list({{'v': v, 'n': n}}) AS p FROM (SELECT v, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY v) x),
s AS (SELECT 0 AS i, CAST({quality.START_PRIOR} AS DOUBLE) AS prior, [{', '.join([f'CAST({quality.START_RIGHT} AS DOUBLE)'] * _M)}] AS acc
  UNION ALL SELECT i + 1, {_clamp(f"(list_sum(list_transform(p, lambda x, k: x.n * post[k])) + {quality.PSEUDO}) / (list_sum(list_transform(p, lambda x: x.n)) + {2 * quality.PSEUDO})", quality.LEAST_PRIOR, quality.MOST_PRIOR)},
  list_transform(range(1, {_M + 1}), lambda j: {_clamp(f"(list_sum(list_transform(p, lambda x, k: x.n * CASE x.v[j] WHEN 1 THEN post[k] WHEN -1 THEN 1 - post[k] ELSE 0 END)) + {quality.PSEUDO}) / (list_sum(list_transform(p, lambda x: CASE WHEN x.v[j] <> 0 THEN x.n ELSE 0 END)) + {2 * quality.PSEUDO})", quality.LEAST_RIGHT, quality.MOST_RIGHT)})
  FROM (SELECT s.i, l.p, list_transform(l.p, lambda y: {_odds('y.v', 's')}) AS post FROM s CROSS JOIN l WHERE s.i < {quality.STEPS}) u)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {_odds('v.v', 's')} >= 0.5 AS kept
FROM q JOIN v ON q.rid = v.rid CROSS JOIN (SELECT * FROM s WHERE i = {quality.STEPS}) s
"""

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGIT = lambda k: f"(strpos('0123456789abcdef', substr(x, {k}, 1)) - 1)"
#: Five hexadecimal digits are four of base 32.
_FIVE = "(" + " + ".join(f"{_DIGIT(f'5 * i + {k}')} * {16 ** (5 - k)}" for k in range(1, 6)) + ")"
OP3 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
f AS (SELECT x, min(page_id) AS first FROM s GROUP BY x)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([32768, 1024, 32, 1], lambda m: substr('{_B32}', CAST(({_FIVE} // m) % 32 AS INT) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first OR page_id IS NULL THEN first END AS refers_to
FROM s JOIN f USING (x)
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_SPACE_WORDS}) AS w FROM documents),
g AS (SELECT DISTINCT rid, array_to_string(w[k : k + 3], ' ') AS v FROM (SELECT rid, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS k FROM d WHERE len(w) > 0) x),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
o AS (SELECT a.rid AS a, b.rid AS b, count(*) AS inter FROM g a JOIN g b ON a.v = b.v AND a.rid < b.rid GROUP BY a.rid, b.rid),
e AS (SELECT a, b FROM o JOIN n x ON o.a = x.rid JOIN n y ON o.b = y.rid WHERE 100 * inter >= 85 * (x.n + y.n - inter)),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, t.b FROM r JOIN t ON r.b = t.a),
c AS (SELECT r.a AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON r.b = d.rid GROUP BY r.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d JOIN c ON d.rid = c.rid LEFT JOIN n ON d.rid = n.rid
"""

_ALNUM_WORDS = r"'[0-9a-z\x{80}-\x{10FFFF}]+'"
_LOWERED = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), '{_UPPER}', '{_LOWER}'), {_ALNUM_WORDS})"
OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_LOWERED('text')} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_LOWERED('text')} AS w FROM benchmark WHERE item_id IS NOT NULL) x WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS v FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS k FROM b) x),
g AS (SELECT rid, k, n, array_to_string(w[k : k + n - 1], ' ') AS v FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM i) m WHERE len(w) >= n) x),
m AS (SELECT g.rid, g.k, g.n, i.item_id FROM g JOIN i ON g.n = i.n AND g.v = i.v),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(k, k + n - 1)) AS p FROM (SELECT DISTINCT rid, k, n FROM m) y) x GROUP BY rid),
t AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM m GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.rid = h.rid LEFT JOIN t ON d.rid = t.rid
"""

ORACLES = {"op1_suffix_dedup": OP1, "op2_quality_rules": OP2, "op3_warc_zip": OP3, "op6_jaccard_join": OP6, "op10_decontaminate": OP10}
