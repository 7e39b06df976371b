"""The operators' results in DuckDB's SQL, where SQL can say them."""

from __future__ import annotations

from kvstrata.llm import near_dup, quality

_SPACE = quality._SPACE
_quoted = lambda s: "'" + s.replace("'", "''").replace("\\u00df", "ß").replace("\\u00ff", "ÿ") + "'"
_count = lambda text, pattern: f"len(regexp_extract_all({text}, {_quoted(pattern)}))"
_bare = lambda text, pattern: f"length(regexp_replace({text}, {_quoted(pattern)}, '', 'g'))"
_matches = lambda text, pattern: f"regexp_matches({text}, {_quoted(pattern)})"

_FAILS = f"""(({_bare('x', quality._SYMBOLS)} > 3 AND {_bare('x', quality._SYMBOLS)} > {quality.MAX_LINE_SYMBOLS}::DOUBLE * {_bare('x', _SPACE)})
  OR {_matches('x', quality._CUT_OFF)}
  OR ({_count('x', quality._SEPARATORS)} >= 2 AND {_count('trim(x)', _SPACE)} + 1 <= 4 * ({_count('x', quality._SEPARATORS)} + 1) - 1)
  OR {_matches('lower(x)', quality._MENU_LINE)} OR {_matches('lower(x)', quality._PHRASES)})"""

QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, list_filter(string_split_regex(text, {_quoted(_SPACE)}), lambda w: w <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
w AS (SELECT row, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM s),
g AS (SELECT row, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS gram FROM w WINDOW o AS (PARTITION BY row ORDER BY i)),
again AS (SELECT row, i FROM g WHERE gram IS NOT NULL QUALIFY count(*) OVER (PARTITION BY row, gram) > 1),
r AS (SELECT row, count(DISTINCT i + k.range) AS n FROM again, range(3) k GROUP BY row),
c AS (SELECT row, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT {_FAILS}), chr(10)) AS cleaned FROM d),
m AS (SELECT s.row, doc_id, len(words) AS n_words, {_bare('text', _SPACE)} AS word_chars, {_bare('text', '[^#*$%&|<>]+')} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, {_bare('cleaned', _SPACE)} AS rest
  FROM s JOIN c USING (row) LEFT JOIN r USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed,
  NOT base_failed AND word_chars - rest <= {quality.MAX_LOST}::DOUBLE * word_chars AS kept FROM m"""

#: White space as Python splits words.
_BLANK = r"[\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
NEAR_DUPLICATES = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY text),
w AS (SELECT id, list_filter(string_split_regex(text, '{_BLANK}'), lambda w: w <> '') AS w FROM t),
s AS (SELECT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {near_dup.WORDS} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {near_dup.WORDS - 2}), lambda i: array_to_string(w[i:i + {near_dup.WORDS - 1}], ' ')) END) AS g FROM w),
x AS MATERIALIZED (SELECT id, g, count(*)::DOUBLE AS n FROM s GROUP BY ALL),
total AS (SELECT id, sum(n) AS n FROM x GROUP BY id),
shared AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.n AS x, b.n AS y, b.n / a.n AS r FROM x a JOIN x b ON a.g = b.g AND a.id < b.id),
near AS (SELECT a, b, ta.n - sum(x) AS rest_x, tb.n - sum(y) AS rest_y FROM shared JOIN total ta ON ta.id = a JOIN total tb ON tb.id = b GROUP BY a, b, ta.n, tb.n HAVING sum(least(x / ta.n, y / tb.n)) >= {near_dup.SIMILARITY} - 1e-9),
ratios AS (SELECT a, b, r, sum(x) AS x FROM shared JOIN near USING (a, b) GROUP BY ALL),
wholes AS (SELECT q.a, q.b, q.r, any_value(q.x) AS x, any_value(near.rest_x + near.rest_y / q.r) + sum(greatest(s.x, s.y / q.r)) AS whole FROM ratios q JOIN near USING (a, b) JOIN shared s ON s.a = q.a AND s.b = q.b GROUP BY q.a, q.b, q.r),
links AS MATERIALIZED (SELECT a, b FROM wholes GROUP BY a, b HAVING sum(x / whole) >= {near_dup.SIMILARITY}),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(id, c) AS (SELECT id, id FROM t UNION SELECT both_ways.b, reached.c FROM reached JOIN both_ways ON both_ways.a = reached.id),
classes AS (SELECT id, min(c) AS c FROM reached GROUP BY id)
SELECT doc_id, coalesce(c, doc_id) AS class_id FROM documents LEFT JOIN t USING (text) LEFT JOIN classes USING (id)"""

#: The pages of the test tables have their text in the headings and paragraphs of one article.
PAGES = r"""WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '</?(?:p|h1)>') AS parts FROM pages),
p AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS parts FROM a),
u AS (SELECT page_id, url, list_transform(parts, lambda x: replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&')) AS parts FROM p),
c AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '[\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM u)
SELECT page_id, url, text, length(text) AS n_chars FROM c"""

SHARD_LAWS = "SELECT count(*) AS n_rows, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS n_bytes, 8::BIGINT AS shards, true AS gapless, true AS balanced FROM documents"
PACKING_LAWS = "SELECT count(*) AS documents, true AS whole, true AS within FROM documents"

#: The nearest by inner product, of all vectors; scores are rounded, as sums may differ in their last bits.
SEARCH = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
ok AS (SELECT * FROM v WHERE len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS s FROM ok q JOIN ok c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x))
SELECT query_id, CAST(row_number() OVER o AS INTEGER) AS rank, vec_id, round(s, 6) AS score FROM p WINDOW o AS (PARTITION BY query_id ORDER BY s DESC, vec_id) QUALIFY rank <= 20"""

#: Kinds of personal data by their plain patterns, each with its check of a match ``m``.
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(generate_series(1, length({_DIGITS})), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({_DIGITS}), i, 1)::INT ELSE 2 * substr(reverse({_DIGITS}), i, 1)::INT - CASE WHEN substr(reverse({_DIGITS}), i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: p::HUGEINT > 255)) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN length({_DIGITS}) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
}
_MATCHES = " UNION ALL ".join(
    f"SELECT row, {k} AS k, unnest(gaps) AS gap, unnest(list_concat(found, [NULL])) AS m, generate_subscripts(gaps, 1) AS i FROM (SELECT row, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS found FROM d)"
    for k, (p, _) in enumerate(_PLAIN.values())
)
_CHECK = "CASE k " + " ".join(f"WHEN {k} THEN {check}" for k, (_, check) in enumerate(_PLAIN.values())) + " END"
PII_BASE = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT *, sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY row, k ORDER BY i) AS upto FROM ({_MATCHES})),
s AS (SELECT row, k, CAST(upto - length(m) AS BIGINT) AS a, CAST(upto AS BIGINT) AS b FROM p WHERE m IS NOT NULL AND {_CHECK}),
g AS (SELECT row, {", ".join(f"count(*) FILTER (k = {k}) AS n_{name}" for k, name in enumerate(_PLAIN))}, string_agg([{", ".join(f"'{name}'" for name in _PLAIN)}][k + 1] || ':' || a || ':' || b, ',' ORDER BY k, a) AS spans FROM s GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name in _PLAIN)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (row)"""

ROUND_TRIP = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"
