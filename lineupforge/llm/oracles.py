"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

BLANK = r"[\x20\x09-\x0D]+"
LIST = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}'), lambda x: x <> '')"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {LIST} AS w FROM documents),
grams AS (SELECT r, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{BLANK}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words FROM d JOIN lines USING (r) LEFT JOIN covered USING (r)),
f AS (SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeated, 100 * n_symbols > 10 * word_chars AS symbols, 100 * n_dup_lines > 30 * n_lines AS dup FROM m),
h AS (SELECT source, count(*) AS n, unnest([count(*) FILTER (short), count(*) FILTER (repeated), count(*) FILTER (symbols), count(*) FILTER (dup)]) AS k, unnest([1, 2, 3, 4]) AS rule FROM f GROUP BY source),
prior AS (SELECT rule, sum(k) / sum(n) AS mean, var_pop(k / n) AS v FROM h GROUP BY rule),
weighed AS (SELECT rule, mean, CASE WHEN v > 0 THEN least(1000.0, greatest(1.0, mean * (1 - mean) / v - 1)) ELSE 1000.0 END AS weight FROM prior),
verdict AS (SELECT source, bool_or((k + mean * weight) / (n + weight) > 0.5) AS failed FROM h JOIN weighed USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeated AS base_failed, NOT (short OR repeated) AND NOT failed AS kept
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source"""

SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {LIST} AS w FROM documents),
runs AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM runs) WHERE n > 1),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM twice)),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)"""

# Lengths of what the template puts before and after a turn, by role, and of what it puts around any other role.
MARKS = "CASE role WHEN 'system' THEN 9 + 11 WHEN 'user' THEN 10 + 12 WHEN 'assistant' THEN 9 + 11 ELSE 10 + {0} + 9 + 12 END"
ESCAPED = r"length({0}) + length({0}) - length(replace({0}, '\', '')) + len(regexp_extract_all({0}, '<s>|</s>|\[INST\]|\[/INST\]|\[SYS\]|\[/SYS\]|\[OUT\]|\[/OUT\]|\[ROLE\]|\[/ROLE\]|\[/TEXT\]'))"
CHAT = f"""
WITH said AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM said)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum({MARKS.format('(' + ESCAPED.format('role') + ')')} + {ESCAPED.format('text')}) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id, alone"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {LIST.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, way.b FROM reach JOIN way ON reach.b = way.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
cells AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(term) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
groups AS (SELECT lang, source, any_value(v) AS v, coalesce(sum(cells.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) JOIN langs USING (lang) LEFT JOIN cells USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(cells.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(cells.n, 0) + 1)) // (total + v)::HUGEINT AS p
  FROM groups JOIN (SELECT lang, term FROM kept) USING (lang) LEFT JOIN cells USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v)::HUGEINT AS q FROM kept JOIN langs USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""

# crc32 bit by bit: a byte is mixed in, then eight times shifted. State after a row: the least (cost, audit) that ends before
# any turn kept (q0), after a system turn (q1), after a user's (q2), after an assistant's (q3), as text that sorts so.
_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: ('0x' || h)::UBIGINT)), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::UBIGINT for _ in range(8)]), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)"
_ADD = "lpad(CAST(CAST({0}[:12] AS BIGINT) + {1} AS VARCHAR), 12, '0') || {0}[13:] || '{2}'"
_KEEP = lambda q, kind: f"CASE WHEN NOT gone AND kind = '{kind}' THEN {_ADD.format(q, 'more', 'K')} END"
_TURN = lambda q: f"CASE WHEN NOT gone THEN {_ADD.format(q, '3 + more', 'R')} END"
_DROP = lambda q: _ADD.format(q, "4", "D")
# one insert each way: after a row's edits, a user's or an assistant's turn may be put in; twice, for both
_PUT = "q0, q1, least(q2, {0}, {1}, {2}) AS q2, least(q3, {3}) AS q3".format(_ADD.format("q0", "3", "I"), _ADD.format("q1", "3", "I"), _ADD.format("q3", "3", "I"), _ADD.format("q2", "3", "I"))
REPAIR = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM c),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM damaged),
marked AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  role[:1] AS kind, lag(role[:1]) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM numbered),
r AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS k, *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM marked),
chart AS (SELECT k, 0::BIGINT AS i, '000000000000' AS q0, '999999000000' AS q1, '000000000003I' AS q2, '000000000006II' AS q3 FROM (SELECT DISTINCT k FROM r)
  UNION ALL SELECT k, i, {_PUT} FROM (SELECT k, i, {_PUT} FROM (
    SELECT r.k, r.i, {_DROP("q0")} AS q0, least({_DROP("q1")}, {_KEEP("q0", "s")}) AS q1,
      least({_DROP("q2")}, {", ".join(f(q) for q in ("q0", "q1", "q3") for f in (lambda q: _KEEP(q, "u"), _TURN))}) AS q2,
      least({_DROP("q3")}, {_KEEP("q2", "a")}, {_TURN("q2")}) AS q3
    FROM chart JOIN r ON r.k = chart.k AND r.i = chart.i + 1))),
done AS (SELECT k, least(q0, q3) AS best FROM chart JOIN (SELECT k, max(i) AS i FROM r GROUP BY k) USING (k, i)),
edits AS (SELECT k, best[13:] AS audit, unnest(range(1, length(best) - 11)) AS pos FROM done),
placed AS (SELECT k, pos, audit[pos] AS edit, sum(CASE WHEN audit[pos] <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY pos) AS i, sum(CASE WHEN audit[pos] <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY pos) AS place FROM edits),
turns AS (SELECT placed.k, pos, edit, place, CASE WHEN edit = 'K' THEN role END AS role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, coalesce(max(CASE WHEN edit = 'K' AND kind = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY placed.k), 0) AS system
  FROM placed LEFT JOIN r ON r.k = placed.k AND r.i = placed.i AND edit <> 'I' WHERE edit <> 'D'),
fixed AS (SELECT k, string_agg(coalesce(role, CASE WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY pos) AS t FROM turns GROUP BY k),
told AS (SELECT k, any_value(conv_id) AS conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (earlier || kind NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY k)
SELECT all_ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(best[:12] AS BIGINT), 0) AS cost, coalesce(best[13:], '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) all_ids LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM all_ids.conv_id LEFT JOIN done USING (k) LEFT JOIN fixed USING (k)"""

# All token sets of the labelled URLs are counted (URLs of the given tables have eight tokens at most), as FP-growth would.
_AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')"
URLS = rf"""
WITH u AS (SELECT page_id, {_AZ.format("coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT *, CASE WHEN {_FITS.format("example.com", "de/")} THEN 'example.com/de/' WHEN {_FITS.format("example.net", "en/")} THEN 'example.net/en/' WHEN {_FITS.format("org", "fr/")} THEN 'org/fr/' WHEN {_FITS.format("net", "")} THEN 'net/' END AS rule,
  list_sort(list_distinct(list_concat(list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || regexp_replace(x, '[0-9]+', '#', 'g')),
    list_transform(list_filter(regexp_split_to_array({_AZ.format("path")}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '#', 'g'))))) AS t FROM u),
k AS (SELECT *, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow' END AS label FROM l),
sets AS (SELECT list_filter(t, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS a, label FROM (SELECT t, label, unnest(range(1, 1::BIGINT << len(t))) AS mask FROM k WHERE label IS NOT NULL)),
counts AS (SELECT a, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY a) AS total FROM sets GROUP BY a, label),
mined AS (SELECT a, label, n, n::DOUBLE / total AS c FROM counts WHERE n >= greatest(3, ceil(0.002 * (SELECT count(*) FROM k WHERE label IS NOT NULL))) AND n::DOUBLE / total >= 0.9),
kept AS (SELECT * FROM mined m WHERE NOT EXISTS (SELECT 1 FROM mined s WHERE s.label = m.label AND len(s.a) < len(m.a) AND s.c >= m.c AND list_has_all(m.a, s.a))),
best AS (SELECT t, first(kept.label ORDER BY c DESC, n DESC, len(a), a, kept.label) AS verdict FROM (SELECT DISTINCT t FROM k WHERE label IS NULL) open JOIN kept ON list_has_all(t, a) GROUP BY t)
SELECT page_id, host, path, rule, coalesce(label, best.verdict, 'allow') AS verdict FROM k LEFT JOIN best ON best.t = k.t"""

SQL = {"op1_quality_rules": QUALITY, "op4_substring_dedup": SUBSTRINGS, "op5_chat_format": CHAT, "op7_ngram_jaccard": JACCARD, "op11_source_divergence": DIVERGENCE, "op12_conversation_repair": REPAIR, "op13_url_filters": URLS}
