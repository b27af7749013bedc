"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

from .quality_rules import STOP_WORDS, THRESHOLDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_OK = " AND ".join(f"{m} {op} {v}" for _, m, lo, hi in THRESHOLDS for op, v in ((">=", lo), ("<=", hi)) if v is not None)
_BROKEN = ", ".join(
    f"CASE WHEN {' OR '.join(f'{m} {op} {v}' for op, v in (('<', lo), ('>', hi)) if v is not None)} THEN '{r}' END" for r, m, lo, hi in THRESHOLDS)

OP1 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
      len(list_filter(w, lambda x: rtrim(lower(x), '.,;:!?') IN ({_STOP})))::BIGINT AS n_stop_words,
      len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words, len(l)::BIGINT AS n_lines
      FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT *, coalesce(word_chars / nullif(n_words, 0)::DOUBLE, 0) AS mean_word_length, coalesce(n_symbols / nullif(n_words, 0)::DOUBLE, 0) AS symbol_ratio,
      coalesce(n_letter_words / nullif(n_words, 0)::DOUBLE, 0) AS letter_word_ratio, coalesce(n_stop_words / nullif(n_words, 0)::DOUBLE, 0) AS stop_word_ratio,
      coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE, 0) AS dup_line_ratio, coalesce(n_words / nullif(n_lines, 0)::DOUBLE, 0) AS words_per_line,
      (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {_OK}) AS kept,
       n_stop_words, n_letter_words, n_lines, list_filter([{_BROKEN}], lambda x: x IS NOT NULL) AS broken_rules FROM f
"""

_WARC = r"""'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10)"""
_RECORDS = f"""SELECT page_id // 1000 AS file, page_id AS record_id, sha256(payload) AS digest,
  coalesce(sum(strlen(payload)) OVER (PARTITION BY page_id // 1000 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM (SELECT page_id, {_WARC} AS payload FROM """

OP3 = f"""
WITH o AS ({_RECORDS} pages)),
r AS ({_RECORDS} (SELECT page_id, url, CASE WHEN page_id % 2003 = 7 THEN substring(html, 1, 700) WHEN page_id % 23 = 5 THEN '~' || substring(html, 2) ELSE html END AS html FROM pages WHERE page_id % 3001 <> 11)))
SELECT o.file, o."offset", o.record_id, CASE WHEN r.digest IS NULL THEN 'missing' WHEN r.digest = o.digest THEN 'moved' ELSE 'corrupt' END AS status, o.digest AS expected, r.digest AS found
FROM o LEFT JOIN r ON o.record_id = r.record_id WHERE r.digest IS NULL OR r.digest <> o.digest OR r."offset" <> o."offset"
"""

OP5 = r"""
WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
      coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
k AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') || coalesce('?' || nullif(array_to_string(
      list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_\w*|ref|fbclid|gclid)(=|$)'))), '&'), ''), '') END AS key FROM h),
l AS (SELECT DISTINCT key FROM k WHERE regexp_extract(host, '([^.]+)\.[^.]+\.[^.]+$', 1) IN ('spam-farm', 'cheap-pills', 'casino-win', 'ads-track', 'free-bets')),
r AS (SELECT * FROM (VALUES ('block', 'com', 'en/'), ('allow', 'example.com', 'en/7'), ('block', 'net', 'de/'), ('block', 'example.net', 'de/8'), ('block', 'org', 'es/')) AS r(verdict, h, p)),
f AS (SELECT page_id, url, arg_max(r.h || '/' || r.p, length(r.h) + length(r.p)) AS rule, arg_max(r.verdict, length(r.h) + length(r.p)) AS verdict
      FROM k JOIN r ON (k.host = r.h OR ends_with(k.host, '.' || r.h)) AND starts_with(k.path, '/' || r.p) GROUP BY page_id, url)
SELECT k.page_id, k.host, k.path, f.rule, coalesce(f.verdict, CASE WHEN k.key IN (SELECT key FROM l WHERE key IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN f ON k.page_id = f.page_id AND k.url = f.url
"""

OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) IN (1, 2))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, other) AS (SELECT a, b FROM e UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON r.other = e.a),
sets AS (SELECT doc_id, md5(string_agg(s, chr(1) ORDER BY s)) AS d FROM s GROUP BY doc_id),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY d) AS class_id FROM sets)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS component_id, coalesce(any_value(cls.class_id), d.doc_id) AS class_id,
       coalesce(any_value(deg.n_links), 0)::BIGINT AS n_links
FROM documents d LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a) deg USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN cls ON cls.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

# Rows are damaged, marked and numbered; `best` holds the least (cost, audit) of each place in a dialogue (0 before it, 1 after the system turn, 2 after a
# user's, 3 after an assistant's) behind row i, with turns put in behind it.
OP12 = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
c AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda d, y: xor(d >> 1, 3988292384 * (d & 1))))) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE kind <> 0),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM d),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(role || ':' || text), nth) AS i, nth > 1 AS seen, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last, left(role, 1) AS initial FROM g),
f AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM m),
step AS (SELECT * FROM (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')) AS t(p, q, role)),
put AS (SELECT * FROM (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')) AS t(p, q, audit)),
edit AS (SELECT conv_id, i, p, p AS q, 3 AS cost, 'D' AS audit FROM f, (SELECT unnest([0, 1, 2, 3]) AS p)
  UNION ALL SELECT conv_id, i, p, q, (fault = 'truncated')::INT, 'K' FROM f JOIN step ON initial = step.role WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, i, p, q, 2 + (fault = 'truncated')::INT, 'R' FROM f JOIN step ON step.role <> 's' WHERE fault NOT IN ('blank', 'duplicate')),
best(conv_id, i, q, b) AS (
  SELECT conv_id, 0::BIGINT, q, {'cost': 2 * len(audit), 'audit': audit} FROM (SELECT DISTINCT conv_id FROM f), put WHERE p = 0
  UNION ALL SELECT b.conv_id, e.i, put.q, min({'cost': b.b.cost + e.cost + 2 * len(put.audit), 'audit': b.b.audit || e.audit || put.audit})
  FROM best b JOIN edit e ON e.conv_id = b.conv_id AND e.i = b.i + 1 AND e.p = b.q JOIN put ON put.p = e.q GROUP BY b.conv_id, e.i, put.q),
n AS (SELECT conv_id, max(i) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
      count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY conv_id),
r AS (SELECT n.*, b FROM n JOIN (SELECT conv_id, i, min(b) AS b FROM best WHERE q IN (0, 3) GROUP BY conv_id, i) USING (conv_id) WHERE i = n),
t AS (SELECT conv_id, k, b.audit[k] AS edit, len(replace(b.audit[:k], 'I', '')) AS i, len(replace(b.audit[:k - 1], 'D', '')) AS place FROM (SELECT conv_id, b, unnest(range(1, len(b.audit) + 1)) AS k FROM r)),
w AS (SELECT t.*, CASE WHEN edit <> 'I' THEN f.role END AS role, CASE WHEN edit <> 'I' THEN f.text ELSE '' END AS text, max((edit = 'K' AND initial = 's')::INT) OVER (PARTITION BY t.conv_id) AS s FROM t LEFT JOIN f ON f.conv_id = t.conv_id AND f.i = t.i),
h AS (SELECT conv_id, sha256(coalesce(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - s) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k), '')) AS h FROM w WHERE edit <> 'D' GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN r USING (conv_id) LEFT JOIN h USING (conv_id)
"""

ORACLES = {"op1_quality_rules": OP1, "op3_warc_audit": OP3, "op5_url_filter": OP5, "op6_jaccard_join": OP6, "op12_conversation_repair": OP12}
