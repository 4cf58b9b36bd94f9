"""DuckDB statements that check the queries which SQL can express."""
from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op1_warc_revisits"] = """
WITH fetched AS (
    SELECT page_id, url, coalesce(html, '') AS html, n, concat_ws('-', coalesce(page_id::VARCHAR, 'null'), n::VARCHAR) AS record_id,
           (1700000000 + coalesce(page_id, 0) % 86400 + n * 5400)::BIGINT AS time
    FROM pages, (VALUES (0), (1), (2)) AS t(n)),
split AS (
    SELECT *, ('0x' || substr(md5(record_id), 1, 1))::INT AS digit, md5(html) AS digest, 'day ' || (coalesce(page_id, 0) % 97) AS day,
           regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://|#.*$', '', 'g') AS bare
    FROM fetched),
parts AS (
    SELECT *, '"' || substr(digest, 1, 16) || '"' AS tag, CASE WHEN n = 0 THEN digit > 0 ELSE digit = 15 END AS whole,
           regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\\.', '') AS host,
           regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/$', '') AS path,
           list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'),
                                 lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS query
    FROM split),
captures AS (
    SELECT *, host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS canonical FROM parts),
responses AS (
    SELECT canonical, time, max(record_id) AS record_id, max_by(digest, record_id) AS digest, max_by(tag, record_id) AS tag,
           max_by(day, record_id) AS day, max_by(octet_length(encode(html)), record_id) AS bytes
    FROM captures WHERE whole AND canonical <> '' GROUP BY canonical, time),
revisits AS (
    SELECT record_id, canonical, time, digit, day, CASE WHEN digit < 9 THEN tag WHEN digit < 11 THEN 'W/' || tag WHEN digit < 12 THEN '"other"' END AS sent,
           CASE WHEN digit < 11 THEN tag WHEN digit < 12 THEN '"other"' END AS plain
    FROM captures WHERE NOT whole),
joined AS (
    SELECT v.*, r.record_id AS response_id, r.time AS response_time, r.digest AS kept, r.tag AS old_tag, r.day AS old_day, r.bytes,
           CASE WHEN r.record_id IS NULL THEN 'orphan' WHEN v.plain IS NOT NULL THEN if(v.plain = r.tag, 'resolved', 'mismatch')
                WHEN v.digit < 14 THEN if(v.day = r.day, 'resolved', 'mismatch') ELSE 'unverified' END AS status
    FROM revisits v ASOF LEFT JOIN responses r ON v.canonical = r.canonical AND v.time > r.time)
SELECT record_id, canonical, time, status, response_id, response_time,
       CASE WHEN status IN ('resolved', 'unverified') THEN kept END AS digest,
       CASE WHEN status IN ('resolved', 'unverified') THEN
            'cache-control: max-age=60' || chr(10) || 'content-length: ' || bytes || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || time
            || chr(10) || 'etag: ' || coalesce(sent, old_tag) || chr(10) || 'last-modified: ' || CASE WHEN digit IN (12, 13) THEN day ELSE old_day END
       END AS headers
FROM joined
"""

SQL["op2_poisson_mixing"] = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
    SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM counts) * (SELECT sum(n) FROM counts)::DOUBLE / n AS rate FROM counts),
parts AS (SELECT source, greatest(1, ceil(rate / 64))::INT AS parts, rate / greatest(1, ceil(rate / 64)) AS part_rate FROM rates),
steps AS (
    SELECT source, part_rate, 0 AS k, exp(-part_rate) AS p, exp(-part_rate) AS cdf FROM parts
    UNION ALL
    SELECT source, part_rate, k + 1, p * part_rate / (k + 1), cdf + p * part_rate / (k + 1) FROM steps
    WHERE k < ceil(part_rate + 12 * sqrt(part_rate) + 24)),
drawn AS (
    SELECT d.rowid AS row, p.source, part.j,
           ('0x' || substr(md5('42|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || part.j), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS u
    FROM (SELECT row_number() OVER () AS rowid, * FROM documents) d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source,
         LATERAL (SELECT unnest(range(1, p.parts + 1)) AS j) part),
copies AS (
    SELECT row, count(*) AS copies FROM drawn JOIN steps ON drawn.source IS NOT DISTINCT FROM steps.source AND steps.cdf <= drawn.u GROUP BY row),
numbered AS (SELECT row_number() OVER () AS rowid, * FROM documents)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy::INT AS copy,
       md5('42-order|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || c.copy) AS order_key
FROM numbered d JOIN (SELECT row, unnest(range(1, copies + 1)) AS copy FROM copies) c ON d.rowid = c.row
"""

SQL["op11_rule_ledger"] = """
WITH docs AS (SELECT row_number() OVER () AS num, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
    SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM docs),
starts AS (
    SELECT num, place, words[place] || ' ' || words[place + 1] || ' ' || words[place + 2] || ' ' || words[place + 3] || ' ' || words[place + 4] AS five
    FROM (SELECT num, words, unnest(range(1, len(words) - 3)) AS place FROM split WHERE len(words) >= 5)),
again AS (SELECT num, unnest(list(place)) AS place FROM starts GROUP BY num, five HAVING count(*) > 1),
covered AS (SELECT num, count(DISTINCT word) AS n FROM (SELECT num, unnest(range(place, place + 5)) AS word FROM again) GROUP BY num),
measured AS (
    SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
           len(lines)::BIGINT AS n_lines, len(list_filter(words, lambda x: regexp_matches(x, '\\p{L}')))::BIGINT AS n_letter_words,
           len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|\\x{2026})[\\x20\\x09-\\x0D]*$')))::BIGINT AS n_ellipsis_lines,
           len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*\\x{2022}]')))::BIGINT AS n_bullet_lines
    FROM split LEFT JOIN covered USING (num)),
failed AS (
    SELECT *, n_words < 10 AS f0, 100 * n_repeat_words > 20 * n_words AS f1, n_symbols > n_words AS f2, 100 * n_dup_lines > 50 * n_lines AS f3,
           100 * n_letter_words < 30 * n_words AS f4, word_chars < 2 * n_words AS f5, word_chars > 100 * n_words AS f6,
           100 * n_ellipsis_lines > 30 * n_lines AS f7, n_lines > 2 AND 100 * n_bullet_lines > 90 * n_lines AS f8
    FROM measured),
counted AS (
    SELECT *, f0::INT + f1::INT + f2::INT + f3::INT + f4::INT + f5::INT + f6::INT AS never, f7::INT + f8::INT AS soft FROM failed),
told AS (
    SELECT *, never = 0 AND soft <= 1 AS kept,
           CASE WHEN never = 1 AND soft <= 1 THEN CASE WHEN f0 THEN 'few_words' WHEN f1 THEN 'repeated_words' WHEN f2 THEN 'symbols'
                     WHEN f3 THEN 'repeated_lines' WHEN f4 THEN 'few_letters' WHEN f5 THEN 'short_words' ELSE 'long_words' END
                WHEN never = 0 AND soft = 2 THEN 'cut_lines' END AS sole_rule
    FROM counted),
gain AS (
    SELECT 'few_words' AS sole_rule, count(*) FILTER (WHERE never = 1 AND soft <= 1 AND f0) AS readmitted FROM told
    UNION ALL SELECT 'repeated_words', count(*) FILTER (WHERE never = 1 AND soft <= 1 AND f1) FROM told
    UNION ALL SELECT 'symbols', count(*) FILTER (WHERE never = 1 AND soft <= 1 AND f2) FROM told
    UNION ALL SELECT 'repeated_lines', count(*) FILTER (WHERE never = 1 AND soft <= 1 AND f3) FROM told
    UNION ALL SELECT 'few_letters', count(*) FILTER (WHERE never = 1 AND soft <= 1 AND f4) FROM told
    UNION ALL SELECT 'short_words', count(*) FILTER (WHERE never = 1 AND soft <= 1 AND f5) FROM told
    UNION ALL SELECT 'long_words', count(*) FILTER (WHERE never = 1 AND soft <= 1 AND f6) FROM told
    UNION ALL SELECT 'cut_lines', count(*) FILTER (WHERE never = 0 AND soft = 2) FROM told)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_letter_words, n_ellipsis_lines, n_bullet_lines,
       (f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT + 32 * f5::INT + 64 * f6::INT + 128 * f7::INT + 256 * f8::INT)::BIGINT
           AS fail_bits, f0 OR f1 AS base_failed, kept, 2 AS policy, sole_rule, readmitted::BIGINT AS readmitted
FROM told LEFT JOIN gain USING (sole_rule)
"""
