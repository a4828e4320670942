"""SQL of the registered queries that SQL can express."""

from .lines import Settings as LineSettings

_LINES = LineSettings()

#: Pages as lines of shown text, boilerplate by host, and what is left of every page.
OP9 = rf"""
WITH page AS (
    SELECT page_id,
        nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS host,
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
            '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'),
            '(?i)</?(p|br|li|ul|ol|div|h[1-6]|tr|table|nav|article|section|header|footer|title|body|head|html)\b[^>]*>',
            chr(10), 'g'),
            '<[^>]*>', '', 'g'), '[ \t\r\f\x0B]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^$', '') AS text
    FROM pages),
line AS (
    SELECT page_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM page),
total AS (SELECT host, count(*) AS total FROM page GROUP BY host),
boiler AS (
    SELECT line.host, line.line
    FROM line JOIN total ON line.host IS NOT DISTINCT FROM total.host
    WHERE NOT regexp_full_match(line.line, '[\x20\x09-\x0D]*')
    GROUP BY line.host, line.line
    HAVING count(DISTINCT page_id) >= {_LINES.min_pages} AND count(DISTINCT page_id) / any_value(total) > {_LINES.max_ratio}),
left_over AS (
    SELECT line.page_id, string_agg(line.line, chr(10) ORDER BY pos) AS text,
        bool_or(NOT regexp_full_match(line.line, '[\x20\x09-\x0D]*')) AS shown
    FROM line LEFT JOIN boiler ON line.host IS NOT DISTINCT FROM boiler.host AND line.line = boiler.line
    WHERE boiler.line IS NULL GROUP BY line.page_id)
SELECT page.page_id, page.host,
    CASE WHEN left_over.shown THEN left_over.text ELSE page.text END AS text,
    len(string_split(page.text, chr(10))) - len(string_split(CASE WHEN left_over.shown THEN left_over.text ELSE page.text END, chr(10)))
        AS n_dropped
FROM page LEFT JOIN left_over USING (page_id)
"""

#: BM25 of every row for every query, a term's share rounded to millionths.
OP2 = r"""
WITH word AS (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '(?:[0-9a-z]|[^\x00-\x7F])+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM word GROUP BY doc_id, term),
size AS (SELECT doc_id, sum(tf) AS words FROM tf GROUP BY doc_id),
total AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(words) FROM size) / (SELECT count(*) FROM documents) AS mean),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT doc_id AS query_id, term FROM tf WHERE doc_id % 50 = 0),
scored AS (
    SELECT query_id, doc_id, sum(round(
        ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * words / mean))) * 1e6))::BIGINT AS units
    FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN size USING (doc_id), total
    GROUP BY query_id, doc_id)
SELECT query_id, doc_id, units / 1e6 AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY units DESC, doc_id)::INTEGER AS rank
FROM scored WHERE units > 0
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY units DESC, doc_id) <= 10
"""

#: What five filters remove in each of their 120 orders.
OP12 = r"""
WITH RECURSIVE doc AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
counted AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
        min(doc_id) OVER (PARTITION BY text) AS first_id
    FROM doc),
failed AS (
    SELECT doc_id, part,
        CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * capitals > 3 * length(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS failed
    FROM counted),
said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cell AS (
    SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM failed LEFT JOIN said USING (doc_id) GROUP BY part, failed),
orders AS (
    SELECT '' AS o UNION ALL
    SELECT o || l FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE strpos(o, l) = 0),
stepped AS (
    SELECT o AS filter_order, step, o[step] AS letter, o[1:step - 1] AS before
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(o) = 5),
each AS (
    SELECT part, filter_order, step, letter, strpos(failed, letter) > 0 AS fails,
        length(translate(before, failed, '')) < length(before) AS gone, failed = letter AS alone, n, good, toxic
    FROM stepped, cell),
summed AS (
    SELECT part, filter_order, step, letter,
        sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN gone AND fails THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM each GROUP BY ALL)
SELECT * EXCLUDE (letter), sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM summed
"""

#: Equal texts without their separators, the longest original first.
OP13 = r"""
WITH doc AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
    FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    doc_id = first_value(doc_id) OVER best AS kept, text_sha256
FROM doc WINDOW best AS (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op2_search": OP2, "op9_lines": OP9, "op12_filter_audit": OP12, "op13_exact_dedup": OP13}
