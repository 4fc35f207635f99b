"""SQL of the operators that SQL can express, over the given tables."""

from __future__ import annotations

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d),
u AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l),
k AS (SELECT *, trim({_FOLDED.format('line')}, {_BLANKS}) AS key FROM u),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, (o.owner IS NOT NULL AND o.owner <> k.doc_id) AS gone FROM k LEFT JOIN o ON k.key = o.key AND length(k.key) >= 10)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

#: The given pages have their article in one element of that name.
PAGES = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1|br)[^>]*>', ' ', 'g'), '<[^>]+>', '', 'g') AS x FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(html_unescape_text, '\s+', ' ', 'g')) AS text FROM (
  SELECT page_id, url, replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') AS html_unescape_text FROM b))
SELECT page_id, url, text, length(text) AS n_chars FROM c
"""

#: Every order of the five filters over the masks of the documents.
AUDIT = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
f AS (SELECT text, min(doc_id) AS first_id FROM t GROUP BY text),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
  + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * length(w.text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN w.doc_id > f.first_id THEN 16 ELSE 0 END AS mask
  FROM w JOIN f ON w.text = f.text LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
e AS (SELECT part, filter_order, step, bit,
    CAST(coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before <> 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost
  FROM s, c GROUP BY part, filter_order, step, bit, before)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM e
"""

SEARCH = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all({_FOLDED.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term),
t AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(ts)) AS BIGINT) AS ll FROM d WHERE len(ts) > 0),
u AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM qt) GROUP BY doc_id, n, term),
v AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, t GROUP BY term, nn),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll)))) AS BIGINT) AS score
  FROM qt JOIN p USING (term) JOIN v USING (term), t GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""

ORACLES: dict[str, str] = {
    "op3_html_extraction": PAGES,
    "op9_line_dedup": LINES,
    "op11_filter_audit": AUDIT,
    "op13_ranked_search": SEARCH,
}
