"""SQL twins of the operators that SQL can express: line templates (8), template leaks (9) and ranked search (11)."""

from __future__ import annotations

from .template_leaks import UNITS

_WS = r"[\x20\x09-\x0D]"
_NOT_WS = r"[^\x20\x09-\x0D]"


def line_dedup(leading: int = 3, min_words: int = 3, similarity: float = 0.7, min_docs: int = 5, min_spread: float = 0.5) -> str:
    words = f"list_filter(string_split_regex(masked, '{_WS}+'), lambda x: x <> '')"
    return rf"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS plain, string_split(regexp_replace(text, '{_NOT_WS}*[0-9]{_NOT_WS}*', '<*>', 'g'), chr(10)) AS hidden FROM documents),
each AS (SELECT doc_id, unnest(plain) AS line, unnest(hidden) AS masked, generate_subscripts(plain, 1) AS pos FROM docs),
near AS (SELECT doc_id, pos, line, masked, {words} AS w, concat(COALESCE(concat('x', LAG(masked) OVER o), ''), chr(1), COALESCE(concat('x', LEAD(masked) OVER o), '')) AS place FROM each WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
cand AS (SELECT *, len(w) AS n, w[1:{leading}] AS lead FROM near WHERE len(w) >= {min_words}),
wide AS (SELECT n, lead FROM cand GROUP BY 1, 2 HAVING COUNT(DISTINCT doc_id) >= {min_docs}),
kinds AS (SELECT n, lead, masked, any_value(w) AS w, COUNT(*) AS k FROM cand JOIN wide USING (n, lead) GROUP BY 1, 2, 3),
tokens AS (SELECT n, lead, masked, k, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM kinds),
tops AS (SELECT n, lead, i, word AS top FROM (SELECT n, lead, i, word, row_number() OVER (PARTITION BY n, lead, i ORDER BY SUM(k) DESC, word DESC) AS r FROM tokens GROUP BY n, lead, i, word) WHERE r = 1),
fits AS (SELECT n, lead, masked, CASE WHEN AVG(CASE WHEN word = top THEN 1.0::DOUBLE ELSE 0 END) >= {similarity}::DOUBLE THEN '' ELSE masked END AS template FROM tokens JOIN tops USING (n, lead, i) GROUP BY 1, 2, 3),
often AS (SELECT n, lead, template FROM cand JOIN fits USING (n, lead, masked) GROUP BY 1, 2, 3 HAVING COUNT(DISTINCT doc_id) >= {min_docs} AND COUNT(DISTINCT place) >= {min_docs} AND COUNT(DISTINCT place) >= {min_spread} * COUNT(DISTINCT doc_id)),
gone AS (SELECT DISTINCT n, lead, masked FROM fits JOIN often USING (n, lead, template))
SELECT a.doc_id, COUNT(*) AS n_lines, COUNT(g.n) AS n_dropped, COALESCE(string_agg(a.line, chr(10) ORDER BY a.pos) FILTER (g.n IS NULL), '') AS text FROM near a LEFT JOIN gone g ON len(a.w) = g.n AND a.w[1:{leading}] = g.lead AND a.masked = g.masked GROUP BY a.doc_id"""


def template_leaks(width: int = 6, coverage: float = 0.3) -> str:
    punct = r"[^\p{L}\p{N}\x20\x09-\x0D$%€£]"
    number = r"[0-9]+(?:[.,:/-][0-9]+)*"
    quantity = rf"[$€£]?{number}[\p{{L}}%$€£]{{0,4}}"
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    bare = f"regexp_replace(regexp_replace(lower(COLUMN), '^{punct}+', ''), '{punct}+$', '')"
    return rf"""
WITH source AS (SELECT 'd' AS src, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL UNION ALL SELECT 'b', item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
cut AS (SELECT src, id, unnest(string_split_regex(text, '{_WS}')) AS word, generate_subscripts(string_split_regex(text, '{_WS}'), 1) AS i FROM source),
prior AS (SELECT *, LAG(word) OVER (PARTITION BY src, id ORDER BY i) AS before FROM cut),
named AS (SELECT src, id, i, word, before, CASE WHEN regexp_matches(word, '^{punct}*\p{{Lu}}\p{{Ll}}') AND before <> '' AND NOT regexp_matches(before, '[.!?:;]$') THEN 'name' WHEN regexp_matches(word, '^{punct}*{number}{punct}*$') THEN 'number' WHEN regexp_matches(word, '^{punct}*{quantity}{punct}*$') THEN 'quantity' END AS kind FROM prior),
valued AS (SELECT *, CASE kind WHEN 'name' THEN regexp_replace(word, '^{punct}*', '') WHEN 'number' THEN regexp_extract(word, '{number}') WHEN 'quantity' THEN regexp_extract(word, '{quantity}') ELSE word END AS v FROM named),
typed AS (SELECT src, id, i, word, v, CASE WHEN kind IS NULL AND regexp_matches(word, '^(?i:{units})(?:[^\p{{L}}\p{{N}}]|$)') AND regexp_matches(LAG(v) OVER (PARTITION BY src, id ORDER BY i), '[0-9]$') THEN 'unit' ELSE kind END AS kind FROM valued),
canon AS (SELECT src, id, i, CASE WHEN kind IS NOT NULL THEN concat(chr(2), kind) ELSE {bare.replace('COLUMN', 'word')} END AS c, CASE WHEN kind IS NOT NULL THEN {bare.replace('COLUMN', 'v')} END AS v FROM typed),
placed AS (SELECT src, id, c, v, row_number() OVER (PARTITION BY src, id ORDER BY i) - 1 AS p FROM canon WHERE c <> ''),
windows AS (SELECT src, id, p, cs, vs FROM (SELECT src, id, p, list(c) OVER w AS cs, list(v) OVER w AS vs FROM placed WINDOW w AS (PARTITION BY src, id ORDER BY p ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING)) WHERE len(cs) = {width}),
asked AS (SELECT DISTINCT id AS item_id, p AS q, cs, list_filter(vs, lambda x: x IS NOT NULL) AS theirs FROM windows WHERE src = 'b' AND len(list_filter(vs, lambda x: x IS NOT NULL)) < len(vs)),
total AS (SELECT item_id, COUNT(DISTINCT q) AS total FROM asked GROUP BY 1),
hits AS (SELECT id AS doc_id, item_id, p - q AS diagonal, q, theirs, list_filter(vs, lambda x: x IS NOT NULL) AS slots FROM windows JOIN asked USING (cs) WHERE src = 'd'),
pairs AS (SELECT DISTINCT doc_id, item_id, diagonal, unnest(theirs) AS a, unnest(slots) AS b FROM hits),
odd AS (SELECT doc_id, item_id, diagonal, COUNT(*) = COUNT(DISTINCT a) AS consistent, bool_and(a = b) AS exact FROM pairs GROUP BY 1, 2, 3),
found AS (SELECT doc_id, item_id, diagonal, COUNT(DISTINCT q) AS n FROM hits GROUP BY 1, 2, 3)
SELECT doc_id, item_id, MAX(n) AS n_windows, MAX(n / total) AS coverage, bool_or(COALESCE(exact, true)) AS exact FROM found JOIN total USING (item_id) LEFT JOIN odd USING (doc_id, item_id, diagonal) WHERE COALESCE(consistent, true) AND n / total >= {coverage}::DOUBLE GROUP BY 1, 2"""


def ranked_search() -> str:
    terms = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')"
    return f"""
WITH docs AS MATERIALIZED (SELECT doc_id, {terms} AS ts FROM documents),
sizes AS MATERIALIZED (SELECT doc_id, len(ts) AS n FROM docs WHERE len(ts) > 0),
total AS MATERIALIZED (SELECT COUNT(*)::BIGINT AS nn, SUM(n)::BIGINT AS ll FROM sizes),
asked AS MATERIALIZED (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark WHERE item_id IS NOT NULL),
tf AS MATERIALIZED (SELECT doc_id, term, COUNT(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
weights AS MATERIALIZED (SELECT term, FLOOR(1000 * LN((2 * any_value(nn) + 2)::DOUBLE / (2 * COUNT(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term),
parts AS MATERIALIZED (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))) AS part FROM tf JOIN weights USING (term) JOIN sizes USING (doc_id), total),
scores AS (SELECT item_id, doc_id, SUM(part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY 1, 2),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10"""
