"""SQL for the registered queries, in DuckDB's dialect."""

OP1 = """
WITH p AS (
    SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
    SELECT h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(((CAST(('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS digest
    FROM (SELECT DISTINCT h FROM p)),
f AS (
    SELECT *, row_number() OVER (PARTITION BY body ORDER BY page_id NULLS LAST, url) AS place,
        first_value(page_id) OVER (PARTITION BY body ORDER BY page_id NULLS LAST, url) AS response FROM p)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
    CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN place > 1 THEN response END AS refers_to
FROM f JOIN d USING (h)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
win AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
place AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, place.n FROM place JOIN win USING (n, s)),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
listed AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
    FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN marked USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

_SAFE = "replace(replace(replace(replace({}, '&', '&amp;'), '#', '&num;'), ':', '&colon;'), '<', '&lt;')"

OP10 = f"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
t AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
        sum(length({_SAFE.format('role')}) + length({_SAFE.format('text')}) + 14) AS formatted
    FROM c GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
    sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars FROM t
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = f"""
WITH item AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
cut AS (SELECT doc_id, {_TERMS} AS w FROM documents),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM cut WHERE len(w) > 0),
posting AS (
    SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
    FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM cut)
    WHERE term IN (SELECT term FROM item) GROUP BY doc_id, n, term),
weight AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * max(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM posting, corpus GROUP BY term),
scored AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM item JOIN posting USING (term) JOIN weight USING (term), corpus GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10
"""

# every page of these tables marks its article, and refers to these characters only
OP11 = r"""
WITH article AS (
    SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'),
        '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
decoded AS (
    SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(t,
        '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;', '&'), '&amp ', '& '), '\s+', ' ', 'g')) AS text FROM article)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM decoded
"""


_RULES = (("n_symbols", "n_words", 1), ("n_dup_lines", "n_lines", 1), ("n_repeat_words", "n_words", 1), ("word_chars", "n_words", 1), ("word_chars", "n_words", -1))


def _class(part: str, whole: str, sign: int) -> str:
    x = f"(1000 * {part} // greatest({whole}, 1))"
    dropped = f"CAST(greatest(length(bin({x})) - 7, 0) AS BIGINT)"
    return f"{sign} * (64 * {dropped} + ({x} >> {dropped}))"


OP7 = rf"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
place AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i:i + 4], ' ')) AS n
    FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM doc WHERE len(w) >= 5)),
again AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM place WHERE n > 1) GROUP BY r),
m AS (
    SELECT r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(lines) AS BIGINT) AS n_lines
    FROM doc LEFT JOIN again USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
value AS (
    SELECT r, doc_id, lang, unnest([1, 2, 3, 4, 5]) AS rule, unnest([{", ".join(_class(*x) for x in _RULES)}]) AS c FROM b WHERE NOT base_failed),
mark AS (SELECT doc_id, max(quality) = 1 AS good FROM labels GROUP BY doc_id HAVING max(quality) IS NOT NULL),
seen AS (SELECT value.*, good, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) >= '4' AS holdout FROM value JOIN mark USING (doc_id)),
tally AS (
    SELECT lang, rule, c, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE NOT good) AS n_bad
    FROM seen WHERE NOT holdout GROUP BY ALL),
tail AS (
    SELECT *, coalesce(sum(n_good) OVER worse, 0) AS above, coalesce(sum(n_bad) OVER worse, 0) AS bad_above,
        sum(n_good) OVER (PARTITION BY lang, rule) AS all_good, sum(n_bad) OVER (PARTITION BY lang, rule) AS all_bad
    FROM tally WINDOW worse AS (PARTITION BY lang, rule ORDER BY c DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (
    SELECT lang, rule, [worst + 64, worst + 32, worst + 16, worst + 8, worst, c1, c2, c3, c4, c5] AS cuts
    FROM (
        SELECT lang, rule, max(c) FILTER (WHERE n_good > 0) AS worst,
            {", ".join(f"min(c) FILTER (WHERE n_good > 0 AND above <= CAST({0.02 * part} AS DOUBLE) * all_good) AS c{i}" for i, part in enumerate((0.0625, 0.125, 0.25, 0.5, 1.0), 1))},
            min_by(bad_above * all_good - above * all_bad, c) FILTER (WHERE n_good > 0 AND above <= CAST(0.02 AS DOUBLE) * all_good) AS gain
        FROM tail GROUP BY lang, rule)
    WHERE gain > 0),
first AS (
    SELECT value.r, min(len(list_filter(cuts, lambda x: x >= c))) AS step
    FROM value JOIN cut ON value.lang IS NOT DISTINCT FROM cut.lang AND value.rule = cut.rule GROUP BY value.r),
judged AS (SELECT s.lang, good, holdout, coalesce(step, 10) AS step FROM (SELECT DISTINCT r, lang, good, holdout FROM seen) s LEFT JOIN first USING (r)),
per AS (
    SELECT lang, j, count(*) FILTER (WHERE holdout AND good) AS n, count(*) FILTER (WHERE holdout AND good AND step <= j) AS k,
        count(*) FILTER (WHERE NOT holdout AND NOT good AND step <= j) * count(*) FILTER (WHERE NOT holdout AND good)
        - count(*) FILTER (WHERE NOT holdout AND good AND step <= j) * count(*) FILTER (WHERE NOT holdout AND NOT good) AS gain
    FROM judged, range(10) AS steps(j) GROUP BY lang, j),
tested AS (SELECT *, 0.05 / count(DISTINCT coalesce('=' || lang, '')) OVER () AS level FROM per WHERE n * ln(0.98) <= ln(0.05)),
fine AS (
    SELECT lang, j, gain, level >= (
        SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02) + (n - i) * ln(0.98)))
        FROM (SELECT unnest(range(k + 1)) AS i)) AS ok
    FROM tested),
taken AS (
    SELECT lang, least(coalesce(min(j) FILTER (WHERE NOT ok), 10), CASE WHEN max(gain) > 0 THEN arg_max(j, gain * 100 - j) + 1 ELSE 0 END) AS n_steps
    FROM fine GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(step < n_steps, false) AS kept
FROM b LEFT JOIN first USING (r) LEFT JOIN taken ON b.lang IS NOT DISTINCT FROM taken.lang
"""

ORACLE = {"op1_warc": OP1, "op2_decontaminate": OP2, "op7_quality_rules": OP7, "op10_chat": OP10, "op11_extraction": OP11, "op13_search": OP13}
