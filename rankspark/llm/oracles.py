"""The same results in DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

from rankspark.llm import quality, urls

GAP = r"[ \t\n\v\f\r]"


def quality_rules(docs: str = "documents") -> str:
    """Rows of op1_quality_rules over the relation ``docs``."""
    outside, tails = [], []
    for m, (tail, reach, least, both) in quality.MEASURES.items():
        low = f" OR v < mid - {reach} * greatest(mid - low, {least})" if both else ""
        outside.append(f"(measure = '{m}' AND (v > mid + {reach} * greatest(high - mid, {least}){low}))")
        tails.append(f"WHEN '{m}' THEN {tail}")
    tail = f"CASE measure {' '.join(tails)} END"
    quant = lambda keys: (
        f"SELECT {keys}measure, max(docs) AS docs, min(CASE WHEN 1000 * up_to >= (1000 - {tail}) * docs THEN bucket END) AS low, "
        f"min(CASE WHEN 2 * up_to >= docs THEN bucket END) AS mid, min(CASE WHEN 1000 * up_to >= {tail} * docs THEN bucket END) AS high "
        f"FROM (SELECT {keys}measure, bucket, "
        f"sum(sum(n)) OVER (PARTITION BY {keys}measure ORDER BY bucket) AS up_to, sum(sum(n)) OVER (PARTITION BY {keys}measure) AS docs "
        f"FROM buckets GROUP BY {keys}measure, bucket) GROUP BY {keys}measure")
    k = quality.WEIGHT
    drawn = lambda docs, q, wider: f"({docs} * {q} + {k} * {wider}) // ({docs} + {k})"
    of_lang = ", ".join(f"{drawn('l.docs', f'l.{q}', f'o.{q}')} AS {q}" for q in ("low", "mid", "high"))
    of_own = ", ".join(f"{drawn('own.docs', f'own.{q}', f'g.{q}')} AS {q}" for q in ("low", "mid", "high"))
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, row_number() OVER () AS rn FROM {docs}),
w AS (SELECT *, [x for x in regexp_split_to_array(t, '{GAP}+') if x <> ''] AS ws,
             [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^ \\t\\n\\v\\f\\r]')] AS ln FROM d),
win AS (SELECT rn, i, array_to_string(list_slice(ws, i, i + {quality.WINDOW - 1}), ' ') AS g
        FROM (SELECT rn, ws, unnest(generate_series(1, len(ws) - {quality.WINDOW - 1})) AS i FROM w WHERE len(ws) >= {quality.WINDOW})),
twin AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rn, sum(least({quality.WINDOW}, coalesce(nxt - i, {quality.WINDOW}))) AS n
        FROM (SELECT rn, i, lead(i) OVER (PARTITION BY rn ORDER BY i) AS nxt FROM twin) GROUP BY rn),
c AS (SELECT w.rn, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '{quality.SYMBOLS}'))::BIGINT AS n_symbols,
             (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ln) AS n_lines
      FROM w LEFT JOIN rep ON rep.rn = w.rn),
m AS (SELECT *, word_chars * 100 // greatest(n_words, 1) AS word_len, n_symbols * 1000 // greatest(word_chars, 1) AS symbols,
             n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines, n_repeat_words * 1000 // greatest(n_words, 1) AS repeats,
             (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words) AS base_failed FROM c),
long AS (SELECT rn, lang, source, x.measure, x.v FROM (SELECT rn, lang, source,
         unnest([{', '.join(f"{{'measure': '{k}', 'v': {k}}}" for k in quality.MEASURES)}]) AS x FROM m WHERE NOT base_failed)),
buckets AS (SELECT lang, source, measure, (v // (1::BIGINT << greatest(length(bin(v)) - 6, 0))) * (1::BIGINT << greatest(length(bin(v)) - 6, 0)) AS bucket,
            count(*) AS n FROM long GROUP BY ALL),
own AS ({quant('lang, source, ')}), by_lang AS ({quant('lang, ')}), overall AS ({quant('')}),
wide AS (SELECT l.lang, l.measure, {of_lang} FROM by_lang l JOIN overall o ON l.measure = o.measure),
picked AS (SELECT own.lang, own.source, own.measure, {of_own}
           FROM own JOIN wide g ON own.lang IS NOT DISTINCT FROM g.lang AND own.measure = g.measure),
bad AS (SELECT DISTINCT rn FROM long JOIN picked p ON long.lang IS NOT DISTINCT FROM p.lang AND long.source IS NOT DISTINCT FROM p.source
        AND long.measure = p.measure WHERE {' OR '.join(o.replace('measure =', 'long.measure =') for o in outside)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND rn NOT IN (SELECT rn FROM bad)) AS kept FROM m
"""


def url_filters() -> str:
    fits = " ".join(
        f"WHEN (host = '{r[:r.index('/')]}' OR ends_with(host, '.{r[:r.index('/')]}')) AND starts_with(path, '{r[r.index('/'):]}') THEN '{r}'"
        for r, _ in sorted(urls.RULES, key=lambda x: (-len(x[0]), x[0])))
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in urls.RULES)
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = []
    for k in range(1, urls.ITERATIONS + 1):
        steps.append(
            f"r{k} AS (SELECT kind, host, sum(score) AS score FROM (SELECT kind, host, {1 - urls.DAMPING!r} * seed AS score FROM seeds UNION ALL "
            f"SELECT r.kind, f.dst AS host, {urls.DAMPING!r} * r.score * f.w AS score FROM r{k - 1} r JOIN flows f ON f.kind = r.kind AND f.src = r.host) GROUP BY kind, host)")
    link = urls.LINK.replace("'", "''")
    return f"""
WITH p AS (SELECT page_id, html, {lower("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE {fits} END AS rule FROM p),
j AS (SELECT *, CASE rule {verdicts} END AS said FROM r),
seeds AS (SELECT * FROM (
    SELECT 'trust' AS kind, host, avg(CASE WHEN said = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS seed FROM j WHERE host <> '' GROUP BY host UNION ALL
    SELECT 'distrust', host, avg(CASE WHEN said = 'block' THEN 1.0::DOUBLE ELSE 0 END) FROM j WHERE host <> '' GROUP BY host) WHERE seed > 0),
links AS (SELECT host AS src, {lower('dst')} AS dst FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS dst FROM p)),
edges AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst AND src <> '' GROUP BY src, dst),
both_ways AS (SELECT 'trust' AS kind, src, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
flows AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS w FROM both_ways),
r0 AS (SELECT kind, host, {1 - urls.DAMPING!r} * seed AS score FROM seeds),
{', '.join(steps)},
s AS (SELECT host, coalesce(round(sum(score) FILTER (kind = 'trust'), {urls.DECIMALS}), 0) AS trust,
             coalesce(round(sum(score) FILTER (kind = 'distrust'), {urls.DECIMALS}), 0) AS distrust FROM r{urls.ITERATIONS} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(said, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN s ON s.host = j.host
"""


def line_dedup() -> str:
    return """
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM raw WHERE text IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE regexp_matches(line, '[^ \\t\\n\\v\\f\\r]')),
w AS (SELECT doc_id, p, line AS a, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS k FROM w WHERE c IS NOT NULL),
gone AS (SELECT DISTINCT n.doc_id, n.i FROM r JOIN n ON n.doc_id = r.doc_id AND n.p BETWEEN r.p AND r.p + 2 WHERE r.k > 1),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS t FROM l ANTI JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id),
cnt AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT raw.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(cnt.c, 0)::BIGINT AS n_removed,
       CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept.t, '')) END AS kept_sha256
FROM raw LEFT JOIN kept ON kept.doc_id = raw.doc_id LEFT JOIN cnt ON cnt.doc_id = raw.doc_id
"""


def ranked_search() -> str:
    terms = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {terms} AS ts FROM documents),
q AS (SELECT row_number() OVER () AS qn, item_id, {terms} AS ts FROM benchmark),
t AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
qt AS (SELECT qn, term, count(*) AS c FROM (SELECT qn, unnest(ts) AS term FROM q) GROUP BY ALL),
p AS (SELECT rn, n, term, count(*) AS tf FROM (SELECT rn, len(ts) AS n, unnest(ts) AS term FROM d)
      WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, t GROUP BY term),
s AS (SELECT qn, rn, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM p JOIN qt USING (term) JOIN w USING (term), t GROUP BY qn, rn),
r AS (SELECT qn, doc_id, score, row_number() OVER (PARTITION BY qn ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM s JOIN d USING (rn) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r JOIN q USING (qn) WHERE rank <= 20
"""
