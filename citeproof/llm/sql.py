"""DuckDB SQL for the queries that SQL can express, over the whole tables. Limits are written out here, not taken from the operators."""

from __future__ import annotations

from citeproof.llm import licenses, mixing, url_filter

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def op1() -> str:
    weights = {**mixing.WEIGHTS, mixing.OTHER: mixing.OTHER_WEIGHT}
    return f"""
WITH t(stream, turn, turn_slot, weight) AS (VALUES {mixing.period_values(weights)}),
d AS (SELECT doc_id, CASE WHEN source IN ({', '.join(map(_text, mixing.WEIGHTS))}) THEN source ELSE '{mixing.OTHER}' END AS stream,
  coalesce(length(text), 0) AS size, md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS rank FROM documents),
p AS (SELECT doc_id, stream, CAST(coalesce(sum(size) OVER (PARTITION BY stream ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
b AS (SELECT *, start // {mixing.BLOCK_CHARS} AS block FROM p)
SELECT doc_id, b.stream, block, (block // weight) * {sum(weights.values())} + turn_slot AS slot, start
FROM b JOIN t ON t.stream = b.stream AND t.turn = b.block % t.weight"""


def _lines(site: str) -> str:
    """Rows (id, doc_id, site, text, place, norm, n_words) of lines with a word; id numbers the rows."""
    return f"""
docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce({site}, '') AS site, text FROM documents),
cut AS (SELECT id, doc_id, site, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM docs WHERE text IS NOT NULL),
named AS (SELECT *, lower(trim(regexp_replace(raw, '{SPACE}', ' ', 'g'))) AS norm FROM cut),
lines AS (SELECT *, len(string_split(norm, ' ')) AS n_words FROM named WHERE norm <> '')"""


def op2() -> str:
    return f"""
WITH {_lines('source')},
hosts AS (SELECT site, count(DISTINCT text) AS n_texts FROM docs GROUP BY site),
counted AS (SELECT site, norm FROM lines JOIN hosts USING (site) GROUP BY site, norm, n_texts
  HAVING count(DISTINCT text) > 10 AND (count(DISTINCT text) * 200 > n_texts OR count(DISTINCT text) >= 1000)),
gone AS (SELECT id, sum(n_words) AS n, count(*) AS n_lines FROM lines JOIN counted USING (site, norm) GROUP BY id),
dup AS (SELECT id, sum(n - 1) AS n FROM (SELECT id, raw, count(*) AS n FROM lines GROUP BY id, raw) GROUP BY id),
w AS (SELECT id, regexp_extract_all(text, '{WORD}') AS words FROM docs WHERE text IS NOT NULL),
each AS (SELECT id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
win AS (SELECT id, i, word, lead(word, 4) OVER o AS last, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] AS five FROM each WINDOW o AS (PARTITION BY id ORDER BY i)),
marked AS (SELECT id, i, last IS NOT NULL AND count(*) OVER (PARTITION BY id, five) > 1 AS hit FROM win),
rep AS (SELECT id, sum(CAST(covered AS BIGINT)) AS n FROM (SELECT id, bool_or(hit) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM marked) GROUP BY id),
base AS (SELECT id, doc_id, CAST(coalesce(len(words), 0) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0) AS BIGINT) AS n_symbols FROM docs LEFT JOIN w USING (id)),
alls AS (SELECT base.*, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_frequent_words, CAST(coalesce(gone.n_lines, 0) AS BIGINT) AS n_frequent_lines
  FROM base LEFT JOIN dup USING (id) LEFT JOIN rep USING (id) LEFT JOIN gone USING (id)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM alls)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_frequent_words, n_frequent_lines,
  NOT base_failed AND NOT (n_words - n_frequent_words < 5 OR (n_words - n_frequent_words) * 100 < n_words * 30) AS kept FROM failed"""


def op3() -> str:
    known = ", ".join(f"{_text(k)}: {_text(v)}" for k, v in licenses.SENTENCES.items())
    end = r"[.!?]+(?:[ \t\n\f\r\x0B]+|\z)|[\n\r]+"
    steps = []
    for k, (name, sequence) in enumerate(licenses.RULES):
        needle = "".join(f";{x};" for x in sequence)
        steps.append(f"""s{k + 1} AS (SELECT doc_id, ids, replace(rest, '{needle}', '_') AS rest,
  CASE WHEN contains(rest, '{needle}') AND NOT contains(found || ' ', ' {name} ') THEN found || ' {name}' ELSE found END AS found FROM s{k})""")
    n = len(licenses.RULES)
    return f"""
WITH p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{end}', chr(10), 'g'), '[^a-z0-9.\\n]+', ' ', 'g'), chr(10)) AS parts FROM documents),
i AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: MAP {{{known}}}[trim(x)]), lambda x: x IS NOT NULL) AS ids FROM p),
s0 AS (SELECT doc_id, ids, CASE WHEN len(ids) = 0 THEN '' ELSE ';' || array_to_string(ids, ';;') || ';' END AS rest, '' AS found FROM i),
{', '.join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ' '), '') AS sentence_ids, ltrim(found) AS licenses,
  CAST((length(rest) - length(replace(rest, ';', ''))) // 2 AS BIGINT) AS n_unmatched,
  found <> '' AND len(list_filter(string_split(ltrim(found), ' '), lambda x: NOT list_contains([{', '.join(map(_text, licenses.OPEN))}], x))) = 0 AS is_open FROM s{n}"""


def op5() -> str:
    u = url_filter
    rules = sorted(u.RULES, key=lambda r: (-len(r[1]), r[1]))
    rule, verdict = "CASE", "CASE"
    for kind, text in rules:
        domain, slash, rest = text.partition("/")
        fits = f" WHEN (host = '{domain}' OR suffix(host, '.{domain}')) AND starts_with(path, '{slash + rest}')"
        rule, verdict = f"{rule}{fits} THEN '{text}'", f"{verdict}{fits} THEN '{kind}'"
    k1 = u.ORDER + 1
    grams, joins, pa, pr = [], [], f"(1.0 / {u.SYMBOLS})", f"(1.0 / {u.SYMBOLS})"
    steps = []
    for k in range(1, k1 + 1):
        grams.append(f"""g{k} AS (SELECT right(win, {k}) AS gram, sum(na) AS ga, sum(nr) AS gr FROM counts GROUP BY 1 HAVING sum(na) + sum(nr) > 0),
c{k} AS (SELECT left(gram, {k - 1}) AS context, sum(ga) AS ca, sum(gr) AS cr FROM g{k} GROUP BY 1)""")
        steps.append(f"""p{k} AS (SELECT p.url, p.win, CASE WHEN ca IS NULL THEN pa ELSE (coalesce(ga, 0) + {u.A} * pa) / (ca + {u.A}) END AS pa,
  CASE WHEN ca IS NULL THEN pr ELSE (coalesce(gr, 0) + {u.A} * pr) / (cr + {u.A}) END AS pr
  FROM p{k - 1} p LEFT JOIN g{k} ON gram = right(p.win, {k}) LEFT JOIN c{k} ON context = left(right(p.win, {k}), {k - 1}))""")
    return f"""
WITH found AS (SELECT page_id, url, coalesce(instr(url, '://'), 0) AS a FROM pages),
parts AS (SELECT page_id, url, CASE WHEN a > 0 THEN translate(regexp_extract(substring(url, a + 3), '^[^/?#]*'), '{u._UPPER}', '{u._LOWER}') ELSE '' END AS host,
  CASE WHEN a > 0 THEN regexp_extract(substring(url, a + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM found),
ruled AS (SELECT *, {rule} END AS rule, {verdict} END AS verdict, contains('{u.HELD}', left(md5(host), 1)) AS held FROM parts),
urls AS (SELECT url, '{u.START * u.ORDER}' || regexp_replace(translate(url, '{u._UPPER}123456789', '{u._LOWER}000000000'), '[^\\x21-\\x7E]', '~', 'g') AS s,
  count(*) FILTER (verdict = 'allow') AS na, count(*) FILTER (verdict = 'block') AS nr, held FROM ruled WHERE url <> '' GROUP BY url, held),
wins AS (SELECT url, CASE WHEN held THEN 0.0::DOUBLE ELSE na END AS na, CASE WHEN held THEN 0.0::DOUBLE ELSE nr END AS nr, substring(s, i, {k1}) AS win FROM (SELECT *, unnest(generate_series(1, length(s) - {u.ORDER})) AS i FROM urls)),
counts AS (SELECT win, sum(na) AS na, sum(nr) AS nr FROM wins WHERE na + nr > 0 GROUP BY win),
{', '.join(grams)},
p0 AS (SELECT url, win, 1.0::DOUBLE / {u.SYMBOLS} AS pa, 1.0::DOUBLE / {u.SYMBOLS} AS pr FROM wins),
{', '.join(steps)},
scored AS (SELECT url, CAST(floor(sum(ln(pa) - ln(pr)) / count(*) * {u.BINS}) AS BIGINT) AS bin FROM p{k1} GROUP BY url),
bins AS (SELECT bin, sum(na) AS na, sum(nr) AS nr FROM scored JOIN urls USING (url) WHERE held AND na + nr > 0 GROUP BY bin),
parted AS (SELECT bin, lag(bin) OVER (ORDER BY bin) AS below, (sum(na) OVER up)::DOUBLE / nullif(sum(na) OVER (), 0)::DOUBLE - (sum(nr) OVER up)::DOUBLE / nullif(sum(nr) OVER (), 0)::DOUBLE AS parts
  FROM bins WINDOW up AS (ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
best AS (SELECT coalesce(CAST(floor((below + bin + 1) / 2.0) AS BIGINT), bin) AS threshold FROM parted WHERE parts IS NOT NULL ORDER BY parts DESC, bin LIMIT 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bin < coalesce((SELECT threshold FROM best), 0) THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN rule IS NULL THEN bin END AS bin FROM ruled LEFT JOIN scored USING (url)"""


def op8() -> str:
    return f"""
WITH {_lines('source')},
spread AS (SELECT norm FROM lines GROUP BY norm HAVING count(DISTINCT site) >= 10 AND count(DISTINCT text) >= 20),
left_ AS (SELECT id, string_agg(raw, chr(10) ORDER BY place) AS kept, count(*) AS n FROM named WHERE NOT (norm <> '' AND norm IN (SELECT norm FROM spread)) GROUP BY id)
SELECT doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) - coalesce(n, 0) END AS BIGINT) AS n_removed,
  sha256(CASE WHEN text IS NULL THEN '' ELSE coalesce(kept, '') END) AS kept_sha256
FROM docs LEFT JOIN left_ USING (id)"""


def op12() -> str:
    return """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, e.vec_id, e.label, CAST(coalesce(list_sum(list_transform(list_zip(a.v, e.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> p.own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3"""


def op13() -> str:
    return r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
each AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term FROM each GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM each JOIN kept USING (lang, term) GROUP BY lang, source, term),
tot AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (coalesce(total, 0) + 5 * v) AS p
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN tot ON tot.lang = g.lang AND tot.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)) AS q
  FROM c JOIN (SELECT lang, sum(total) AS total FROM tot GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z
  ON z.lang = a.lang AND z.source = a.source AND z.other = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER w AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms)
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= 50"""


ORACLES = {"op1_source_mixing": op1(), "op2_quality_rules": op2(), "op3_license_scan": op3(), "op5_url_filter": op5(), "op8_line_dedup": op8(), "op12_hard_negatives": op12(), "op13_source_divergence": op13()}
