"""DuckDB SQL for the registered queries, over the same derived relations."""

from __future__ import annotations

from citeproof.config import THRESHOLDS, WEIGHTS
from citeproof.functions.text import _stemmed
from citeproof.lexicons import CLAUSE_WORDS_EN, CLAUSE_WORDS_ZH, CONCEPTS, CORE_JOURNALS, FALLING, NEGATIONS_EN, NEGATIONS_ZH, RETRACTED_TITLE, RISING, STEM_SUFFIXES, SYNONYMS, TITLE_STOP_WORDS
from citeproof.plans.derived import CLAIM_VERBS, EVIDENCE, NOW


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def array(xs: list[str]) -> str:
    return "[" + ", ".join(map(lit, xs)) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')"


def words_from(x: str, n: int) -> str:
    return f"list_filter({words(x)}, lambda w: length(w) >= {n})"


def title_tokens(x: str) -> str:
    return f"list_filter({words(x)}, lambda w: regexp_full_match(w, '[a-z\\x{{4e00}}-\\x{{9fa5}}]{{2,}}') AND NOT list_contains({array(TITLE_STOP_WORDS)}, w))"


def stem(w: str) -> str:
    return f"CASE WHEN length({w}) > 4 THEN regexp_replace({w}, '({'|'.join(STEM_SUFFIXES)})$', '') ELSE {w} END"


def stems(x: str) -> str:
    other = "MAP {" + ", ".join(f"{lit(k)}: {array([_stemmed(s) for s in v])}" for k, v in SYNONYMS.items()) + "}"
    w = words_from(x, 2)
    return f"list_distinct(list_concat(list_transform({w}, lambda y: {stem('y')}), flatten(list_transform({w}, lambda y: coalesce({other}[y], CAST([] AS VARCHAR[]))))))"


def trigrams(x: str) -> str:
    clean = strip(f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')")
    return f"CASE WHEN length({clean}) >= 3 THEN list_distinct(list_transform(generate_series(1, length({clean}) - 2), lambda i: substring({clean}, i, 3))) ELSE CAST([] AS VARCHAR[]) END"


def both(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def jaccard(a: str, b: str) -> str:
    return f"(CAST({both(a, b)} AS DOUBLE) / greatest(len({a}) + len({b}) - {both(a, b)}, 1))"


def overlap(a: str, b: str) -> str:
    return f"(CAST({both(a, b)} AS DOUBLE) / greatest(len({a}), 1))"


def contains_any(x: str, xs: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in xs) + ")"


def sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '[。！？；.!?;\\n]+\\s*'), lambda s: {strip('s')}), lambda s: length(s) >= 4)"


def clauses(x: str) -> str:
    end = "(?i)(?:[;,]|\\b(?:" + "|".join(CLAUSE_WORDS_EN) + ")\\b|" + "|".join(CLAUSE_WORDS_ZH) + ")"
    parts = f"list_filter(list_transform(string_split_regex({x}, {lit(end)}), lambda s: {strip('s')}), lambda s: length(s) >= 3)"
    return f"CASE WHEN coalesce({x}, '') = '' THEN CAST([] AS VARCHAR[]) WHEN len({parts}) > 0 THEN {parts} ELSE [{x}] END"


def negated(x: str, targets: str) -> str:
    plain = f"list_filter({words(x)}, lambda w: regexp_full_match(w, '[a-z]+'))"
    near = f"list_filter(list_transform(generate_series(1, len(ws)), lambda i: list_contains({array(NEGATIONS_EN)}, ws[i]) AND (len({targets}) = 0 OR list_has_any(list_transform(ws[i + 1:i + 4], lambda y: {stem('y')}), {targets}))), lambda h: h)"
    return f"(len(list_transform([{plain}], lambda ws: len({near}))) > 0 AND list_transform([{plain}], lambda ws: len({near}))[1] > 0 OR {contains_any(x, NEGATIONS_ZH)})"


def normalize_doi(x: str) -> str:
    clean = f"regexp_replace(regexp_replace(lower({strip(x)}), '^https?://(dx\\.)?doi\\.org/', ''), '^doi:\\s*', '')"
    return f"CASE WHEN starts_with({clean}, '10.') THEN {clean} END"


def extract_doi(x: str) -> str:
    return f"rtrim(nullif(regexp_extract({x}, '10\\.\\d{{4,9}}/[-._;()/:A-Za-z0-9]+'), ''), '.,;:!?)]}}>')"


CITED = """firsts AS (SELECT l_orderkey, min(l_partkey) AS pk FROM lineitem GROUP BY 1),
cit AS (SELECT o_orderkey, o_custkey, c_name, c_mktsegment, c_nationkey, o_orderstatus, o_orderpriority, p_partkey, p_name, p_type, p_brand, CAST(year(o_orderdate) AS INTEGER) AS yr,
  '[' || o_orderkey || '] ' || c_name || '. ' || p_name || ' ' || p_type || '[J]. ' || c_mktsegment || ', ' || year(o_orderdate) || '. https://doi.org/10.1000/ORD.' || o_orderkey AS raw_text
  FROM orders JOIN firsts ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON pk = p_partkey)"""
RETRACTED = f"""back AS (SELECT DISTINCT l_orderkey AS seq FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1),
ret AS (SELECT seq, CASE WHEN seq % 3 = 0 THEN 'doi: 10.1000/ord.' || seq WHEN seq % 3 = 1 THEN 'HTTPS://DOI.ORG/10.1000/ORD.' || seq ELSE ' 10.1000/Ord.' || seq END AS doi FROM back),
dim AS (SELECT {normalize_doi('doi')} AS norm_doi FROM ret GROUP BY 1)"""
FLAGGED = f"""{CITED}, {RETRACTED},
cdoi AS (SELECT *, {extract_doi('raw_text')} AS doi FROM cit),
cnorm AS (SELECT *, {normalize_doi('doi')} AS norm_doi FROM cdoi),
flag AS (SELECT cnorm.*, dim.norm_doi IS NOT NULL AS hit FROM cnorm LEFT JOIN dim USING (norm_doi))"""
PAIRS = f"""{CITED},
pairs AS (SELECT o_orderkey, p_name || ' ' || CASE o_orderstatus {' '.join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in CLAIM_VERBS.items())} ELSE '' END || ' ' || lower(c_mktsegment) || ' demand' AS claim,
  'the ' || p_name || ' ' || CASE o_orderpriority {' '.join(f"WHEN {lit(k)} THEN {lit(v.split('{}')[0])} || lower(c_mktsegment) || {lit(v.split('{}')[1])}" for k, v in EVIDENCE.items())} ELSE '' END AS evidence FROM cit)"""
TURNS = "turns AS (SELECT a.conv_id, a.turn, a.text AS claim, b.text AS abstract FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
_STATE = "CASE WHEN o_orderstatus = 'F' THEN 'SUPPORTED' WHEN o_orderpriority = '1-URGENT' THEN 'CONTRADICTED' WHEN o_orderstatus = 'O' THEN 'PARTIAL' ELSE 'NEUTRAL' END"
STATES = f"""{FLAGGED},
st0 AS (SELECT *, {_STATE} AS st, o_orderpriority = '2-HIGH' AS unsure, o_orderpriority = '3-MEDIUM' AS journal, o_orderpriority <> '4-NOT SPECIFIED' AS matched, o_orderkey % 10 <> 0 AS has_text FROM flag),
states AS (SELECT *, CASE WHEN hit THEN 'RETRACTED' WHEN unsure OR journal OR NOT matched THEN 'UNVERIFIED' WHEN NOT has_text OR st = 'SUPPORTED' THEN 'VALID' ELSE 'CLAIM_MISMATCH' END AS status,
  CASE WHEN hit THEN 'DANGER' WHEN unsure THEN 'WARNING' WHEN journal THEN 'NOTICE' WHEN NOT matched THEN 'WARNING' WHEN NOT has_text THEN 'PASS' WHEN st = 'CONTRADICTED' THEN 'DANGER' WHEN st IN ('NEUTRAL', 'PARTIAL') THEN 'NOTICE' ELSE 'PASS' END AS risk,
  CASE WHEN hit THEN NULL WHEN unsure THEN 'UNCERTAIN' WHEN journal OR NOT matched THEN 'UNVERIFIED' WHEN NOT has_text THEN 'NEUTRAL' ELSE st END AS alignment_state FROM st0)"""
RESULTS = f"""{STATES},
res AS (SELECT o_custkey AS doc_id, o_orderkey AS line_no, 'cit_' || o_orderkey AS citation_id, raw_text, p_name AS title, doi, status, risk, norm_doi AS verified_doi, 'ARTICLE_MATCHED' AS evidence_status,
  'claim <' || c_mktsegment || '> & more' AS claim, p_type AS evidence_text, 'SENTENCE' AS evidence_granularity, 1.0::DOUBLE AS reference_confidence, 0.5::DOUBLE AS claim_alignment_score, alignment_state FROM states)"""
_WORKS = " UNION ALL ".join(
    f"""SELECT citation_key, {rank} * 5 + position AS seq, p_partkey, title, CASE WHEN p_size % 4 <> 0 THEN '{prefix}10.5000/P.' || p_partkey END AS doi, p_brand AS author, p_size + 1960 AS year, '{source}' AS source
FROM (SELECT m.citation_key, t.*, row_number() OVER (PARTITION BY m.citation_key ORDER BY m.shared DESC, t.p_partkey) AS position FROM met m JOIN titled t USING (title) WHERE {keep}) WHERE position <= 5"""
    for rank, (source, keep, prefix) in enumerate((("A", "true", ""), ("B", "p_size >= 15", "https://doi.org/"), ("C", "p_size <= 35", "")))
)
CANDIDATES = f"""asked AS (SELECT DISTINCT p_name || ' ' || p_type AS citation_key FROM cit),
askt AS (SELECT citation_key, list_distinct({title_tokens('citation_key')}) AS a FROM asked),
titled AS (SELECT *, p_name || ' ' || p_type AS title FROM part),
titt AS (SELECT title, list_distinct({title_tokens('title')}) AS b FROM (SELECT DISTINCT title FROM titled)),
met AS (SELECT * FROM (SELECT citation_key, title, {both('a', 'b')} AS shared FROM askt CROSS JOIN titt) WHERE shared > 0),
works AS ({_WORKS}),
wkeys AS (SELECT *, {normalize_doi('doi')} AS nd, regexp_replace(regexp_replace(lower({strip('title')}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g') AS nt FROM works),
wsame AS (SELECT *, CASE WHEN nd IS NOT NULL THEN 'd' || nd WHEN length(nt) >= 5 THEN 't' || nt || '|' || lower(author) || '|' || year ELSE 's' || seq END AS same FROM wkeys),
cand AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY citation_key, same ORDER BY seq) AS n FROM wsame) WHERE n = 1)"""
_T, _W = THRESHOLDS, WEIGHTS
SCORED = f"""{CITED}, {CANDIDATES},
raws AS (SELECT o_orderkey, cit.p_partkey AS gold, cand.p_partkey, seq, {title_tokens("cit.p_name || ' ' || p_type")} AS a, {title_tokens('title')} AS b, length(cit.p_name || ' ' || p_type) AS n,
  CASE WHEN abs(yr - year) = 0 THEN 1.0::DOUBLE WHEN abs(yr - year) = 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS year_score FROM cit JOIN cand ON cit.p_name || ' ' || p_type = citation_key),
tsim AS (SELECT *, CASE WHEN len(a) > 0 AND len(b) > 0 THEN {jaccard('list_distinct(a)', 'list_distinct(b)')} ELSE 0.0::DOUBLE END AS t FROM raws),
scored AS (SELECT *, CASE WHEN n >= 12 AND len(a) >= 3 AND t < {_T.title_hard_floor} THEN 'REJECTED_HARD_FLOOR' WHEN t < 0.70 THEN 'REJECTED_IDENTITY_GATE' ELSE 'ELIGIBLE' END AS status,
  ({_W.title}::DOUBLE * t + {_W.year}::DOUBLE * year_score) / ({_W.title}::DOUBLE + {_W.year}::DOUBLE) AS raw FROM tsim),
ranked AS (SELECT *, row_number() OVER w AS rank, coalesce(score - lead(score) OVER w, 1.0) AS margin FROM (SELECT *, CASE WHEN status = 'ELIGIBLE' THEN raw ELSE 0.0 END AS score FROM scored) WHERE score >= {_T.min_score} WINDOW w AS (PARTITION BY o_orderkey ORDER BY score DESC, seq))"""
TERMS = f"""docs AS (SELECT conv_id || ':' || turn AS key, text FROM conversations),
toks AS (SELECT key, unnest({words_from('text', 2)}) AS term FROM docs),
terms AS (SELECT key, term, count(*) AS tf FROM toks GROUP BY 1, 2),
idf AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM docs) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM terms GROUP BY 1),
pairs AS (SELECT conv_id || ':' || turn AS a, conv_id || ':' || (turn + 1) AS b FROM turns)"""
CACHE = """entries AS (SELECT event_type || ':' || user_id AS key, event_id AS seq,
  CAST(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS BIGINT) + CASE event_type WHEN 'error' THEN 86400 WHEN 'view' THEN 604800 ELSE 1209600 END AS expires_at FROM events)"""
_CLAUSE = f"list_sort(list_transform(generate_series(1, len(cl)), lambda i: {{'n': {both(stems('cl[i]'), 'cs')}, 'i': -i, 'c': cl[i]}}), 'DESC')[1]['c']"
CLAUSED = f"""{PAIRS},
p1 AS (SELECT *, {stems('claim')} AS cs, {clauses('evidence')} AS cl FROM pairs),
p2 AS (SELECT *, CASE WHEN len(cl) > 1 THEN {_CLAUSE} ELSE evidence END AS clause FROM p1)"""
_CHARS = "list_filter(list_distinct(string_split({}, '')), lambda c: NOT contains(' ,.，。!！?？' || chr(9) || chr(10), c))"
MANUSCRIPT = f"""{CITED},
sizes AS (SELECT o_custkey, count(*) AS n FROM cit GROUP BY 1),
body AS (SELECT o_custkey AS doc_id, o_orderkey, raw_text, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, n, 'As ' || p_name || CASE WHEN o_orderkey % 2 = 0 THEN ' shows [' || o_orderkey || ', ' || (o_orderkey + 100000) || '].' ELSE ' shows [' || o_orderkey || '-' || (o_orderkey + 2) || '].' END AS cite,
  CASE WHEN o_orderkey % 2 = 0 THEN [o_orderkey, o_orderkey + 100000] ELSE [o_orderkey, o_orderkey + 1, o_orderkey + 2] END AS nums FROM cit JOIN sizes USING (o_custkey)),
said AS (SELECT doc_id, k AS line_no, cite AS line, unnest(nums) AS num FROM body UNION ALL SELECT doc_id, n + 1 + k, raw_text, o_orderkey FROM body),
men AS (SELECT b.doc_id, b.n + 1 + b.k AS ref_line, min(s.line_no) AS claim_line, arg_min(s.line, s.line_no) AS claim FROM body b JOIN said s ON s.doc_id = b.doc_id AND s.num = b.o_orderkey AND s.line_no <> b.n + 1 + b.k GROUP BY 1, 2)"""
_UPDATE = f"list_filter({array(CORE_JOURNALS)}, lambda j: contains(corpus, j))[1]"
_concepts = [(contains_any("c", x), contains_any("s", x)) for x in CONCEPTS]
_both = " + ".join(f"CAST({a} AND {b} AS INTEGER)" for a, b in _concepts)
_any = " + ".join(f"CAST({a} OR {b} AS INTEGER)" for a, b in _concepts)

ORACLES: dict[str, str] = {
    "retraction_risk_summary": f"""WITH {FLAGGED} SELECT c_mktsegment, count(*) AS total, count(*) FILTER (NOT hit AND norm_doi IS NOT NULL) AS passed, count(*) FILTER (NOT hit AND norm_doi IS NULL) AS warning, count(*) FILTER (hit) AS danger,
  100 * (count(*) FILTER (NOT hit AND norm_doi IS NOT NULL))::DOUBLE / greatest(count(*), 1) AS pass_rate FROM flag GROUP BY 1""",
    "doi_normalize": f"WITH {RETRACTED} SELECT seq, {normalize_doi('doi')} AS norm_doi FROM ret",
    "doi_extract": f"WITH {CITED} SELECT o_orderkey, {extract_doi(chr(40) + 'raw_text || ' + lit('.)') + chr(41))} AS doi FROM cit",
    "arxiv_extract": "SELECT o_orderkey, regexp_extract(t, '(\\d{4}\\.\\d{4,5})', 1) AS arxiv_id, true AS is_arxiv FROM (SELECT o_orderkey, 'https://arxiv.org/abs/' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '.' || lpad(CAST(o_custkey AS VARCHAR), 5, '0') || 'v2' AS t FROM orders)",
    "cache_key": "SELECT p_partkey, sha256('works|' || lower(p_name) || '|' || lower(p_brand)) AS key FROM part",
    "retraction_semi": f"WITH {FLAGGED} SELECT o_orderkey, norm_doi FROM flag WHERE hit",
    "retraction_anti": f"WITH {FLAGGED} SELECT o_orderkey, norm_doi FROM flag WHERE NOT hit",
    "retraction_labels": f"WITH {FLAGGED} SELECT CASE WHEN coalesce(doi, '') = '' THEN 'INVALID_INPUT' WHEN hit THEN 'RETRACTED' WHEN norm_doi IS NULL THEN 'NOT_A_DOI' ELSE 'NO_RETRACTION_FOUND' END AS label, count(*) AS n FROM flag GROUP BY 1",
    "provider_outer_merge": f"""WITH a AS (SELECT '10.5000/p.' || p_partkey AS doi, CASE WHEN p_type <> 'SMALL' THEN p_name ELSE '' END AS title, p_size = 20 AS r, p_type AS abstract FROM part WHERE p_size >= 15),
b AS (SELECT '10.5000/p.' || p_partkey AS doi, CASE WHEN contains('10.5000/p.' || p_partkey, '7') THEN 'Retracted: ' || p_name ELSE p_name END AS title, p_size = 3 AS r FROM part WHERE p_size <= 35),
m AS (SELECT doi, coalesce(nullif(a.title, ''), b.title) AS title, coalesce(a.r, false) OR coalesce(b.r, false) AS r, coalesce(abstract, '') AS abstract, CASE WHEN a.title IS NOT NULL AND b.title IS NOT NULL THEN 'openalex+crossref' WHEN a.title IS NOT NULL THEN 'openalex' ELSE 'crossref' END AS provenance FROM a FULL JOIN b USING (doi))
SELECT doi, title, r OR coalesce({contains_any('lower(title)', RETRACTED_TITLE['merged'])}, false) AS is_retracted, abstract, provenance FROM m""",
    "citation_fields": f"WITH {CITED} SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS number, p_name || ' ' || p_type AS title, c_name AS authors, yr AS year, '10.1000/ORD.' || o_orderkey AS doi, 'J' AS doc_type FROM cit",
    "core_title": f"WITH {CITED} SELECT o_orderkey, p_name || ' ' || p_type AS core_title FROM cit",
    "bracket_range_mentions": f"WITH {MANUSCRIPT} SELECT doc_id, ref_line, claim_line, claim FROM men",
    "manuscript_citations": f"""WITH {MANUSCRIPT} SELECT b.doc_id, n + 1 + k AS line_no, 'cit_' || b.o_orderkey AS citation_id, '10.1000/ORD.' || b.o_orderkey AS doi, p_name || ' ' || p_type AS title, c_name AS authors, yr AS year, claim, 'Text Line ' || (n + 1 + k) AS location_info
FROM body b JOIN men ON men.doc_id = b.doc_id AND ref_line = n + 1 + k JOIN cit ON cit.o_orderkey = b.o_orderkey""",
    "candidate_union_dedup": f"WITH {CITED}, {CANDIDATES} SELECT citation_key, seq, p_partkey, coalesce(nd, doi) AS doi, title, year, source FROM cand",
    "candidate_rank_margin": f"WITH {SCORED} SELECT o_orderkey, p_partkey, score AS match_score, margin, CASE WHEN score >= {_T.high_confidence} AND margin >= {_T.high_margin} THEN 'HIGH' WHEN score >= {_T.medium_confidence} AND margin >= {_T.medium_margin} THEN 'MEDIUM' ELSE 'UNCERTAIN' END AS confidence FROM ranked WHERE rank = 1",
    "candidate_status": f"WITH {SCORED} SELECT status, count(*) AS n, sum(year_score) AS year_points FROM scored GROUP BY 1",
    "mrr_recall5": f"WITH {SCORED}, g AS (SELECT o_orderkey, rank FROM ranked WHERE p_partkey = gold) SELECT count(*) AS n, avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0.0 END) AS top1, avg(coalesce(1 / rank::DOUBLE, 0.0)) AS mrr, avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0.0 END) AS recall5 FROM cit LEFT JOIN g USING (o_orderkey)",
    "author_venue_scores": f"""WITH {CITED}, t AS (SELECT o_orderkey, raw_text, c_mktsegment, yr, {title_tokens("p_name || ' ' || p_type")} AS a, {title_tokens("p_name || ' ' || c_mktsegment")} AS b FROM cit)
SELECT o_orderkey, CAST(CASE WHEN len(a) > 0 AND len(b) > 0 THEN floor(round_even(0.7 * CASE WHEN list_contains(b, a[1]) THEN CASE WHEN length(a[1]) > 3 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END ELSE 0.0::DOUBLE END + 0.3 * {overlap('list_distinct(a)', 'list_distinct(b)')}, 3) * 1000 + 0.5) ELSE 0 END AS BIGINT) AS author_points,
  CASE WHEN contains(lower(raw_text), lower(c_mktsegment)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS venue_score, CASE WHEN abs(yr - 1998) = 0 THEN 1.0::DOUBLE WHEN abs(yr - 1998) = 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS year_score FROM t""",
    "containment_join": "SELECT item_id, min(doc_id) AS doc_id, count(*) AS n_docs FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) WHERE trim(b.text) <> '' GROUP BY 1",
    "journal_heuristic": f"WITH p AS (SELECT p_partkey, coalesce(p_name || '，《' || {array(CORE_JOURNALS)}[p_size % 40 + 1] || '》', p_name) AS corpus FROM part) SELECT p_partkey, {_UPDATE} AS journal FROM p",
    "sentence_split": f"WITH s AS (SELECT doc_id, unnest({sentences('text')}) AS s FROM documents) SELECT doc_id, count(*) AS n_sentences, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM s GROUP BY 1",
    "clause_split": f"WITH {PAIRS} SELECT o_orderkey, array_to_string({clauses('evidence')}, '|') AS clauses FROM pairs",
    "stem_overlap": f"WITH {TURNS}, t AS (SELECT conv_id, turn, {stems('claim')} AS a, {stems('abstract')} AS b FROM turns) SELECT conv_id, turn, {overlap('a', 'b')} AS stem_overlap FROM t",
    "trigram_jaccard": f"WITH {TURNS}, t AS (SELECT conv_id, turn, {trigrams('claim')} AS a, {trigrams('abstract')} AS b FROM turns) SELECT conv_id, turn, {jaccard('a', 'b')} AS trigram_jaccard FROM t",
    "token_jaccard": f"WITH {TURNS}, t AS (SELECT conv_id, turn, list_distinct({title_tokens('claim')}) AS a, list_distinct({title_tokens('abstract')}) AS b FROM turns) SELECT conv_id, turn, {jaccard('a', 'b')} AS token_jaccard FROM t",
    "concept_share": f"""WITH {TURNS}, t AS (SELECT conv_id, turn, lower(claim) AS c, lower(abstract) AS s, list_distinct({words_from('claim', 3)}) AS a, list_distinct({words_from('abstract', 3)}) AS b FROM turns)
SELECT conv_id, turn, CASE WHEN {_any} > 0 THEN ({_both})::DOUBLE / ({_any}) ELSE -1.0 END AS concept_share, {overlap('a', 'b')} AS token_overlap FROM t""",
    "best_sentence": f"""WITH {TURNS}, s AS (SELECT conv_id, turn, claim, unnest({sentences('abstract')}) AS sentence, generate_subscripts({sentences('abstract')}, 1) AS i FROM turns),
f AS (SELECT *, {stems('claim')} AS cs, {stems('sentence')} AS ss, {trigrams('claim')} AS cg, {trigrams('sentence')} AS sg FROM s),
v AS (SELECT *, 0.5 * {overlap('cs', 'ss')} + 0.3 * {jaccard('cg', 'sg')} AS score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, i) AS n FROM v) SELECT conv_id, turn, sentence, CAST(floor(score * 1e6) AS BIGINT) AS score_ppm FROM r WHERE n = 1""",
    "negation_scope": f"WITH {PAIRS}, t AS (SELECT *, {stems('claim')} AS cs, {stems('evidence')} AS es FROM pairs) SELECT o_orderkey, {negated('claim', 'es')} AS claim_negated, {negated('evidence', 'cs')} AS evidence_negated FROM t",
    "relevant_clause": f"WITH {CLAUSED} SELECT o_orderkey, clause FROM p2",
    "polarity_conflicts": f"""WITH {CLAUSED}, p3 AS (SELECT *, lower(claim) AS c, lower(clause) AS s, list_intersect({stems('lower(claim)')}, {stems('lower(clause)')}) AS shared FROM p2)
SELECT o_orderkey, ({contains_any('c', RISING)} AND {contains_any('s', FALLING)} AND NOT {contains_any('c', FALLING)}) OR ({contains_any('c', FALLING)} AND {contains_any('s', RISING)} AND NOT {contains_any('s', FALLING)})
  OR ({contains_any('c', NEGATIONS_ZH)} <> {contains_any('s', NEGATIONS_ZH)} AND {both(_CHARS.format('c'), _CHARS.format('s'))} >= 3)
  OR (len(shared) > 0 AND {negated('claim', 'shared')} <> {negated('clause', 'shared')}) AS conflict FROM p3""",
    "audit_risk_counts": f"WITH {STATES} SELECT c_nationkey, status, risk, alignment_state, count(*) AS n FROM states GROUP BY ALL",
    "audit_report": f"WITH {STATES} SELECT o_custkey, count(*) AS total, count(*) FILTER (risk = 'PASS') AS passed, count(*) FILTER (risk = 'NOTICE') AS notice, count(*) FILTER (risk = 'WARNING') AS warning, count(*) FILTER (risk = 'DANGER') AS danger FROM states GROUP BY 1",
    "disclosure_compact": f"WITH {RESULTS} SELECT doc_id, citation_id, raw_text, status, risk, verified_doi, evidence_status, claim, evidence_text, evidence_granularity FROM res",
    "disclosure_detailed": f"WITH {RESULTS} SELECT doc_id, citation_id, raw_text, status, risk, verified_doi, evidence_status, claim, evidence_text, evidence_granularity, reference_confidence, claim_alignment_score, alignment_state FROM res",
    "report_filter": f"WITH {RESULTS} SELECT doc_id, citation_id, title, risk FROM res WHERE risk = 'DANGER' AND contains(lower(title || ' ' || citation_id), 'ring')",
    "report_rows": f"WITH {RESULTS} SELECT citation_id, replace(replace(replace(claim, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS claim, title AS shown, CASE WHEN coalesce(verified_doi, '') = '' THEN 'none' ELSE 'web' END AS link FROM res",
    "idf_table": f"WITH {TURNS}, {TERMS} SELECT term, df, CAST(floor(idf * 1e6) AS BIGINT) AS idf_ppm FROM idf",
    "tfidf_cosine": f"""WITH {TURNS}, {TERMS}, w AS (SELECT key, term, tf * idf AS x FROM terms JOIN idf USING (term)), n AS (SELECT key, sqrt(sum(x * x)) AS norm FROM w GROUP BY 1),
d AS (SELECT a, b, sum(p.x * q.x) AS dot FROM pairs JOIN w p ON p.key = a JOIN w q ON q.key = b AND q.term = p.term GROUP BY 1, 2)
SELECT a, b, CAST(floor(coalesce(dot / (na.norm * nb.norm), 0.0) * 1e6 + 0.5) AS BIGINT) AS score_ppm FROM pairs LEFT JOIN d USING (a, b) LEFT JOIN n na ON na.key = a LEFT JOIN n nb ON nb.key = b""",
    "bm25": f"""WITH {TURNS}, {TERMS}, l AS (SELECT key, sum(tf)::DOUBLE AS length FROM terms GROUP BY 1), av AS (SELECT avg(length) AS av FROM l),
s AS (SELECT a, b, sum(idf * t.tf * 2.5 / (t.tf + 1.5 * (1 - 0.75 + 0.75 * length / greatest(av, 1.0)))) AS score FROM pairs JOIN terms q ON q.key = a JOIN idf ON idf.term = q.term JOIN terms t ON t.key = b AND t.term = q.term JOIN l ON l.key = b CROSS JOIN av GROUP BY 1, 2)
SELECT a, b, CAST(floor(coalesce(score, 0.0) * 1e6 + 0.5) AS BIGINT) AS score_ppm FROM pairs LEFT JOIN s USING (a, b)""",
    "confusion_f1": """WITH g AS (SELECT CASE WHEN toxic = 1 THEN 'CONTRADICTS' WHEN quality = 1 THEN 'SUPPORTS' ELSE 'NEUTRAL' END AS gold, coalesce(CASE WHEN n_chars >= 500 THEN 'SUPPORTS' WHEN n_chars >= 300 THEN 'CONTRADICTS' END, 'NEUTRAL') AS pred FROM labels LEFT JOIN documents USING (doc_id)),
c AS (SELECT label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold <> label AND pred = label) AS fp, count(*) FILTER (gold = label AND pred <> label) AS fn FROM g CROSS JOIN (SELECT unnest(['SUPPORTS', 'CONTRADICTS', 'NEUTRAL']) AS label) GROUP BY 1),
p AS (SELECT *, tp::DOUBLE / greatest(tp + fp, 1) AS "precision", tp::DOUBLE / greatest(tp + fn, 1) AS recall FROM c) SELECT *, 2 * "precision" * recall / greatest("precision" + recall, 1e-6) AS f1 FROM p""",
    "label_accuracy": f"""WITH {CITED}, g AS (SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'SUPPORTS' WHEN bool_or(o_orderstatus = 'P') THEN 'CONTRADICTS' ELSE 'NEUTRAL' END AS gold, count(*) AS n FROM cit GROUP BY 1)
SELECT gold, count(*) AS n, avg(CASE WHEN CASE WHEN n / 10.0::DOUBLE >= 1.2 THEN 'SUPPORTS' WHEN n / 10.0::DOUBLE <= 0.6 THEN 'NEUTRAL' ELSE 'SUPPORTS' END = gold THEN 1.0::DOUBLE ELSE 0.0 END) AS accuracy FROM g GROUP BY 1""",
    "embedding_cosine_topk": """WITH q AS (SELECT vec_id AS query_id, embedding AS q, label FROM embeddings WHERE vec_id % 100 = 0),
c AS (SELECT query_id, vec_id, greatest(0.0, least(1.0, list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))))) AS c FROM embeddings JOIN q USING (label) WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM c) SELECT query_id, rank, vec_id, CAST(floor(c * 1e6) AS BIGINT) AS cosine_ppm FROM r WHERE rank <= 5""",
    "cache_ttl_stats": f"WITH {CACHE} SELECT count(*) AS total, count(*) FILTER (expires_at < {NOW}) AS expired, count(*) FILTER (expires_at >= {NOW}) AS valid FROM entries",
    "cache_upsert_latest": f"WITH {CACHE}, l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM entries) SELECT key, seq, expires_at FROM l WHERE n = 1 AND expires_at >= {NOW}",
    "inverted_index_rebuild": "SELECT item_id, md5(text) AS text_md5 FROM benchmark",
    "batch_buckets": "SELECT batch, count(*) AS n, min(o_orderkey) AS first_key FROM (SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 55) AS BIGINT) AS batch FROM orders) GROUP BY 1",
    "openalex_records": """SELECT p_partkey, title, '10.5000/p.' || p_partkey AS doi, p_brand || '|' || p_type AS authors, p_size + 1960 AS year, CAST(NULL AS VARCHAR) AS venue, CASE WHEN p_size % 3 <> 0 THEN p_brand || ' ' || p_type || ' ' || p_type ELSE '' END AS abstract,
  p_size = 20 OR contains(lower(title), 'retracted') AS is_retracted, CAST(p_size AS BIGINT) AS cited_by_count, 'OpenAlex' AS source FROM (SELECT *, CASE WHEN p_size % 7 = 0 THEN 'RETRACTED: ' || p_name ELSE p_name END AS title FROM part)""",
    "crossref_records_by_doi": """SELECT p_partkey, title, '10.5000/p.' || p_partkey AS doi, p_brand || ' ' || p_type AS authors, p_size + 1960 AS year, p_brand AS venue, '' AS abstract, p_size % 4 = 0 OR p_size = 9 OR contains(lower(title), 'retracted') AS is_retracted, 'Crossref' AS source
  FROM (SELECT *, CASE WHEN p_size % 7 = 0 THEN 'RETRACTED: ' || p_name ELSE p_name END AS title FROM part)""",
    "crossref_records_by_title": "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'RETRACTED: ' || p_name ELSE p_name END AS title, p_size % 7 = 0 AS is_retracted FROM part",
    "semantic_scholar_records": """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'RETRACTED: ' || p_name ELSE p_name END AS title, CASE WHEN p_size % 2 = 0 THEN '10.5000/p.' || p_partkey ELSE '2301.' || p_partkey END AS doi, p_brand AS authors, p_size + 1960 AS year, p_brand AS venue,
  CASE WHEN p_size % 3 = 0 THEN p_type ELSE '' END AS abstract, p_size = 11 AS is_retracted, 'Semantic Scholar' AS source FROM part""",
    "query_admission": f"""WITH {CITED} SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN regexp_replace('1000/x.' || o_orderkey, '\\d{{4}}$', '') WHEN 2 THEN p_name || ' ' || p_type ELSE CASE WHEN o_orderstatus = 'F' THEN ' https://doi.org/10.1000/ORD.' || o_orderkey END END AS query,
  o_orderkey % 4 IN (1, 2) AS by_doi, CASE WHEN o_orderstatus = 'F' THEN '10.1000/ord.' || o_orderkey END AS provider_doi FROM cit""",
    "abstract_enrichment": """SELECT b.p_partkey, '10.5/' || (b.p_partkey % 1000) AS doi, CASE WHEN b.p_size % 3 = 0 THEN b.p_name ELSE coalesce(r.p_type, '') END AS abstract FROM part b LEFT JOIN part r ON r.p_partkey < 1000 AND r.p_size < 40 AND r.p_partkey = b.p_partkey % 1000""",
    "gold_labels": f"WITH {STATES} SELECT CASE WHEN alignment_state IN ('SUPPORTED', 'PARTIAL') THEN 'SUPPORTS' WHEN alignment_state = 'CONTRADICTED' THEN 'CONTRADICTS' ELSE 'NEUTRAL' END AS label, risk, count(*) AS n FROM states GROUP BY ALL",
    "file_kinds": """SELECT p_partkey, ['Text', 'Text', 'LaTeX/BibTeX', 'LaTeX/BibTeX', 'DOCX', 'PDF', 'Text', 'Text'][p_partkey % 8 + 1] AS kind, p_name || e AS name, lower(e) AS extension, replace(url_encode('/data/v1.2/' || p_brand || '/' || p_name || e), '+', '%20') AS quoted
  FROM (SELECT *, ['.md', '.TXT', '.tex', '.bib', '.docx', '.pdf', '', '.odt'][p_partkey % 8 + 1] AS e FROM part)""",
    "paper_records": f"""SELECT doc_id, substring(list_filter(list_transform(string_split(CASE WHEN doc_id % 2 = 0 THEN substring(text, 1, 80) || chr(10) || 'A. Author' ELSE text END, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')[1], 1, 200) AS title,
  CASE WHEN doc_id % 2 = 0 THEN 'We study ' || source || ' in 2004.' ELSE {strip("substring(text, 1, 500)")} END AS abstract FROM documents WHERE {strip("coalesce(text, '')")} <> ''""",
    "evidence_map": """WITH n AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, unnest(list_distinct([o_orderkey % 300, o_orderkey % 170, o_orderkey % 5000])) AS d FROM orders)
SELECT o_orderkey AS claim_id, o_orderpriority AS claim, CAST(d AS VARCHAR) AS doc_id, CASE WHEN d = o_orderkey % 300 AND o_orderstatus <> 'P' THEN CASE WHEN o_orderstatus = 'F' THEN 'SUPPORT' ELSE 'CONTRADICT' END ELSE 'NEUTRAL' END AS label, lang AS title, source AS abstract FROM n JOIN documents ON doc_id = d""",
    "key_mentions": f"""WITH {CITED}, l AS (SELECT o_custkey AS doc_id, o_orderkey, 'K' || (o_orderkey % 50) AS key, 'See [ K' || (o_orderkey % 50) || ' ] and [' || p_name || '], not [K' || (o_orderkey % 50) || 'x].' AS line FROM cit)
SELECT doc_id, key, min(o_orderkey) AS claim_line, arg_min(line, o_orderkey) AS claim FROM l GROUP BY 1, 2""",
    "detection_counts": f"""WITH {FLAGGED} SELECT count(*) AS total, count(*) FILTER (hit AND o_orderstatus <> 'P') AS retracted_detected, count(*) FILTER (NOT hit AND o_orderkey % 3 = 0 AND (o_orderpriority = '5-LOW' OR o_orderpriority >= '3')) AS fake_rejected,
  count(*) FILTER (NOT hit AND o_orderkey % 3 <> 0 AND o_orderpriority < '3') AS matched_count FROM flag""",
    "abstention": f"""WITH {SCORED}, g AS (SELECT o_orderkey, p_partkey AS found FROM ranked WHERE rank = 1 AND o_orderkey % 8 <> 0)
SELECT count(*) FILTER (o_orderkey % 4 = 0) AS n_abstain, count(*) FILTER (o_orderkey % 4 = 0 AND found IS NULL) AS abstained, count(*) FILTER (o_orderkey % 4 = 0 AND found IS NULL) / nullif(count(*) FILTER (o_orderkey % 4 = 0), 0)::DOUBLE AS abstention_accuracy FROM cit LEFT JOIN g USING (o_orderkey)""",
    "candidate_top_two": f"""WITH {SCORED}, named AS (SELECT r.o_orderkey, r.p_partkey, rank, score, margin, concat_ws('/', c.title, coalesce(c.nd, c.doi), c.source) AS shown FROM ranked r JOIN cit ON cit.o_orderkey = r.o_orderkey JOIN cand c ON c.citation_key = cit.p_name || ' ' || cit.p_type AND c.seq = r.seq WHERE rank <= 2),
u AS (SELECT o_orderkey, p_partkey, NOT (score >= {_T.medium_confidence} AND margin >= {_T.medium_margin}) AS is_uncertain FROM named WHERE rank = 1)
SELECT o_orderkey, u.p_partkey, is_uncertain, CASE WHEN is_uncertain THEN string_agg(shown, '|' ORDER BY rank) END AS two FROM u JOIN named USING (o_orderkey) GROUP BY 1, 2, 3""",
    "token_lengths": f"WITH {TURNS} SELECT avg(len(list_filter(string_split_regex(claim, '\\s+'), lambda w: w <> ''))) AS mean_claim, avg(len(list_filter(string_split_regex(abstract, '\\s+'), lambda w: w <> ''))) AS mean_abstract FROM turns",
    "report_terminal": f"WITH {RESULTS} SELECT citation_id, substring(raw_text, 1, 40) AS citation, status, risk, substring(evidence_text, 1, 40) AS evidence FROM res WHERE risk <> 'PASS'",
    "report_markdown": f"""WITH {RESULTS}, cards AS (SELECT *, '### ' || CASE risk WHEN 'DANGER' THEN '🔴' WHEN 'WARNING' THEN '🟡' WHEN 'NOTICE' THEN '🔵' ELSE '🟢' END || ' [' || risk || '] ' || title || chr(10) || '- place: Text Line ' || line_no || chr(10) || '- status: `' || status || '`' || chr(10)
  || '- DOI: [' || coalesce(verified_doi, doi) || '](https://doi.org/' || coalesce(verified_doi, doi) || ')' || chr(10) || '- claim: *"' || claim || '"*' || chr(10) || '- evidence: ' || substring(evidence_text, 1, 200) || '...' AS card FROM res)
SELECT doc_id, '# Citation audit' || chr(10) || '**file**: `' || doc_id || '`' || chr(10) || '**citations**: ' || count(*) || ' | 🟢 ' || count(*) FILTER (risk = 'PASS') || ' | 🔵 ' || count(*) FILTER (risk = 'NOTICE') || ' | 🟡 ' || count(*) FILTER (risk = 'WARNING') || ' | 🔴 ' || count(*) FILTER (risk = 'DANGER')
  || chr(10) || chr(10) || '---' || chr(10) || '## Needs attention' || chr(10) || CASE WHEN count(*) = count(*) FILTER (risk = 'PASS') THEN '> 🟢 nothing' || chr(10) ELSE regexp_replace(string_agg(CASE WHEN risk <> 'PASS' THEN card ELSE '' END, chr(10) ORDER BY line_no), '\\n{{2,}}', chr(10), 'g') END
  || chr(10) || '---' || chr(10) || '## All citations' || chr(10) || '| ID | title | status | risk |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| ' || concat_ws(' | ', citation_id, substring(title, 1, 200), status, risk) || ' |', chr(10) ORDER BY line_no) AS markdown FROM cards GROUP BY doc_id""",
    "report_html_rows": f"WITH {RESULTS} SELECT doc_id, count(*) FILTER (risk = 'PASS') AS pass, count(*) FILTER (risk = 'NOTICE') AS notice, count(*) FILTER (risk = 'WARNING') AS warning, count(*) FILTER (risk = 'DANGER') AS danger, CAST(count(*) AS VARCHAR) AS total FROM res GROUP BY 1",
}
