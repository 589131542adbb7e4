"""The queries that SQL can't express, over whole tables, against plain Python."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from citeproof.functions import text as T
from citeproof.plans import derived as D
from citeproof.plans.queries import QUERIES

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def candidates(spark):
    """The deduplicated candidates of each title, whose query SQL confirms, in order."""
    out = defaultdict(list)
    works = {r.work_id: r for r in D.provider_works(spark, SF)[0].collect()}
    for r in sorted(QUERIES["candidate_union_dedup"](spark, SF).collect(), key=lambda r: r.seq):
        out[r.citation_key].append((r, works[r.p_partkey]))
    return out


class Candidate:
    def __init__(self, row, work):
        self.p_partkey, self.title, self.doi, self.year, self.source, self.authors = row.p_partkey, row.title, row.doi, row.year, row.source, work.authors


def test_candidate_rank_gestalt(spark, candidates):
    got = {r.o_orderkey: r for r in QUERIES["candidate_rank_gestalt"](spark, SF).collect()}
    n = 0
    for c in D.citations(spark, SF).collect():
        title = f"{c.p_name} {c.p_type}"
        want = brute.best_candidate(title, [c.c_name], c.yr, [Candidate(*x) for x in candidates[title]])
        assert (want is None) == (c.o_orderkey not in got)
        if want:
            n, r, (best, score, margin, level, two) = n + 1, got[c.o_orderkey], want
            assert (r.p_partkey, r.match_score, r.match_confidence) == (best.p_partkey, score, level) and abs(r.match_margin - margin) < 1e-3
            assert r.is_uncertain == (level == "UNCERTAIN") and (r.ambiguous is None) == (level != "UNCERTAIN")
            if r.ambiguous:
                assert [(x["title"], x.get("doi")) for x in json.loads(r.ambiguous)] == [(x.title, x.doi) for x in two]
    assert n > 1000


def test_alignment_tiers(spark):
    got = QUERIES["alignment_tiers"](spark, SF).collect()
    pairs = Counter((r.claim, r.evidence) for r in D.claim_pairs(spark, SF).collect())
    assert {(r.claim, r.abstract): r.n for r in got} == dict(pairs)
    for r in got:
        assert (r.best_sentence, r.score, r.alignment_state) == brute.align(r.claim, r.abstract), (r.claim, r.abstract)
    assert len({r.alignment_state for r in got}) >= 3


def test_alignment_of_turns(spark):
    """Real sentences: each turn of a conversation against the next one."""
    from citeproof.functions.alignment import align

    pairs = D.turn_pairs(spark, SF)
    got = {(r.conv_id, r.turn): (r.best_sentence, r.score, r.alignment_state) for r in align(pairs, ["conv_id", "turn"]).collect()}
    want = {(r.conv_id, r.turn): brute.align(r.claim, r.abstract) for r in pairs.collect()}
    assert got == want and len(got) > 50


def test_turn_gestalt(spark):
    pairs = {(r.conv_id, r.turn): r for r in D.turn_pairs(spark, SF).collect()}
    for r in QUERIES["turn_gestalt"](spark, SF).collect():
        p = pairs.pop((r.conv_id, r.turn))
        assert r.ratio == brute.ratio(p.claim.lower(), p.abstract.lower())
    assert not pairs


def test_rounding(spark):
    """As Python rounds: by the exact binary value, ties to even."""
    rnd = random.Random(5)
    values = [k / 2000 for k in range(2001)] + [k / 200 for k in range(201)] + [rnd.random() for _ in range(3000)] + [0.5 * rnd.randrange(101) / 100 + 0.5 * rnd.randrange(101) / 100 for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    for r in df.select("x", T.rounded(F.col("x"), 3).alias("a"), T.rounded(F.col("x"), 2).alias("b")).collect():
        assert (r.a, r.b) == ((None, None) if r.x is None else (round(r.x, 3), round(r.x, 2))), r.x


def test_document_texts(spark):
    """Math and code removal, and clauses, on whole documents."""
    import re

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    steps = [r"```[\s\S]*?```", r"`[^`\n]+`", r"\\begin\{(?:equation|align|math|eqnarray)\*?\}[\s\S]*?\\end\{(?:equation|align|math|eqnarray)\*?\}", r"\$\$[\s\S]*?\$\$", r"\$(?!\s)[^\$\n]+(?<!\s)\$"]
    for r in QUERIES["strip_math_code"](spark, SF).collect():
        text = docs[r.doc_id]
        for s in steps:
            text = re.sub(s, "", text)
        assert r.n_chars == len(text)
    for r in QUERIES["document_clauses"](spark, SF).collect():
        found = brute.clauses(docs[r.doc_id]) if docs[r.doc_id] else []
        assert (r.n_clauses, r.n_chars) == (len(found), sum(map(len, found)))


def test_audit_cascade(spark):
    """Every citation's verdict, evidence and risk, worked out one by one, and counted for each manuscript."""
    gone = {r.seq for r in D.retractions(spark, SF).collect()}
    works = D.provider_works(spark, SF)
    want, cites = defaultdict(Counter), defaultdict(list)
    rows = sorted(D.citations(spark, SF).collect(), key=lambda c: c.o_orderkey)
    for c in rows:
        k = c.o_orderkey
        shown, named = (f"{k}, {k + 100000}", {k, k + 100000}) if k % 2 == 0 else (f"{k}-{k + 2}", {k, k + 1, k + 2})
        cites[c.o_custkey].append((named, f"As {c.p_name} shows [{shown}]."))
    for c in rows:
        # The first line of the manuscript that names the reference, alone, in a list or in a range.
        claim = next(line for named, line in cites[c.o_custkey] if c.o_orderkey in named)
        title = f"{c.p_name} {c.p_type}"
        if c.o_orderkey in gone:
            risk = "danger"
        elif c.o_orderpriority != "5-LOW":
            abstract = f"{c.p_name} shows demand in {c.c_mktsegment}" if c.o_orderstatus != "P" else ""
            state = brute.align(claim, abstract)[2] if abstract else None
            risk = {None: "passed", "CONTRADICTED": "danger", "NEUTRAL": "notice", "PARTIAL": "notice", "SUPPORTED": "passed"}[state]
        else:
            found = _searched(works, title)
            best = brute.best_candidate(title, [c.c_name], c.yr, found)
            if best is None or best[3] == "UNCERTAIN":
                risk = "warning"
            else:
                risk = {"CONTRADICTED": "danger", "NEUTRAL": "notice", "PARTIAL": "notice", "SUPPORTED": "passed"}[brute.align(claim, best[0].title)[2]]
        want[c.o_custkey][risk] += 1
    got = {r.doc_id: r for r in QUERIES["audit_cascade"](spark, SF).collect()}
    assert {k: (r.total, r.passed, r.notice, r.warning, r.danger) for k, r in got.items()} == {k: (sum(n.values()), n["passed"], n["notice"], n["warning"], n["danger"]) for k, n in want.items()}


_CACHE: dict = {}


def _searched(works, title):
    """The candidates of a title: the first five of each catalogue by shared title tokens, once for each DOI or title."""
    if "works" not in _CACHE:
        _CACHE["works"] = [[(set(brute.title_tokens(r.title)), r) for r in w.orderBy("work_id").collect()] for w in works]
    if title not in _CACHE:
        tokens, seen, out = set(brute.title_tokens(title)), set(), []
        for rows in _CACHE["works"]:
            hits = sorted(((-len(tokens & t), r.work_id, r) for t, r in rows if tokens & t), key=lambda x: x[:2])[:5]
            for _, _, r in hits:
                doi = (r.doi or "").lower().removeprefix("https://doi.org/")
                key = doi or (r.title.lower(), r.authors[0].lower(), r.year)
                if key not in seen:
                    seen.add(key)
                    out.append(r)
        _CACHE[title] = out
    return _CACHE[title]
