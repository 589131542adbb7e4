from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

from citeproof.llm import divergence
from citeproof.llm.divergence import audit_sources, share

from .test_llm import DDL

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=30, top=50):
    """(text, lang, source) by plain Python."""
    lower = {c: c + 32 for c in range(65, 91)}
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    groups = sorted({(lang or "", source or "") for _, lang, source in rows})
    for text, lang, source in rows:
        terms = [t.translate(lower) for t in TERM.findall(text or "")]
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in sorted({g[0] for g in groups}):
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: {t: counts[lang, s][t] for t in kept} for x, s in groups if x == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        p_of = lambda c: {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()}  # noqa: B023, E731
        p, q = {s: p_of(c) for s, c in own.items()}, p_of(whole)
        for s in own:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s]
            term = [(q[t] - p[s][t], t.encode()) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, n in (("pair", pair, None), ("term", term, top)):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(sorted(found)[:n], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i % 7, t, lang, s, None) for i, (t, lang, s) in enumerate(rows)], DDL).selectExpr("*", "1 as n", "'x' as term", "2 as bucket", "null as value")


def got(spark, rows, **more):
    return sorted(tuple(r) for r in audit_sources(frame(spark, rows), **more).select(COLUMNS).collect())


def corpus(seed, n=300, sources=5):
    rnd = random.Random(seed)
    words = [*"the of and the THE The don't o'clock été Éte straße 日本 😀 x1y Ⅷ a_b".split(), *(f"w{chr(97 + i)}z" for i in range(20))]
    rows = [(rnd.choice([" ", "\n", "-"]).join(rnd.choices(words, k=rnd.randint(0, 30))), rnd.choice(["en", "de", None, ""]), rnd.choice([None, "", *(f"s{k}" for k in range(sources)), "ü", "z😀"])) for _ in range(n)]
    rows += [(None, "en", "s1"), ("", "en", "only empty"), ("12 34 !?", "fr", "s1"), ("one text", "xx", "s1"), ("\x00\x7fäöü" * 5000, "en", "s2")]
    return rows + [rows[3]] * 40  # repeated rows are documents


def test_against_plain_python(spark):
    rows = corpus(1)
    for least in (30, 1, 10_000):
        assert got(spark, rows, least_docs=least) == brute(rows, least)
    assert got(spark, rows, least_docs=1, top=2) == brute(rows, 1, 2)


def test_small_blocks_and_units(spark, monkeypatch):
    """Blocks of few terms, units of few terms and sources, dense blocks of one term: every sum comes from many parts."""
    for name, value in (("BLOCK_TERMS", 30), ("UNIT_TERMS", 4), ("UNIT_SOURCES", 3), ("CELLS", 1)):
        monkeypatch.setattr(divergence, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = corpus(2, sources=8)
        assert got(spark, rows, least_docs=5) == brute(rows, 5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_few_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [("a a", "en", "s")]) == [] == brute([("a a", "en", "s")])
    rows = [("a", "en", "s"), (None, "en", None)]
    assert got(spark, rows) == brute(rows) == [("en", "", "pair", "s", 0, 1), ("en", "s", "pair", "", 0, 1)]


def test_share_is_exact():
    rnd = random.Random(1)
    for _ in range(500):
        total = rnd.randint(1, 9 * 10**15)
        n = rnd.randint(0, total)
        assert int(share(np.array([n]), np.array([total]))[0]) == 1 + int(Fraction(n * 10**9, total))
