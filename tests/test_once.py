"""What repeats is worked out once, and what can't matter not at all, with the same results."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from citeproof.functions import alignment, similarity
from citeproof.functions.text import core_title, trigram_codes, trigrams


def test_texts_that_differ_in_characters_of_no_match_are_compared_once():
    similarity._kept_ratio.cache_clear()
    for i in range(100, 999):
        a, b = f"as large ring shows [{i}, {i + 100000}].", "large ring shows demand in tools"
        assert similarity.ratio(a, b) == SequenceMatcher(None, a, b).ratio()
    assert similarity._kept_ratio.cache_info().misses == 1
    pick = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(pick.choice(x) for _ in range(pick.choice([0, 9, 30, 230]))) for x in ("ab1\0文 ", pick.choice(["abz 文", "ab\0"])))
        assert similarity.ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)


def test_conflicts_are_told_in_the_row(spark, monkeypatch):
    words = ["drug", "survival", "increases", "reduced", "not", "No", "but", ",", "但no", "不", "notable", "effects", "Lacking", "疗效"]
    pick = random.Random(5)
    rows = [(i, *(" ".join(pick.choices(words, k=pick.randrange(1, 7))) for _ in range(2))) for i in range(600)] + [(600, None, "not"), (601, "no", None), (602, "", "")]
    df = spark.createDataFrame(rows, "k int, c string, s string")
    got = {r.k: r.x for r in alignment.with_conflict(df, "c", "s", "x").collect()}
    plan = alignment.align(df, ["k"], "c", "s")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    monkeypatch.setattr(alignment, "may_conflict", lambda claim, sentence: F.lit(True))
    want = {r.k: r.x for r in alignment.with_conflict(df, "c", "s", "x").collect()}
    assert got == want and len(got) == 603 and 20 < sum(want.values()) < 580


def test_trigrams_as_numbers(spark):
    odd = ["a𝒳b́é中文 12", "", None, "ab", "😀😀😀😀x", "İstanbul ß ŒUVRE, again: stan", "aaaaaa"]
    df = spark.createDataFrame([(x, y) for x in odd for y in odd], "x string, y string")
    shared = [F.size(F.array_intersect(f(F.col("x")), f(F.col("y")))) for f in (trigrams, trigram_codes)]
    sizes = [F.size(f(F.col("x"))) for f in (trigrams, trigram_codes)]
    assert all(r[0] == r[1] and r[2] == r[3] for r in df.select(*[c.alias(f"c{i}") for i, c in enumerate(shared + sizes)]).collect())


def test_steps_of_a_title_are_written_once(spark):
    plan = spark.createDataFrame([], "c string").select(core_title(F.col("c")).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(r"[JMDNRCP]") == 1
