from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeproof.llm import hard_negatives
from citeproof.llm.hard_negatives import _Pivots, far_apart, first, mine_negatives, products

DDL = "vec_id bigint, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, positives=5, negatives=3):
    """(id, vector, label) by plain Python, every row against every other."""
    good = [(i, tuple(math.floor(256 * x) for x in v), c) for i, v, c in rows if None not in (i, v, c) and all(x is not None and math.isfinite(x) for x in v)]
    good = list(dict.fromkeys(good))
    out = []
    for a in (r for r in good if r[0] % 50 == 0):
        score = lambda r: sum(x * y for x, y in zip(a[1], r[1]))  # noqa: B023, E731
        ranked = lambda found, n: sorted(((-score(r), r[0]) for r in found))[:n]  # noqa: B023, E731
        for p, positive in ranked([r for r in good if r[2] == a[2] and r != a], positives):
            hard = [r for r in good if r[2] != a[2] and 50 * -p <= 100 * score(r) <= 95 * -p]
            out += [(a[0], positive, k, i, -p, -n) for k, (n, i) in enumerate(ranked(hard, negatives), 1)]
    return sorted(out)


def got(spark, rows, ddl=DDL):
    df = spark.createDataFrame(rows, ddl).withColumns({"key": F.lit(1), "rank": F.lit("x"), "score": F.lit(None).cast("int"), "whole": F.lit(2)})
    return sorted(tuple(r) for r in mine_negatives(df, F.col("vec_id") % 50 == 0).select(COLUMNS).collect())


def vectors(n, seed, clusters=4, width=12, noise=(0.05, 0.6)):
    rnd = np.random.Generator(np.random.PCG64(seed))
    centres = rnd.normal(size=(clusters, width))
    rows = centres[rnd.integers(0, clusters, n)] + rnd.normal(size=(n, width)) * rnd.choice(noise, (n, 1))
    rows = (rows / 4).astype(np.float32)
    return [(int(i), [float(x) for x in v], int(rnd.integers(0, 3))) for i, v in enumerate(rows)]


def odd_rows():
    rows = vectors(400, 1)
    same = rows[7][1]
    rows += [(1000 + i, same, i % 3) for i in range(30)]  # ties
    rows += [rows[0], rows[50], (50, rows[60][1], 1), (2000, [0.0] * 12, 0), (2050, [-0.0] * 12, 1), (2100, [], 0), (2150, [0.5], 2)]
    rows += [(None, same, 1), (3000, None, 1), (3050, same, None), (3100, [None, 1.0], 1), (3150, [math.nan] * 12, 1), (3200, [math.inf, 1.0], 2), (-100, same, 1), (-7, same, 2)]
    return rows


def test_against_all_pairs(spark):
    assert got(spark, odd_rows()) == brute(odd_rows())


def test_many_blocks(spark, monkeypatch):
    """Small blocks of rows and anchors, so that each anchor's rows come from many cells."""
    monkeypatch.setattr(hard_negatives, "ROWS", 40)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 2)
    rows = [(i * 10, v, 0 if i % 3 else c) for i, v, c in vectors(500, 9)]
    assert got(spark, rows) == brute(rows)


def test_large_components(spark):
    """Beyond the whole numbers that a double tells apart, scores are Python's integers."""
    rows = [(i, [x * 2.0**19 for x in v], c) for i, v, c in vectors(120, 5, width=6)]
    assert got(spark, rows, DDL.replace("float", "double")) == brute(rows)


def test_one_label_and_none(spark):
    rows = [(i, v, 1) for i, v, _ in vectors(120, 2)]
    assert got(spark, rows) == [] == brute(rows)
    assert got(spark, []) == []
    assert got(spark, [(50, None, 1)]) == []
    assert got(spark, [(50, [1.0], 1)]) == []


def test_brackets_hold():
    """Every score lies in its bracket, and where vectors lie in clusters the brackets leave few rows."""
    rows = np.array([[math.floor(256 * x) for x in v] for _, v, _ in vectors(3000, 3, clusters=8, noise=(0.05,))], float)
    most = (rows * rows).sum(1).max()
    lifted = np.column_stack([rows, np.sqrt(most - (rows * rows).sum(1))])
    pivots = _Pivots(far_apart(lifted[:500], 16), most)
    lead, own = rows[::50], pivots.of(rows, False)
    low, high = pivots.bracket(lead, pivots.of(lead, True), own, own)
    scores = lead @ rows.T
    assert (low <= scores).all() and (scores <= high).all()
    fifth = np.sort(scores, axis=1)[:, -5]
    assert (high >= fifth[:, None]).mean() < 0.3


def test_products_and_first():
    rnd = random.Random(1)
    for size in (3, 10**6, 10**12):
        a, rows = np.array([rnd.randint(-size, size) for _ in range(20)], float), np.array([[rnd.randint(-size, size) for _ in range(20)] for _ in range(30)], float)
        want = [sum(int(x) * int(y) for x, y in zip(a, r)) for r in rows]
        scores = products(a, rows)
        assert list(scores) == want
        ids = np.array([rnd.randint(0, 5) for _ in want])
        assert first(scores, ids, 4).tolist() == sorted(range(30), key=lambda i: (-want[i], ids[i]))[:4]


@pytest.mark.parametrize("k", [1, 2, 5])
def test_far_apart(k):
    points = far_apart(np.array([[0.0], [1.0], [1.0], [9.0], [5.0]]), k)
    assert [x for (x,) in points] == [0.0, 9.0, 5.0, 1.0][:k]
