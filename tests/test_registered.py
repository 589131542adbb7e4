from __future__ import annotations

import random
import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

from citeproof.functions import registered
from citeproof.functions.similarity import ratio
from citeproof.operators import evaluate as E
from citeproof.sources import fetch as H

TEXTS = [
    "  https://doi.org/10.1234/AbC. It's not 'running'; tested (=(x)) and or not, although \\models\\ fail. 2019\n[1]: nodes",
    "[3] A. Smith, B. Jones. Deep networks - a very long subtitle that goes on and on, too long[J]. Nature, 2015. doi: 10.1/x",
    "https://arxiv.org/abs/2101.00001v2",
    "注意力机制。并不总是有效；但是结果提高了 23%",
    "$E=mc^2$ and `code` <b>&\"q\"</b>",
    "",
    None,
]


def test_functions_in_sql_equal_those_of_columns(spark):
    """Every registered function gives in SQL what its column gives, and stays in the JVM."""
    names = registered.register(spark, "cp_")
    assert len(names) == len(set(names)) == len(registered.FUNCTIONS) + 4
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, x string").createOrReplaceTempView("given")
    given = spark.table("given").withColumns({"w": F.split("x", " "), "v": F.split(F.lower("x"), " ")})
    given.createOrReplaceTempView("given_words")
    for name, (function, types) in registered.FUNCTIONS.items():
        args = ["'ns'", "x"] if name == "cache_key" else ["x" if t == "string" else "wv"[i] for i, t in enumerate(types)]
        column = function("ns", F.col("x")) if name == "cache_key" else function(*map(F.col, args))
        sql = spark.sql(f"SELECT id, cp_{name}({', '.join(args)}) AS r FROM given_words ORDER BY id")
        assert sql.collect() == given.select("id", column.alias("r")).orderBy("id").collect(), name
        assert "Python" not in sql._jdf.queryExecution().toString(), name
    got = spark.sql("SELECT a.id AS i, b.id AS j, cp_gestalt_ratio(a.x, b.x) AS r FROM given a JOIN given b ON b.id = a.id + 1").collect()
    assert len(got) == 6 and all(r.r == ratio(TEXTS[r.i], TEXTS[r.j]) for r in got)


def test_table_functions(spark):
    registered.register(spark)
    spark.createDataFrame([(1, "First claim. Second one! no"), (2, ""), (3, None)], "id int, x string").createOrReplaceTempView("texts")
    split = spark.sql("SELECT id, c.* FROM texts, LATERAL claims_of(texts.x) AS c")
    assert sorted(map(tuple, split.collect())) == [(1, 1, "First claim"), (1, 2, "Second one")]
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    parts = spark.sql("SELECT id, c.clause FROM texts, LATERAL clauses_of(texts.x) AS c WHERE c.pos = 1").collect()
    assert [(r.id, r.clause) for r in parts] == [(1, "First claim. Second one! no")]


def test_observed_latencies(spark):
    """Counts and quantiles come with the query that writes the answers."""
    def slow(url, timeout):
        time.sleep(0.03 if url.endswith("7") else 0.001)
        return (500, {}, b"") if url.endswith("3") else (200, {}, b"{}")

    requests = spark.range(40).selectExpr("string(id) as key", "concat('u', id) as url")
    seen = Observation("asked")
    rows = E.observed(H.fetch(requests, 2, H.Policy(retries=0), slow), seen)
    assert len(rows.collect()) == 40
    assert (seen.get["n"], seen.get["failures"]) == (40, 4) and 1 <= seen.get["p50"] < 30 <= seen.get["p99"] <= seen.get["most"] <= seen.get["total"]


def test_latency_sketches_merge(spark):
    """Sketches of parts, merged, give the quantiles of all rows within the sketch's error of ranks."""
    at = random.Random(5)
    values = [(i % 7, "a" if i % 3 else "b", at.lognormvariate(3, 1)) for i in range(21000)]
    rows = spark.createDataFrame([*values, (0, "a", None), (1, "none", None)], "hour int, kind string, ms double")
    kept = E.latency_sketches(rows, ["hour", "kind"])
    assert kept.count() == 14
    for r in E.merged_latencies(kept, ["kind"], at_once=2).collect():
        own = sorted(ms for _, kind, ms in values if kind == r.kind)
        assert r.n == len(own) and abs(r.mean - sum(own) / len(own)) < 1e-6 and abs(r.qps - 2000 * len(own) / sum(own)) < 1e-6
        for q, told in ((0.5, r.p50), (0.99, r.p99)):
            assert abs(sum(x <= told for x in own) / len(own) - q) < 0.02
