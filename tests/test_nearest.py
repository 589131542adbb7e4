from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeproof.operators import evaluate as E

NAN, INF = float("nan"), float("inf")
ODD = [None, [], [0.0, 0.0], [1.0, None], [NAN, 1.0], [INF, 1.0], [-INF, 1.0], [1e-170, 1e-170], [1e160, 1e160], [1.0, 2.0, 3.0], [-0.0, 1.0], [-1.0, -2.0]]


def joined(vectors, queries, limit=5):
    """All pairs by a join, as the query was first written."""
    pairs = vectors.join(queries, "label").where("vec_id <> query_id").select("query_id", "vec_id", E.cosine(F.col("q"), F.col("embedding")).alias("c"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("c"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", "vec_id", "c")


@pytest.mark.parametrize("block", [8, E.BLOCK])
@pytest.mark.parametrize("odd", [False, True])
def test_nearest(spark, block, odd):
    """Ties, copies, repeated and null ids, lonely labels, and vectors that are no vectors: the same as by all pairs, to the last bit."""
    rows = [(i, [((i * 7 + k) * 2654435761 % 1009 - 500) / 97 for k in range(2)] if i % 3 else [1.0, 2.0 + i % 2], i % 2) for i in range(60)]
    rows += [(5, [0.5, -1.0], 1), (5, [0.5, -1.0], 1), (10, [3.0, 1.0], 0), (None, [1.0, 1.0], 0), (70, [1.0, 1.0], None), (80, [1.0, 1.0], 7)]
    rows += [(100 + i, x, i % 2) for i, x in enumerate(ODD + ODD)] if odd else []
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    q = v.where("vec_id % 5 = 0 or vec_id >= 100").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    got, want = (sorted(map(str, df.collect())) for df in (E.nearest(v, q, 5, block), joined(v, q)))
    assert got == want


def test_pairs_of_vectors_are_no_rows(spark):
    """What leaves the blocks is a few rows a query, where a join made a row of each pair."""
    v = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * (k + 1)).cast("float") for k in range(8)]).alias("embedding"), F.lit(0).alias("label"))
    q = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    near = E.nearest(v, q)
    assert sorted(map(str, near.collect())) == sorted(map(str, joined(v, q).collect()))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "FlatMapCoGroupsInArrow" in plan
