"""Connected components of a link table, by joins and aggregates only; no node's neighbours are ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeproof.llm.runtime import cut_few, release


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node reachable.

    First each node's smaller neighbours are hung below the smallest of them until every node has one at most, which
    leaves a forest whose roots are the smallest nodes; then pointers are doubled up to the roots. Links with a null
    and links of a node with itself count nothing. Equal rows count once. No links: no rows.
    """
    down = cut_few(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    by_node, written = Window.partitionBy("u"), down
    while True:
        # A node's smaller neighbours are as many as its component has centres; larger ones, which may be very many, are not gathered.
        marked = cut_few(down.withColumns({"m": F.min("v").over(by_node), "n": F.count("*").over(by_node)}))
        release(written)
        written = marked
        if marked.where("n > 1").isEmpty():
            down = marked.select("u", "v")
            break
        # The smallest neighbour of each node, and the others hung below it.
        down = marked.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
    while True:
        up = down.select(F.col("u").alias("v"), F.col("v").alias("w"))
        # Both sides are dealt by the join's key alone, which lets a hot root's rows be split.
        moved = cut_few(down.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("moved")))
        release(written)
        down, written = moved.select("u", "v"), moved
        if moved.where("moved").isEmpty():
            break
    roots = down.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return down.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
