"""Mixing sources to target weights by Pfair scheduling.

A source of weight p of Q gets its block k released at slot floor(k * Q / p) and due at slot ceil((k + 1) * Q / p). In
each slot the released block that is due first goes next. As the weights add up to Q, every block meets its deadline, and
at any slot each source is less than one block away from its share. Releases and deadlines repeat every Q slots, so one
period, which the weights alone fix, gives the slot of every block.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The weights of the query and the pipeline: the named sources, and all others together.
WEIGHTS = {"src0": 8, "src1": 4, "src2": 4, "src3": 4, "src4": 4, "src5": 3, "src6": 3, "src7": 3, "src8": 3, "src9": 3}
OTHER, OTHER_WEIGHT = "other", 30
BLOCK_CHARS, SEED = 65536, "mix-1"
#: The largest sum of weights: the rows of a period, which every task gets.
LONGEST_PERIOD = 10_000


def period(weights: dict[str, int]) -> list[tuple[str, int, int, int]]:
    """(source, block in the period, slot, weight) for one period: earliest deadline first, ties by name."""
    if not weights or any(p <= 0 for p in weights.values()) or sum(weights.values()) > LONGEST_PERIOD:
        raise ValueError(f"weights must be positive integers that add up to {LONGEST_PERIOD} at most")
    total = sum(weights.values())
    waiting = sorted((k * total // p, -(-(k + 1) * total // p), name, k) for name, p in weights.items() for k in range(p))
    ready: list[tuple[int, str, int]] = []
    out, i = [], 0
    for slot in range(total):
        while i < total and waiting[i][0] <= slot:
            heapq.heappush(ready, waiting[i][1:])
            i += 1
        due, name, k = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        out.append((name, k, slot, weights[name]))
    return out


def period_values(weights: dict[str, int]) -> str:
    """The period as SQL rows (stream, turn, turn_slot, weight)."""
    return ", ".join(f"('{name.replace(chr(39), chr(39) * 2)}', {k}, {slot}, {p})" for name, k, slot, p in period(weights))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, int] = WEIGHTS,
    other_weight: int = OTHER_WEIGHT,
    block_chars: int = BLOCK_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = SEED,
) -> DataFrame:
    """(doc, doc_id, stream, block, slot, start): every row of docs once, with its place in the mix, which (slot, start) orders.

    doc is the whole row as a struct. A stream is a named source, or all others with rows without a source. In a stream
    documents are shuffled by the MD5 of seed and id and cut into blocks of block_chars characters; start is where a
    document begins. A block is a document's first character's. When a stream ends its slots stay empty, so the others
    keep their weights to each other; nothing is dropped or repeated. Null texts have no length. Rows with equal ids
    follow each other by length.
    """
    named = {**weights, OTHER: other_weight}
    source = F.col(source_col).cast("string")
    stream = F.when(source.isin(list(weights)), source).otherwise(F.lit(OTHER))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("doc_id"), stream.alias("stream"), order.alias("rank"), F.coalesce(F.length(text_col), F.lit(0)).cast("bigint").alias("size"))
    rows = rows.withColumn("part", F.substring("rank", 1, 3))
    # Where each of a stream's 4096 parts begins: no task holds a whole stream.
    sums = rows.groupBy("stream", "part").agg(F.sum("size").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("stream").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begins = sums.select("stream", "part", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("size").over(Window.partitionBy("stream", "part").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(begins, ["stream", "part"])
    placed = placed.withColumn("start", F.col("base") + F.col("inside")).withColumn("block", F.expr(f"start div {block_chars}"))
    total = sum(named.values())
    turns = docs.sparkSession.sql(f"SELECT * FROM VALUES {period_values(named)} AS t(stream, turn, turn_slot, weight)")
    weight = docs.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(str((k, v)) for k, v in named.items())} AS t(stream, weight)")
    timed = placed.join(F.broadcast(weight), "stream").withColumn("turn", (F.col("block") % F.col("weight")).cast("int"))
    timed = timed.join(F.broadcast(turns.drop("weight")), ["stream", "turn"])
    return timed.select("doc", "doc_id", "stream", "block", (F.expr("block div weight") * total + F.col("turn_slot")).alias("slot"), "start")
