"""Hard-negative mining by a pivot table: inner products as distances, bracketed by stored distances to pivots.

With one more component, sqrt(M^2 - |x|^2) for rows and 0 for anchors (M being the largest norm), the distance of an anchor and
a row tells their inner product: |a - x|^2 = |a|^2 + M^2 - 2 a.x. Every row keeps its distances to a few pivots; by the
triangle inequality |d(a, p) - d(x, p)| <= d(a, x) <= d(a, p) + d(x, p) they bracket its score. Blocks of rows, and rows, whose
bracket can't matter are left out, the others are scored exactly, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeproof.llm.runtime import cut

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Pivots, and the rows they are drawn from: a bounded sample, the least by a hash.
PIVOTS, SAMPLE = 16, 1024
#: Rows of a block, anchors of a block, and anchors that are bracketed at once.
ROWS, ANCHORS, AT_ONCE = 8192, 4096, 128
_MOST = 2**63 - 1


def integers(batch: pa.RecordBatch, scale: int) -> Iterator[np.ndarray | None]:
    """floor(scale * x) of each vector's components, as float64; None for one with null or non-finite components, or too long for a double."""
    for v in batch.column("vector").to_pylist():
        if v is None or any(x is None for x in v):
            yield None
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.floor(scale * np.array(v, np.float64))
            yield whole if np.isfinite(whole @ whole) else None


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of float64, filled up by zeros to width."""
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        row = np.frombuffer(x.as_py(), np.float64)
        out[i, : len(row)] = row
    return out


def products(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of a with rows, all of whole numbers: by float64 where no sum passes 2^53, else by Python's integers."""
    if not len(rows) or np.abs(a).max(initial=0) * np.abs(rows).max(initial=0) * len(a) < 2**53:
        return (rows @ a).astype(np.int64)
    whole = [int(x) for x in a]
    return np.array([sum(x * int(y) for x, y in zip(whole, row, strict=True)) for row in rows], object)


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, of equals the smaller ids."""
    at = np.arange(len(scores))
    if len(scores) > 4 * k and scores.dtype != object:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return np.array(sorted(at.tolist(), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of sample or fewer, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen, distance = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < n and distance.max() > 0:
        chosen.append(int(distance.argmax()))
        distance = np.minimum(distance, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


class _Pivots:
    """Distances to pivots, and the bracket of scores that they give."""

    def __init__(self, points: np.ndarray, most: float):
        #: points have the additional component last; most is M^2.
        self.points, self.most = points, most

    def of(self, rows: np.ndarray, anchors: bool) -> np.ndarray:
        last = np.zeros(len(rows)) if anchors else np.sqrt(np.maximum(0, self.most - (rows * rows).sum(1)))
        squares = (rows * rows).sum(1) + last * last
        inner = rows @ self.points[:, :-1].T + last[:, None] * self.points[:, -1]
        return np.sqrt(np.maximum(0, squares[:, None] + (self.points * self.points).sum(1) - 2 * inner))

    def bracket(self, anchors: np.ndarray, own: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) of the scores of anchors (at distances own) and rows whose distances lie in [least, most]."""
        near, far = np.zeros((len(own), len(least))), np.full((len(own), len(least)), np.inf)
        for j in range(own.shape[1]):
            d = own[:, j : j + 1]
            np.maximum(near, d - most[:, j], out=near)
            np.maximum(near, least[:, j] - d, out=near)
            np.minimum(far, d + most[:, j], out=far)
        squares = (anchors * anchors).sum(1)[:, None] + self.most
        # What rounding may have moved: distances are roots of differences, so their squares are off by some of the largest's last places.
        slack = 1e-6 * squares + 1
        return np.nan_to_num((squares - far * far) / 2 - slack, nan=-np.inf), np.nan_to_num((squares - near * near) / 2 + slack, nan=np.inf)


def mine_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of which `anchor` is true.

    Components count as floor(scale * x); a score is the inner product with the anchor, an exact integer. An anchor's
    positives are the `positives` other rows of its label with the highest scores, ties by smaller id. For each, the
    negatives are the first `negatives` rows of other labels with low * p <= 100 * n <= high * p, p and n being the
    scores of positive and negative. Anchors without positives or such negatives have no rows.
    Rows with a null id, label or vector, or a null or non-finite component (or a squared length that is) take no part. Rows that repeat an id, a label
    and a vector count once; rows of one id that differ otherwise are rows of their own. Missing components of shorter
    vectors count as 0. Scores beyond a long are given as the largest or smallest one. No rows give no rows.
    """
    named = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    named = named.where("vec_id is not null and label is not null and vector is not null")
    label_type = dict(named.dtypes)["label"]

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = list(integers(batch, scale))
            good = pa.array([i for i, x in enumerate(whole) if x is not None], pa.int64())
            kept = [x for x in whole if x is not None]
            # -0.0 and 0.0 are the same integer.
            columns = [pa.array([(x + 0.0).tobytes() for x in kept], pa.binary()), pa.array([float(x @ x) for x in kept], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(good) for c in ("vec_id", "label", "is_anchor")), *columns], ["vec_id", "label", "is_anchor", "whole", "norm2"])

    ddl = f"vec_id bigint, label {label_type}, is_anchor boolean, whole binary, norm2 double"
    single = named.mapInArrow(prepare, ddl).groupBy("vec_id", "label", "whole").agg(F.max("is_anchor").alias("is_anchor"), F.first("norm2").alias("norm2"))
    rows = cut(single.withColumn("key", F.xxhash64("vec_id", "label", "whole")))
    most, width = rows.agg(F.max("norm2"), F.max(F.expr("octet_length(whole) div 8"))).first()
    most, width = most or 0.0, width or 0
    sample = rows.select("whole", "key").orderBy("key", "whole").limit(SAMPLE).select("whole").collect()
    drawn = matrix(pa.array([r.whole for r in sample], pa.binary()), width)
    points = far_apart(np.column_stack([drawn, np.sqrt(np.maximum(0, most - (drawn * drawn).sum(1)))]), PIVOTS)
    pivots = vectors.sparkSession.sparkContext.broadcast(_Pivots(points, most))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pivots.value.of(matrix(batch.column("whole"), width), False)
            nearest = own.argmin(1) if own.size else np.zeros(len(own), int)
            columns = [pa.array([x.tobytes() for x in own], pa.binary()), pa.array(nearest, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "key", "is_anchor", "whole")), *columns], ["vec_id", "label", "key", "is_anchor", "whole", "distances", "nearest"])

    table = rows.mapInArrow(index, f"vec_id bigint, label {label_type}, key bigint, is_anchor boolean, whole binary, distances binary, nearest int")

    def grid(left: DataFrame, right: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
        """Anchors (left) and rows (right) of each value of by, dealt to cells of a block of anchors and a block of rows."""
        sizes = right.groupBy(*by).agg(F.expr(f"(count(*) - 1) div {ROWS} + 1").alias("right_blocks"))
        blocks = sizes.join(left.groupBy(*by).agg(F.expr(f"(count(*) - 1) div {ANCHORS} + 1").alias("left_blocks")), by)
        all_ = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
        mine = lambda n: F.pmod("key", F.col(n))
        a = left.join(blocks, by).select(*[F.col(c).alias(c) for c in left.columns], mine("left_blocks").alias("left_block"), all_("right_blocks").alias("right_block"))
        return a, right.join(blocks, by).select(*right.columns, all_("left_blocks").alias("left_block"), mine("right_blocks").alias("right_block"))

    def bracketed(anchors: pa.Table, data: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each anchor of a cell: its place, its vector, low and high of each row of the block."""
        vectors_, own = matrix(data.column("whole"), width), matrix(data.column("distances"), len(points))
        lead = matrix(anchors.column("whole"), width)
        at = pivots.value.of(lead, True)
        for a in range(0, len(lead), AT_ONCE):
            low_, high_ = pivots.value.bracket(lead[a : a + AT_ONCE], at[a : a + AT_ONCE], own, own)
            for i in range(len(low_)):
                yield a + i, lead[a + i], low_[i], high_[i], vectors_

    def longs(values: list) -> pa.Array:
        """As longs, the nearest one where a value is beyond them."""
        return pa.array([max(-_MOST - 1, min(_MOST, int(x))) for x in values], pa.int64())

    def near(anchors: pa.Table, data: pa.Table) -> pa.Table:
        """The block's first rows for each anchor of the cell."""
        out: dict[str, list] = {c: [] for c in ("anchor_id", "anchor_key", "positive_id", "score")}
        if anchors.num_rows and data.num_rows:
            ids, keys = data.column("vec_id").to_numpy(), data.column("key").to_numpy()
            own_id, own_key = anchors.column("vec_id").to_numpy(), anchors.column("key").to_numpy()
            for i, lead, low_, high_, vectors_ in bracketed(anchors, data):
                other = np.flatnonzero((ids != own_id[i]) | (keys != own_key[i]))
                if len(other) > positives:
                    # So many rows have at least this score: whatever can't reach it isn't among the first.
                    floor = np.partition(low_[other], len(other) - positives)[len(other) - positives]
                    likely = other[np.argpartition(high_[other], len(other) - positives)[-positives:]]
                    floor = max(floor, float(products(lead, vectors_[likely]).min()))
                    other = other[high_[other] >= floor]
                scores = products(lead, vectors_[other])
                for j in first(scores, ids[other], positives):
                    for c, v in zip(out, (own_id[i], own_key[i], ids[other[j]], scores[j]), strict=True):
                        out[c].append(v)
        return pa.table({**{c: pa.array(out[c], pa.int64()) for c in ("anchor_id", "anchor_key", "positive_id")}, "score": longs(out["score"])})

    # Under names of their own, as the rows that they meet come from the same table.
    anchors = table.where("is_anchor").select(*[F.col(c).alias(c) for c in ("vec_id", "label", "key", "whole")])
    left, right = grid(anchors, table.select("vec_id", "label", "key", "whole", "distances"), ["label"])
    cells = ["label", "left_block", "right_block"]
    candidates = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(near, "anchor_id bigint, anchor_key bigint, positive_id bigint, score bigint")
    by_score = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("score"), "positive_id")
    chosen = cut(candidates.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= positives))
    # Below zero the range of negatives is empty.
    wanted = chosen.where("score >= 0").groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "score"))).alias("positives"))

    def hard(anchors: pa.Table, data: pa.Table) -> pa.Table:
        """The block's first negatives for each positive of the cell's anchors."""
        out: dict[str, list] = {c: [] for c in ("anchor_id", "anchor_key", "place", "positive_id", "positive_score", "negative_id", "negative_score")}
        if anchors.num_rows and data.num_rows:
            ids, labels = data.column("vec_id").to_numpy(), data.column("label").combine_chunks().dictionary_encode()
            number = {x: i for i, x in enumerate(labels.dictionary.to_pylist())}
            labels, own_labels = labels.indices.to_numpy(), anchors.column("label").to_pylist()
            own_id, own_key, told = anchors.column("vec_id").to_pylist(), anchors.column("key").to_pylist(), anchors.column("positives").to_pylist()
            for i, lead, low_, high_, vectors_ in bracketed(anchors, data):
                ranges = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in told[i]]
                least, top = min(a for a, _ in ranges), max(b for _, b in ranges)
                other = np.flatnonzero((labels != number.get(own_labels[i], -1)) & (high_ >= least) & (low_ <= top))
                if not len(other):
                    continue
                scores = products(lead, vectors_[other])
                for p, (a, b) in zip(told[i], ranges, strict=True):
                    fits = np.flatnonzero((scores >= a) & (scores <= b))
                    for j in first(scores[fits], ids[other[fits]], negatives) if len(fits) else ():
                        for c, v in zip(out, (own_id[i], own_key[i], p["place"], p["positive_id"], p["score"], ids[other[fits[j]]], scores[fits[j]]), strict=True):
                            out[c].append(v)
        return pa.table({c: longs(v) if c == "negative_score" else pa.array(v, pa.int32() if c == "place" else pa.int64()) for c, v in out.items()})

    # Rows nearest to the same pivot share blocks, so that a block's distances lie close together. An anchor goes to the
    # pivots whose rows' least and largest distances leave room for one of its ranges; these are two arrays for each pivot.
    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            own, nearest = matrix(batch.column("distances"), len(points)), batch.column("nearest").to_numpy()
            for j in np.unique(nearest).tolist():
                mine = own[nearest == j]
                n, lo, hi = found.get(j, (0, np.inf, -np.inf))
                found[j] = (n + len(mine), np.minimum(lo, mine.min(0)), np.maximum(hi, mine.max(0)))
        yield pa.RecordBatch.from_pylist([{"nearest": j, "n": n, "least": lo.tolist(), "most": hi.tolist()} for j, (n, lo, hi) in found.items()], pa.schema([("nearest", pa.int32()), ("n", pa.int64()), ("least", pa.list_(pa.float64())), ("most", pa.list_(pa.float64()))]))

    partial = table.select("nearest", "distances").mapInArrow(extremes, "nearest int, n bigint, least array<double>, most array<double>")
    merged = partial.groupBy("nearest").agg(F.sum("n").alias("n"), *[F.array(*[f(F.col(c)[j]) for j in range(len(points))]).alias(c) for f, c in ((F.min, "least"), (F.max, "most"))])
    cells_ = sorted(merged.collect(), key=lambda r: r.nearest)  # a row for each pivot
    least, most_ = (np.array([r[c] for r in cells_]).reshape(len(cells_), len(points)) for c in ("least", "most"))
    n_blocks = {r.nearest: -(-r.n // ROWS) for r in cells_}
    left_blocks = max(1, -(-wanted.count() // ANCHORS))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = matrix(batch.column("whole"), width)
            low_, high_ = pivots.value.bracket(lead, pivots.value.of(lead, True), least, most_)
            to = []
            for i, told in enumerate(batch.column("positives").to_pylist()):
                p = [x["score"] for x in told]
                fits = (high_[i] >= low * min(p) / 100) & (low_[i] <= high * max(p) / 100)
                to.append([{"nearest": r.nearest, "right_block": b} for r, fit in zip(cells_, fits, strict=True) if fit for b in range(n_blocks[r.nearest])])
            columns = [batch.column(c) for c in ("vec_id", "label", "key", "whole", "positives")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(to, pa.list_(pa.struct([("nearest", pa.int32()), ("right_block", pa.int64())])))], ["vec_id", "label", "key", "whole", "positives", "to"])

    ranged = anchors.join(wanted.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_key").alias("key"), "positives"), ["vec_id", "key"]).select("vec_id", "label", "key", "whole", "positives")
    told_type = "array<struct<place:int,positive_id:bigint,score:bigint>>"
    routed = ranged.mapInArrow(route, f"vec_id bigint, label {label_type}, key bigint, whole binary, positives {told_type}, to array<struct<nearest:int,right_block:bigint>>")
    left = routed.select("vec_id", "label", "key", "whole", "positives", F.pmod("key", F.lit(left_blocks)).alias("left_block"), F.inline("to"))
    many = F.element_at(F.create_map(*[F.lit(x) for j, n in n_blocks.items() for x in (j, n)]), F.col("nearest")) if n_blocks else F.lit(1)
    right = table.select("vec_id", "label", "key", "whole", "distances", "nearest", F.pmod("key", many).cast("bigint").alias("right_block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(left_blocks - 1).cast("bigint"))).alias("left_block"))
    cells = ["nearest", "right_block", "left_block"]
    found = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(hard, "anchor_id bigint, anchor_key bigint, place int, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "anchor_key", "place").orderBy(F.desc("negative_score"), "negative_id")))
    return ranked.where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
