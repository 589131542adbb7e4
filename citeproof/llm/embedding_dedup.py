"""Embedding near-dedup by a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors. Each vector is described by its NEAREST nearest pivots in
order; the inverted list of a pivot holds the vectors that name it. Pairs of a list that share SHARED pivots or more are
candidates, and each is verified once, at the first pivot that both name, by its cosine in double precision. A list of
more than TILE vectors is cut into blocks that are compared two by two in tasks of their own; no pair leaves a task, only
counts and a spanning forest of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeproof.llm.components import components
from citeproof.llm.runtime import cut, power_of_two

COSINE = 0.93
#: Pivots that describe a vector, how many two vectors must share, vectors of a block, and the least and most pivots:
#: about twice the square root of the vectors, so that lists grow as the square root too.
NEAREST, SHARED, TILE, FEWEST, MOST = 12, 2, 1024, 64, 4096
#: Sampled vectors a pivot, and how near each other (by cosine) pivots may be: the later bounds count only where the
#: earlier ones leave too few, as when the vectors lie in a few clusters.
DRAWN, NEAR = 4, (0.6, 0.75, 0.88)


def _matrix(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision with length 1; None for null, empty and zero vectors and those with null or non-finite components."""
    out: list[np.ndarray | None] = []
    for i in range(len(column)):
        v = column[i].values if column[i].is_valid else None
        x = np.asarray(v.to_numpy(zero_copy_only=False), np.float64) if v is not None and len(v) and not v.null_count else np.zeros(0)
        top = np.abs(x).max() if len(x) else 0.0
        out.append(x / top / np.linalg.norm(x / top) if top > 0 and np.isfinite(x).all() else None)
    return out


def describe(vectors: list[np.ndarray], pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The places of the nearest pivots in order of nearness. Vectors are padded or cut to the pivots' length for this alone."""
    width = pivots.shape[1]
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, : min(width, len(v))] = v[:width]
    near = -(x @ pivots.T)
    k = min(nearest, len(pivots))
    some = np.argpartition(near, k - 1, axis=1)[:, :k]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)


def apart(drawn: np.ndarray, wanted: int) -> np.ndarray:
    """Of the drawn vectors, in order, `wanted` that aren't near an earlier one: a large group of near copies must not fill
    the pivots, or its members would be told apart by which of them is nearest. What few tight clusters leave under FEWEST
    is made up by directions of chance, which every vector has an order of nearness to as well."""
    kept: list[int] = []
    most = np.zeros(len(drawn))
    for bound in NEAR:
        for i in range(len(drawn)):
            if len(kept) < wanted and most[i] <= bound:
                kept.append(i)
                most = np.maximum(most, np.abs(drawn @ drawn[i]))
    more = np.random.Generator(np.random.PCG64(11)).normal(size=(max(0, FEWEST - len(kept)), drawn.shape[1]))
    return np.concatenate([drawn[kept], more / np.linalg.norm(more, axis=1, keepdims=True)])


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> dict[int, int]:
    """For rows with links the smallest id of their component, from the adjacency of rows left against rows right."""
    parent = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in np.flatnonzero(near.any(axis=1)).tolist():
        a = find(int(left[i]))
        for j in set(right[near[i]].tolist()):
            b = find(int(j))
            if a != b:
                if ids[b] < ids[a]:
                    a, b = b, a
                parent[b] = a
    return {x: find(x) for x in list(parent)}


def _compare(group: pa.Table, cosine: float, shared: int) -> pa.Table:
    """(k1, k2, vec_id, n, root) of the classes of one tile that have links in it."""
    pivot, i, j = (group.column(c)[0].as_py() for c in ("pivot", "i", "j"))
    vectors = np.stack(group.column("unit").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1))
    named = group.column("pivots").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
    ids, weights, block = (group.column(c).to_numpy() for c in ("vec_id", "members", "block"))
    local, where = np.unique(named, return_inverse=True)
    hot = np.zeros((len(ids), len(local)), np.float32)
    np.put_along_axis(hot, where.reshape(named.shape), 1, 1)
    earlier = hot[:, : np.searchsorted(local, pivot)]
    right = np.flatnonzero(block == j)
    lefts = np.flatnonzero(block == i)
    n, roots = np.zeros(len(ids), np.int64), {}
    for a in range(0, len(lefts), TILE):
        left = lefts[a : a + TILE]
        near = (vectors[left] @ vectors[right].T >= cosine) & (hot[left] @ hot[right].T >= shared) & (earlier[left] @ earlier[right].T == 0)
        if i == j:
            near &= left[:, None] != right[None, :]
        n[left] += near @ weights[right]
        if i != j:
            n[right] += near.T @ weights[left]
        for x, root in _forest(near, left, right, ids).items():
            roots.setdefault(x, []).append(root)
    rows = [(x, r) for x, found in roots.items() for r in found]
    first = set()
    keep = np.array([x for x, _ in rows], np.int64)
    counts = [0 if x in first or first.add(x) else int(n[x]) for x, _ in rows]
    columns = {c: group.column(c).take(pa.array(keep)) for c in ("k1", "k2", "vec_id")}
    return pa.table({**columns, "n": pa.array(counts, pa.int64()), "root": pa.array([int(ids[r]) for _, r in rows], pa.int64())})


def dedup_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine is at least `cosine`.
    Null, empty and zero vectors, vectors with null or non-finite components, and rows without an id or a label link
    with nothing. Equal vectors of a label are one class with a weight. Rows with equal ids count each as a vector.
    """
    named = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    named = named.withColumns({"k1": F.xxhash64("label", "vector"), "k2": F.xxhash64(F.lit(1), "vector", "label"), "able": F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()})
    able = named.where("able")
    classes = able.groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("members"), F.first("label").alias("label"), F.first("vector").alias("vector"))

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _matrix(batch.column("vector"))
            good = [k for k, u in enumerate(units) if u is not None]
            rest = batch.drop_columns(["vector"]).take(pa.array(good, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([units[k] for k in good], pa.list_(pa.float64()))], [*rest.schema.names, "unit"])

    label_type = dict(named.dtypes)["label"]
    scaled = cut(classes.mapInArrow(scale, f"k1 bigint, k2 bigint, vec_id bigint, members bigint, label {label_type}, unit array<double>"))
    n_pivots = power_of_two(2 * scaled.count() ** 0.5, FEWEST, MOST)
    sample = [r.unit for r in scaled.orderBy(F.xxhash64("k1"), "k2").limit(DRAWN * n_pivots).select("unit").collect()]
    width = max(map(len, sample), default=1)
    pivots = np.array([[*x, *[0.0] * (width - len(x))] for x in sample]).reshape(len(sample), width)
    pivots = apart(pivots, n_pivots)
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = [np.asarray(x) for x in batch.column("unit").to_pylist()]
                near = describe(units, sent.value, nearest)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], [*batch.schema.names, "pivots"])

    if not len(sample):
        return named.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    indexed = cut(scaled.mapInArrow(index, f"k1 bigint, k2 bigint, vec_id bigint, members bigint, label {label_type}, unit array<double>, pivots array<int>").withColumn("width", F.size("unit")))
    listed = indexed.select("k1", "k2", "label", "width", F.explode("pivots").alias("pivot"))
    lists = ["label", "width", "pivot"]
    long = listed.groupBy(*lists).agg(F.count("*").alias("n")).where(F.col("n") > TILE).withColumn("blocks", F.ceil(F.col("n") / TILE).cast("int")).drop("n").repartition(F.xxhash64(*lists))
    split = listed.join(long, lists, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("k1", "k2"), F.col("blocks")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j")))
    placed = split.withColumn("tile", F.explode(tiles)).select("k1", "k2", "pivot", "block", "tile.i", "tile.j")
    rows = placed.join(indexed.repartition(F.xxhash64("k1")), ["k1", "k2"]).select(*lists, "i", "j", "block", "k1", "k2", "vec_id", "members", "unit", "pivots")
    found = cut(rows.groupBy(*lists, "i", "j").applyInArrow(lambda g: _compare(g, cosine, shared), "k1 bigint, k2 bigint, vec_id bigint, n bigint, root bigint"))
    labels = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("k1", "k2").agg(F.sum("n").alias("n"))
    ids = scaled.select("k1", "k2", "vec_id", "members").join(linked, ["k1", "k2"], "left").join(labels.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    result = ids.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).repartition(F.xxhash64("k2"))
    out = able.select("vec_id", "k1", "k2").join(result, ["k1", "k2"], "left").select("vec_id", "n_links", "component_id")
    out = out.unionByName(named.where("not able").select("vec_id", F.lit(None).cast("bigint").alias("n_links"), F.lit(None).cast("bigint").alias("component_id")))
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
