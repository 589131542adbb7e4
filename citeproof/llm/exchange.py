"""Which keys of a chunk of documents also stand in an earlier chunk, without ever gathering a key's occurrences.

Documents are dealt to chunks by ranges of doc_id, so a smaller chunk holds smaller ids. Each chunk sends each of its
distinct 64-bit keys once, packed by bucket; the task of a bucket sees a key at most once per chunk, however many
documents hold it, and answers a chunk only about keys that an earlier chunk holds.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeproof.llm.runtime import cut, power_of_two

#: A chunk is told by its place in the order of ids, and by a part where rows of one id (or none) are too many for a task.
CHUNK, PART = "_chunk", "_part"
KEY = [CHUNK, PART]
KEY_DDL = f"{CHUNK} bigint, {PART} bigint"
#: A chunk with so many times the rows or bytes asked for is dealt anew; so many at most are broadcast for that.
HEAVY, FEW = 4, 20_000
#: Bytes of a chunk's texts, beyond which it is dealt anew as well, and the most buckets of keys.
BYTES_PER_CHUNK, MOST_BUCKETS = 16 << 20, 1 << 30
_NO_ID = -(2**63)


class Sizes(NamedTuple):
    """What is counted of documents before they are dealt: the smallest and largest id, rows with an id, and bytes of all texts."""

    low: int
    high: int
    n: int
    n_bytes: int

    def buckets(self, bytes_per_bucket: int) -> int:
        """How many buckets take keys of so many bytes of text each: a power of two, and never more than a task number holds."""
        return power_of_two(self.n_bytes / bytes_per_bucket, 16, MOST_BUCKETS)


def measured(docs: DataFrame, id_col: str, text_col: str) -> Sizes:
    """Counted, as the optimizer's estimate of rows from joins or from the driver may be off by any factor."""
    i = F.col(id_col).cast("bigint")
    low, high, n, n_bytes = docs.agg(F.min(i), F.max(i), F.count(i), F.sum(F.octet_length(text_col))).first()
    return Sizes(low or 0, high or 0, n, n_bytes or 0)


def chunked(docs: DataFrame, id_col: str, text_col: str, docs_per_chunk: int, sizes: Sizes | None = None, bytes_per_chunk: int = BYTES_PER_CHUNK) -> DataFrame:
    """(doc_id, text, _chunk, _part). Chunks are ranges of ids, of about docs_per_chunk rows however the ids lie, and of
    no more than a few times bytes_per_chunk of text.

    Ids are cut into equal ranges first; ranges that hold too many rows or bytes, as ids stand close together or texts are
    long, are cut again by their own bounds. Rows of one id are parted by their texts, rows without an id by their place in
    the input. What can't be parted is one text, and texts that are equal under one id.
    """
    low, high, n, n_bytes = sizes or measured(docs, id_col, text_col)
    i = F.col(id_col).cast("bigint")
    ids = docs.select(i.alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("size")).where("id is not null")
    # A chunk is as full as its rows or its bytes make it; fullness 1 is what was asked for.
    per_id = max(n / docs_per_chunk, n_bytes / bytes_per_chunk, 1) / (high - low + 1)
    span = F.lit(min(2**62, max(1, int(1 / per_id)))).cast("bigint")
    full = F.ceil(F.greatest(F.count("*") / docs_per_chunk, F.sum("size") / bytes_per_chunk))

    def start(x: Column, lo: Column, width: Column) -> Column:
        # In decimals, as the distance of two ids may be over a bigint's.
        return x - ((x.cast("decimal(38,0)") - lo.cast("decimal(38,0)")) % width.cast("decimal(38,0)")).cast("bigint")

    cells = ids.select("id", "size", start(F.col("id"), F.lit(low).cast("bigint"), span).alias(CHUNK))
    splits, one = [], F.lit(1).cast("bigint")
    while True:
        counted = cells.groupBy(CHUNK).agg(full.alias("n"), F.count("*").alias("rows"), F.min("id").alias("lo"), F.max("id").alias("hi"))
        # A document alone is as large as it is.
        counted = counted.where((F.col("n") > HEAVY) & (F.col("rows") > 1))
        width = F.greatest(F.lit(1), F.expr(f"cast(least((cast(hi as decimal(38,0)) - lo + 1) div n, {2**62}) as bigint)"))
        heavy = cut(counted.select(CHUNK, F.col("lo").alias("_lo"), width.alias("_width"), F.when(F.col("lo") == F.col("hi"), F.col("n")).otherwise(one).cast("bigint").alias("_parts")))
        many = heavy.count()
        if many:
            splits.append(F.broadcast(heavy) if many <= FEW else heavy)
        if heavy.where("_parts = 1").isEmpty():
            break
        cells = _split(cells, splits[-1], "id", start)
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), start(i, F.lit(low).cast("bigint"), span).alias(CHUNK), F.lit(0).cast("bigint").alias(PART))
    for heavy in splits:
        out = _split(out, heavy, "doc_id", start, F.xxhash64("text"))
    no_id = F.col("doc_id").isNull()
    return out.withColumns({CHUNK: F.when(no_id, F.lit(_NO_ID)).otherwise(F.col(CHUNK)), PART: F.when(no_id, F.expr(f"monotonically_increasing_id() div {docs_per_chunk}")).otherwise(F.col(PART))})


def _split(rows: DataFrame, heavy: DataFrame, id_col: str, start: Callable, salt: Column | None = None) -> DataFrame:
    joined = rows.join(heavy, CHUNK, "left")
    new = {CHUNK: F.when(F.col("_lo").isNotNull(), start(F.col(id_col), F.col("_lo"), F.col("_width"))).otherwise(F.col(CHUNK))}
    if salt is not None:
        new[PART] = F.when(F.col("_parts") > 1, F.pmod(salt, F.col("_parts"))).otherwise(F.col(PART))
    return joined.withColumns(new).drop("_lo", "_width", "_parts").select(rows.columns)


def key_columns(key: tuple, n: int) -> dict[str, pa.Array]:
    return {c: pa.array([k] * n, pa.int64()) for c, k in zip(KEY, key, strict=True)}


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as planes of bytes, the highest first: planes of slowly rising bytes compress well."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(">u8").reshape(-1).astype(np.uint64)


def late_of(order: np.ndarray, new: np.ndarray, owner_chunk: np.ndarray) -> np.ndarray:
    """Of entries in order, in classes that begin where new says, those whose chunk is after the first chunk of their class."""
    if not len(order):
        return order
    chunk = owner_chunk[order]
    starts = np.flatnonzero(new)
    return order[chunk > np.minimum.reduceat(chunk, starts)[np.cumsum(new) - 1]]


def earlier_elsewhere(chunks: DataFrame, keys_of: Callable[[pa.Table], np.ndarray], buckets: int, any_other: bool = False) -> DataFrame:
    """(chunk, part, at): for each chunk the places, in the sorted distinct keys that keys_of gives for it, of keys that an earlier chunk has too.

    any_other: of keys that any other chunk has, so that the earliest is told as well.
    """
    bits = buckets.bit_length() - 1

    def send(key: tuple, group: pa.Table) -> pa.Table:
        keys = keys_of(group)
        of = (keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)).astype(np.int64)
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        ends = np.append(starts[1:], len(keys))[: len(starts)]
        return pa.table(
            {
                "bucket": pa.array(of[starts], pa.int64()),
                **key_columns([k.as_py() for k in key], len(starts)),
                "base": pa.array(starts, pa.int32()),
                "packed": pa.array([_pack(keys[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()),
            }
        )

    def answer(group: pa.Table) -> pa.Table:
        parts = [_unpack(x.as_py()) for x in group.column("packed")]
        sizes = np.array([len(x) for x in parts])
        keys = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts)), sizes)
        place = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(group.column("base").to_numpy(), sizes)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        if any_other:
            late = order[~(new & np.append(new[1:], True))]
        else:
            late = late_of(order, new, group.column(CHUNK).to_numpy()[owner])
        late.sort()
        return told(group, owner, place, late)

    sent = chunks.groupBy(*KEY).applyInArrow(send, f"bucket bigint, {KEY_DDL}, base int, packed binary")
    return sent.groupBy("bucket").applyInArrow(answer, f"{KEY_DDL}, at binary")


def told(group: pa.Table, owner: np.ndarray, place: np.ndarray, late: np.ndarray) -> pa.Table:
    """The answer to each row of group about its places among late, which is sorted by owner."""
    edges = np.searchsorted(owner[late], np.arange(group.num_rows + 1))
    full = np.flatnonzero(edges[1:] > edges[:-1])
    columns = {c: group.column(c).take(pa.array(full)) for c in KEY}
    return pa.table({**columns, "at": pa.array([place[late[edges[i] : edges[i + 1]]].astype(np.uint32).tobytes() for i in full], pa.binary())})


def places(replies: pa.Table) -> np.ndarray:
    """All places of a chunk's answers, in one array."""
    return np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x.as_py(), np.uint32) for x in replies.column("at"))])
