"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

A document's ids are cut into whole sequences first, which are full by themselves; what is left over, always shorter than a
sequence, is dealt to groups at random and packed there. Sequences that are still open are closed at last by cutting the
emptiest of them to fill the gaps of the others, and the one that stays into lengths that need no padding.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeproof.llm.words import slices, string_buffers

LENGTH, END_ID, DOCS_PER_GROUP = 2048, 1, 2048
#: Tasks at most; a task packs one group after another.
MOST_TASKS = 20_000
TEXT_AT_ONCE = 1 << 20
#: The pattern that byte-level pre-tokenizers cut by.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_BLANK = re.compile(r"\s{1000}")
_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class Ids:
    """The ids of texts by a tokenizer file, without special tokens: strings of special tokens are ordinary text.

    Where the file is plain byte-level BPE, its merges in the order of their ids, tiktoken merges by these ranks, several
    times as fast with the same ids; other files, and texts with very long white space, go through tokenizers.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.encode_special_tokens = True
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.fast = self._fast(json.loads(file))

    @staticmethod
    def _fast(file: dict):
        model, before = file["model"], file.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and file.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        # Bytes that print stand for themselves, the others for the characters from 256 on.
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        vocabulary, special = model["vocab"], {x["content"] for x in file.get("added_tokens", [])}
        merges = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        if merges != list(range(256, 256 + len(merges))) or sorted(vocabulary.get(c, -1) for c in byte) != list(range(256)):
            return None
        import tiktoken

        ranks = {bytes(byte[c] for c in k): i for k, i in vocabulary.items() if k not in special}
        return tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        """As little-endian unsigned 32-bit integers."""
        if self.fast is None or _LONG_BLANK.search(text):
            ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        else:
            ids = self.fast(text)
        return np.array(ids, "<u4").tobytes()


def _ids(file: str) -> Ids:
    """The worker's own, made once for a tokenizer file."""
    kept = sys.__dict__.setdefault("_packing_ids", {})
    key = hash(file)
    if key not in kept:
        kept.clear()
        kept[key] = Ids(file)
    return kept[key]


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of the items' places, each item in the first bin with room for it, the largest first; of equals the first.

    The tree's leaves are the room of all bins that may be opened; an inner node holds the most of its two, so the first
    bin with enough room is found by one walk from the root.
    """
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, node = sizes[item], 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        if node - leaves == len(bins):
            bins.append([])
        bins[node - leaves].append(item)
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins


def without_padding(bins: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """The bins of pieces (item, start, length), none of which needs padding any more.

    A bin needs none if its length is the capacity or a power of two. Of the others the emptiest is taken apart to fill
    the gaps of the fullest, until one is left; that one is cut into powers of two.
    """
    load = lambda b: sum(p[2] for p in b)
    full = lambda n: n == capacity or n & (n - 1) == 0
    done = [b for b in bins if full(load(b))]
    rest = sorted((list(b) for b in bins if not full(load(b))), key=load, reverse=True)

    def take(source: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
        """Pieces of n ids in all from the end of source."""
        out = []
        while n:
            item, start, length = source.pop()
            k = min(n, length)
            if k < length:
                source.append((item, start, length - k))
            out.append((item, start + length - k, k))
            n -= k
        return out

    at = 0
    while at < len(rest) - 1:
        gap = capacity - load(rest[at])
        while gap and at < len(rest) - 1:
            n = min(gap, load(rest[-1]))
            rest[at] += take(rest[-1], n)
            gap -= n
            if not rest[-1]:
                rest.pop()
        if not gap:
            done.append(rest[at])
            at += 1
    for left in rest[at:]:
        while n := load(left):
            done.append(take(left, 1 << (n.bit_length() - 1)) if n < capacity else take(left, capacity))
    return done


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, docs_per_group: int = DOCS_PER_GROUP, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the piece's ids on request.

    A document's ids are those of the tokenizer file, then `end_id`; doc_tokens counts them all. Every id lies in one
    piece, at its document's places from start and at its sequence's places from offset. A sequence holds `length` ids or a power of two, so that none needs padding. A null or empty
    text has the one id end_id. Every row is a document, also repeated ones and those without an id; an empty table has
    no pieces. Only the two named columns are read. The same table gives the same sequences again.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    # Far fewer tasks than groups would do, but for the largest tables a group is a task.
    tasks = max(1, min(-(-docs.count() // docs_per_group), MOST_TASKS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document's whole sequences, and what is left over with its ids."""
        ids = _ids(vocabulary.value)
        end = np.array([end_id], "<u4").tobytes()
        kind = "<u4" if ids.wide else "<u2"
        for batch in batches:
            _, offsets = string_buffers(pa.chunked_array([batch.column(1)]))
            for a, b in slices(offsets, TEXT_AT_ONCE):
                names, part = batch.column(0).slice(a, b - a).to_pylist(), [x or "" for x in batch.column(1).slice(a, b - a).to_pylist()]
                rows: list[tuple] = []
                for doc, text in zip(names, part, strict=True):
                    found = ids.encode(text) + end
                    n, whole = len(found) // 4, len(found) // 4 // length
                    for k in range(whole):
                        piece = found[4 * k * length : 4 * (k + 1) * length]
                        rows.append((doc, k * length, length, zlib.crc32(piece), n, np.frombuffer(piece, "<u4").astype(kind).tobytes() if with_ids else None))
                    if n > whole * length:
                        piece = found[4 * whole * length :]
                        rows.append((doc, whole * length, n - whole * length, zlib.crc32(piece), n, np.frombuffer(piece, "<u4").astype(kind).tobytes()))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    schema = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), *[("ids", pa.list_(pa.int64()))] * with_ids]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype("<u4" if _ids(vocabulary.value).wide else "<u2")
        sequence = TaskContext.get().partitionId() << 40
        over: list[dict] = []

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])

        def whole(r: dict, number: int) -> tuple:
            return (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], number, 0, *([np.frombuffer(r["ids"], kind).astype(np.int64)] if with_ids else []))

        def close(group: list[dict], sequence: int) -> tuple[list[tuple], int]:
            bins = first_fit_decreasing([r["length"] for r in group], length)
            rows = []
            for bin_ in without_padding([[(i, 0, group[i]["length"]) for i in b] for b in bins], length):
                offset = 0
                for i, start, n in bin_:
                    r = group[i]
                    ids = np.frombuffer(r["ids"], kind)[start : start + n]
                    crc = r["ids_crc32"] if n == r["length"] else zlib.crc32(ids.astype("<u4").tobytes())
                    rows.append((r["doc_id"], r["start"] + start, n, crc, r["doc_tokens"], sequence, offset, *[ids.astype(np.int64)] * with_ids))
                    offset += n
                sequence += 1
            return rows, sequence

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["length"] == length:
                    rows.append(whole(r, sequence))
                    sequence += 1
                    continue
                over.append(r)
                if len(over) == docs_per_group:
                    more, sequence = close(over, sequence)
                    rows += more
                    over = []
            if rows:
                yield table(rows)
        if over:
            yield table(close(over, sequence)[0])

    # Dealt in turn, so that no key makes a task large. Sorted by a hash, which is the random order that groups follow each
    # other in, and the same one when a lost task runs again.
    pieces = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_col).mapInArrow(cut, f"{_DDL}, ids binary")
    dealt = pieces.repartition(tasks).sortWithinPartitions(F.xxhash64("doc_id", "start", "ids_crc32"), "doc_id", "start", "ids")
    return dealt.mapInArrow(pack, f"{_DDL}, sequence_id bigint, offset bigint" + ", ids array<bigint>" * with_ids)
