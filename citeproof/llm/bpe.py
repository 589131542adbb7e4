"""Byte-level BPE over length-bucketed padded matrices: each round every row merges its leftmost pair of least rank.

Pairs are looked up in an open-addressing hash table held in numpy arrays. Rows that have no pair left leave the matrix.
Pieces are merged once per worker and remembered, up to a bound.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Cells of a matrix, the longest piece (bytes) that goes into one, and how many merged pieces a worker remembers.
CELLS, LONGEST, REMEMBERED = 1 << 18, 2048, 400_000
#: Characters of text whose pieces are merged together.
TEXT_AT_ONCE = 2 << 20
_NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> merged id, by multiplicative hashing with linear probing, for whole arrays of pairs."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (2 * len(pairs)).bit_length() + 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ids = np.full(1 << self.bits, _NONE, np.int32)
        left = np.array([k[0] for k in pairs], np.int64)
        right = np.array([k[1] for k in pairs], np.int64)
        keys, ids = left << 32 | right, np.array(list(pairs.values()), np.int32)
        at, self.probes = self._slot(keys), 1
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == -1
            slots, winner = np.unique(at[todo[free]], return_index=True)
            won = todo[free][winner]
            self.keys[slots], self.ids[slots] = keys[won], ids[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(todo))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merged pairs; the largest int32 where there is none. Negative ids pair with nothing."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.ids[at], _NONE)
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.ids[at[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out


class Codec:
    """Encoder and decoder for one vocabulary of ranks, given as the lines of a .tiktoken file."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.texts = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self.texts[v] = k
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {(self.ranks[t[:i]], self.ranks[t[i:]]): r for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        self.table = PairTable(self.pairs)
        self.pieces = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def _matrix(self, rows: list[bytes], width: int) -> list[np.ndarray]:
        """Merged ids of each row; no row is longer than width."""
        sizes = np.array([len(x) for x in rows])
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.bytes[np.frombuffer(b"".join(rows), np.uint8)]
        ranks = np.full((len(rows), width), _NONE, np.int32)
        ranks[:, :-1] = self.table.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        who, out, columns = np.arange(len(rows)), [np.zeros(0, np.int32)] * len(rows), np.arange(width)
        while len(who):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(who)), at]
            done = best == _NONE
            if done.any():
                for i in np.flatnonzero(done).tolist():
                    out[who[i]] = ids[i, : sizes[i]]
                go = ~done
                who, ids, ranks, sizes, at, best = who[go], ids[go], ranks[go], sizes[go], at[go], best[go]
                if not len(who):
                    break
                if 2 * (most := int(sizes.max())) <= ids.shape[1]:
                    ids, ranks, columns = ids[:, :most].copy(), ranks[:, :most].copy(), np.arange(most)
            wide, row = ids.shape[1], np.arange(len(who))
            shift = np.minimum(columns + (columns > at[:, None]), wide - 1)
            ids, ranks = np.take_along_axis(ids, shift, 1), np.take_along_axis(ranks, shift, 1)
            ids[row, at] = best
            sizes = sizes - 1
            ids[row, sizes] = -1
            ranks[row, sizes] = _NONE
            after = np.where(at + 1 < sizes, ids[row, np.minimum(at + 1, wide - 1)], -1)
            ranks[row, at] = self.table.find(best, after)
            back = np.flatnonzero(at > 0)
            ranks[back, at[back] - 1] = self.table.find(ids[back, at[back] - 1], best[back])
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        """The same merges for one very long piece, kept in a heap by rank and place, so that time stays near its length."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or self.pairs.get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (x := self.pairs.get((r, ids[after[j]]))) is not None:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := self.pairs.get((ids[before[i]], r))) is not None:
                heapq.heappush(heap, (x, before[i]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def merge(self, pieces: Iterable[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
        """Each piece with its ids: whole pieces of the vocabulary as they are, others bucketed by length."""
        buckets: dict[int, list[bytes]] = {}
        for piece in pieces:
            if (whole := self.ranks.get(piece)) is not None:
                yield piece, np.array([whole], np.int32)
            elif len(piece) > LONGEST:
                yield piece, self._long(piece)
            else:
                n = len(piece)
                buckets.setdefault(n if n <= 16 else -(-n // 8) * 8 if n <= 64 else 1 << (n - 1).bit_length(), []).append(piece)
        for width, rows in sorted(buckets.items()):
            step = max(1, CELLS // width)
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                yield from zip(part, self._matrix(part, width), strict=True)

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers. Pieces that are new to several texts are merged together."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(self.pieces.findall(text))
            size += len(text)
            if size >= TEXT_AT_ONCE:
                yield from self._joined(group)
                group, size = [], 0
        yield from self._joined(group)

    def _joined(self, group: list[list[str]]) -> Iterator[bytes]:
        wanted = set().union(*group)
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = wanted
        raw = {x.encode(): x for x in new}
        for piece, ids in self.merge(raw):
            self.known[raw[piece]] = ids.astype("<u4").tobytes()
        for pieces in group:
            yield b"".join(map(self.known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(vocabulary: bytes, pattern: str) -> Codec:
    """The worker's codec for this vocabulary; made once, with what it remembers."""
    kept = sys.__dict__.setdefault("_bpe_codecs", {})
    key = hashlib.sha256(vocabulary + pattern.encode()).digest()
    if key not in kept:
        kept.clear()
        kept[key] = Codec(vocabulary, pattern)
    return kept[key]


def encode_decode(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (of little-endian uint32 ids), decoded_sha256, ids on request, and the columns to keep.

    Texts are cut by the pattern and every match is encoded by itself, without special tokens; a null text counts as
    empty. The vocabulary file is read on the driver and sent to the executors once; its size is fixed. Only the named
    columns are read; every row gives a row, also repeated ones and those without an id.
    """
    with open(vocabulary_path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary.value, pattern)
        for batch in batches:
            texts = batch.column(1)
            n, first, second, kept = [], [], [], []
            for ids in own.encode((texts[i].as_py() or "" for i in range(len(texts)))):
                n.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(np.frombuffer(ids, "<u4").astype(np.int64))
            columns = [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(kept, pa.list_(pa.int64()))] * with_ids, *batch.columns[2:]], names)

    types = dict(docs.dtypes)
    ddl = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * with_ids + "".join(f", `{c}` {types[c]}" for c in keep)
    return docs.select(id_col, text_col, *keep).mapInArrow(run, ddl)
