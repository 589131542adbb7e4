"""Substring dedup: Rabin-Karp hashes of every window of `width` words, counted in Spark, merged into removal intervals."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from citeproof.llm.exchange import KEY, chunked, earlier_elsewhere, measured, places
from citeproof.llm.words import slices, string_buffers, window_hashes, word_hashes

WIDTH = 50
DOCS_PER_CHUNK = 512
#: Bytes of input for each bucket of hashes, and bytes of text that are hashed at once.
BYTES_PER_BUCKET, BYTES_AT_ONCE = 2 << 20, 2 << 20


class _Chunk:
    """The windows of a chunk's documents, in the order of doc_id; documents without an id have no windows."""

    def __init__(self, group: pa.Table, width: int):
        group = group.sort_by("doc_id")
        ids = group.column("doc_id")
        self.column_ids = ids
        self.known = len(ids) - ids.null_count
        self.ids = ids.fill_null(0).to_numpy().astype(np.int64)
        self.data, self.offsets = string_buffers(group.column("text"))
        hashes, firsts, self.words, done = [], [], np.zeros(len(self.ids) + 1, np.int64), 0
        for a, b in slices(self.offsets, BYTES_AT_ONCE):
            lo, hi = self.offsets[a], self.offsets[b]
            tokens, bounds = word_hashes(self.data[lo:hi], self.offsets[a : b + 1] - lo)
            self.words[a : b + 1] = bounds + done
            if a < self.known:
                h, starts = window_hashes(tokens, bounds[: min(b, self.known) - a + 1], width)
                hashes.append(h)
                firsts.append(starts + done)
            done += len(tokens)
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.firsts = np.concatenate([np.zeros(0, np.int64), *firsts])
        self.order = np.argsort(self.hashes, kind="stable")
        ranked = self.hashes[self.order]
        self.new = np.ones(len(ranked), bool)
        self.new[1:] = ranked[1:] != ranked[:-1]
        self.keys = ranked[self.new]

    def removed_words(self, elsewhere: np.ndarray, width: int) -> np.ndarray:
        """For each word whether a window covers it that starts in a document with a smaller id."""
        owner = self.ids[np.searchsorted(self.words, self.firsts[self.order], "right") - 1]
        group = np.cumsum(self.new) - 1
        late = owner > owner[self.new][group] if len(group) else np.zeros(0, bool)
        hit = np.zeros(len(self.keys), bool)
        hit[elsewhere] = True
        late |= hit[group]
        starts = self.firsts[self.order[late]]
        steps = np.zeros(int(self.words[-1]) + 1, np.int32)
        np.add.at(steps, starts, 1)
        np.subtract.at(steps, starts + width, 1)
        return np.cumsum(steps)[:-1] > 0


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, docs_per_chunk: int = DOCS_PER_CHUNK, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, spans (removed [from, to) word places), and kept_text on request.

    A word goes if a window of `width` words that covers it also starts in a document with a smaller id. Windows are
    told apart by 64-bit hashes. Null and empty texts have no words; rows without an id are never changed and change
    nothing; rows with equal ids are not earlier than each other; only the two named columns are read.
    """
    sizes = measured(docs, id_col, text_col)
    chunks = chunked(docs, id_col, text_col, docs_per_chunk, sizes)
    buckets = sizes.buckets(BYTES_PER_BUCKET)
    replies = earlier_elsewhere(chunks, lambda group: _Chunk(group, width).keys, buckets)

    def finish(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return schema.empty_table()
        chunk = _Chunk(group, width)
        removed = chunk.removed_words(places(answers), width)
        out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "spans", "kept_text")}
        whole = chunk.data.tobytes()
        for i in range(len(chunk.ids)):
            words = whole[chunk.offsets[i] : chunk.offsets[i + 1]].split()
            gone = removed[chunk.words[i] : chunk.words[i + 1]]
            n = int(gone.sum())
            edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist() if n else []
            kept = b" ".join(compress(words, ~gone) if n else words)
            for k, v in zip(out, (len(words), n, hashlib.sha256(kept).hexdigest(), list(map(list, zip(edges[::2], edges[1::2], strict=True))), kept.decode()), strict=True):
                out[k].append(v)
        return pa.table([chunk.column_ids, *(pa.array(out[f.name], f.type) for f in list(schema)[1:])], schema=schema)

    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64()))), *[("kept_text", pa.string())] * with_text]
    schema = pa.schema(fields)
    ddl = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<array<bigint>>" + ", kept_text string" * with_text
    return chunks.groupBy(*KEY).cogroup(replies.groupBy(*KEY)).applyInArrow(finish, ddl)
