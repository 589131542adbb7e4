"""Suffix-array dedup: shards' Burrows-Wheeler transforms are merged by refining their interleave.

A shard is a chunk of documents. Of its `depth`-byte strings those that may repeat elsewhere, one of each, are put in
suffix order as pieces of text that end with a terminator each, and the shard sends the transform of these pieces. A shard
sorts each place once: the ends of pieces find theirs by how many bytes neighbours have in common. A merge
inverts the transforms, which gives every shard's suffixes in their order without sorting them: the orders start one
behind another, and each round refines the blocks that still hold several suffixes by the next symbol of 8 bytes. The first
round merges sorted runs; blocks of one suffix, and blocks whose suffixes agree, cost no more. The round in which two
neighbours part gives their common prefix, and blocks that never part are the repeated intervals.

Suffixes that can't repeat never leave their shard: a string of `depth` bytes holds a least GRAM-byte hash (its anchor),
equal strings hold equal anchors, and only anchors that stand in several places are looked at. The anchor also deals
pieces to buckets, each of which is merged by itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeproof.llm.exchange import CHUNK, KEY, KEY_DDL, chunked, earlier_elsewhere, key_columns, late_of, measured, places, told
from citeproof.llm.words import INVERSE, mix, powers, slices, string_buffers

DEPTH, GRAM, DOCS_PER_CHUNK = 100, 32, 512
BYTES_PER_BUCKET, BYTES_AT_ONCE, GRAMS_AT_ONCE = 2 << 20, 1 << 19, 1 << 15
_VALUES = np.random.Generator(np.random.PCG64(99)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of every `width` consecutive bytes, across texts too."""
    grams = np.zeros(max(len(data) - width + 1, 0), np.uint64)
    # A hash doesn't depend on its place, and what is hashed at once stays in the cache.
    for lo in range(0, len(grams), GRAMS_AT_ONCE):
        part = data[lo : lo + GRAMS_AT_ONCE + width - 1]
        n, out = len(part), grams[lo : lo + GRAMS_AT_ONCE]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[part] * powers(n), out=sums[1:])
        np.multiply(sums[width:] - sums[:-width], powers(n - width + 1, INVERSE), out=out)
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x94D049BB133111EB)
    return grams


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    n = len(a)
    blocks = np.full(-(-n // width) * width, 2**64 - 1, np.uint64)
    blocks[:n] = a
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def symbols(data: np.ndarray, more: int = 0) -> np.ndarray:
    """At every byte, and `more` places after the last, the 8 bytes from there on, as a number that orders like them; zeros
    follow the end."""
    out, n = np.concatenate([data, np.zeros(more + 7, np.uint8)]), len(data) + more
    for kind, width in ((np.uint16, 1), (np.uint32, 2), (np.uint64, 4)):
        wide = out[:-width].astype(kind)
        wide <<= kind(8 * width)
        wide |= out[width:]
        out = wide
    return out[:n]


def _by_block(block: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The order by block, then symbol; of equals any. Symbols are ranked first, so that both fit into one number."""
    order = np.argsort(symbol)
    ranked = symbol[order]
    rank = np.empty(len(symbol), np.int64)
    rank[order] = np.cumsum(np.diff(ranked, prepend=ranked[:1]) != 0)
    return np.argsort(block << 32 | rank)


def in_places(order: np.ndarray, new: np.ndarray) -> None:
    """Put equals (runs that begin where new says) in the order of their places."""
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    order[tied] = np.sort((np.cumsum(new)[tied] << 32) | order[tied]) & 0xFFFFFFFF


def _same_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of their first bytes symbols have in common."""
    differ, out = a ^ b, np.zeros(len(a), np.uint8)
    for k in range(8):
        out += differ < np.uint64(1 << 56 - 8 * k)
    return out


def interleave(data: np.ndarray, starts: np.ndarray, depth: int, merged: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the suffixes of data at starts by their first depth bytes (zeros follow the end), equals as they come in
    starts, and for each in that order whether it differs from the one before, and how many first bytes it has in common
    with that. merged: starts are sorted runs one behind another, which the first round merges.

    Of equals only the first is put in order. They are found by hashes and compared byte by byte; where these don't agree
    all are put in order.
    """
    words = symbols(data, depth)
    low = np.uint64((1 << max(20, len(starts).bit_length())) - 1)
    keys = (gram_hashes(np.append(data, np.zeros(depth, np.uint8)), depth)[starts] & ~low) | np.arange(len(starts), dtype=np.uint64)
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] ^ keys[:-1]) > low
    members = (keys & low).astype(np.int64)
    leads = np.flatnonzero(new)
    sizes = np.diff(leads, append=len(keys))
    # The class of each in starts; the first of a class is its least place there.
    of = np.empty(len(keys), np.int64)
    of[members] = np.cumsum(new) - 1
    is_first = np.zeros(len(keys), bool)
    is_first[members[leads]] = True
    others = np.flatnonzero(~is_first)
    a, b = starts[others], starts[members[leads[of[others]]]]
    # Where the places before agree as well, only the last byte is left to compare.
    head = (np.diff(a, prepend=-2) != 1) | (np.diff(b, prepend=-2) != 1)
    differ = words[a + depth - 8] != words[b + depth - 8]
    a, b = a[head], b[head]
    if differ.any() or any((words[a + at] != words[b + at]).any() for at in range(0, depth - 8, 8)):
        order, new, common = _refined(words, starts, depth, merged)
        in_places(order, new)
        return order, new, common
    firsts = np.flatnonzero(is_first)
    order, _, some = _refined(words, starts[firsts], depth, merged)
    by_order = of[firsts[order]]
    sizes = sizes[by_order]
    at = np.cumsum(sizes) - sizes
    new, common = np.zeros(len(keys), bool), np.full(len(keys), depth, np.uint8)
    new[at], common[at] = True, some
    return members[np.repeat(leads[by_order] - at, sizes) + np.arange(len(keys))], new, common


def _refined(words: np.ndarray, starts: np.ndarray, depth: int, merged: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What interleave gives, of equals any first: blocks that agree so far are sorted by their next symbols."""
    order = np.argsort(words[starts], kind="stable" if merged else "quicksort")
    first = words[starts[order]]
    new = np.ones(len(order), bool)
    new[1:] = first[1:] != first[:-1]
    common = np.zeros(len(order), np.uint8)
    common[1:] = _same_bytes(first[1:], first[:-1])
    common[~new] = depth
    active = np.flatnonzero(~(new & np.append(new[1:], True)))
    for at in range(8, depth, 8):
        if not len(active):
            break
        symbol = words[starts[order[active]] + at]
        if depth - at < 8:
            symbol &= np.uint64(2**64 - (1 << 8 * (8 - depth + at)))
        begins = new[active]
        block = np.cumsum(begins) - 1
        differs = symbol != symbol[np.flatnonzero(begins)][block]
        if not differs.any():
            continue
        mixed = np.zeros(block[-1] + 1, bool)
        mixed[block[differs]] = True
        moved = np.flatnonzero(mixed[block])
        by_symbol = _by_block(block[moved], symbol[moved])
        spots = active[moved]
        order[spots] = order[spots[by_symbol]]
        s, b = symbol[moved][by_symbol], block[moved]
        parted = np.flatnonzero((s[1:] != s[:-1]) & (b[1:] == b[:-1])) + 1
        new[spots[parted]] = True
        common[spots[parted]] = np.uint8(at) + _same_bytes(s[parted], s[parted - 1])
        active = active[~(new[active] & np.append(new, True)[active + 1])]
    return order, new, common


def terminated(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Pieces of data as symbols (a byte and 1), each ended by a terminator (0)."""
    symbol, body = np.zeros(int(lengths.sum()) + len(lengths), np.uint16), np.ones(int(lengths.sum()) + len(lengths), bool)
    body[np.cumsum(lengths + 1) - 1] = False
    symbol[body] = data.astype(np.uint16) + np.uint16(1)
    return symbol


def suffix_order(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of pieces of data, each ended by a terminator (0, below every byte), in order, and the symbols (a byte
    and 1) at every place. Equal suffixes are in the order of their pieces. Prefixes are doubled from 7 symbols on."""
    n = int(lengths.sum()) + len(lengths)
    symbol = terminated(data, lengths).astype(np.uint64)
    word, width = symbol, 1
    for step in (1, 2, 4):
        # What stands after a terminator is nothing, whatever the next piece begins with.
        after = np.zeros(n, np.uint64)
        after[:-step] = word[step:] if step < 4 else word[4:] >> np.uint64(9)
        more = min(step, 3)
        word = (word << np.uint64(9 * more)) | np.where(word & np.uint64(511), after, np.uint64(0))
        width += more
    order = np.argsort(word)
    ended = (word & np.uint64(511)) == 0
    first = word[order]
    new = np.ones(n, bool)
    new[1:] = first[1:] != first[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    spots = np.flatnonzero(~ended[order] & ~(new & np.append(new[1:], True)))
    while len(spots):
        at = order[spots]
        by = rank[at] << 32 | rank[at + width]
        sorted_ = np.argsort(by)
        at, by = at[sorted_], by[sorted_]
        order[spots] = at
        parted = np.ones(len(spots), bool)
        parted[1:] = by[1:] != by[:-1]
        new[spots] = parted
        then = ended[at + width]
        rank[at] = np.maximum.accumulate(np.where(parted, spots, 0))
        ended[at] = then
        spots = spots[~then & ~(parted & np.append(parted[1:], True))]
        width *= 2
    in_places(order, new)
    return order, symbol


def last_below(values: np.ndarray) -> np.ndarray:
    """For each value the place of the last one before it that is smaller; the first place where none is."""
    at = np.arange(-1, len(values) - 1, dtype=np.int32 if len(values) < 2**31 else np.int64)
    at[:1] = 0
    more = np.flatnonzero((values[at] >= values) & (at > 0))
    while len(more):
        # All between a place and the one that is held for it are no smaller.
        at[more] = at[at[more]]
        then = at[more]
        more = more[(values[then] >= values[more]) & (then > 0)]
    return at


def piece_order(rank: np.ndarray, common: np.ndarray, leads: np.ndarray, begins: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """What suffix_order gives for pieces whose places are ordered already, without sorting their ends: piece i has the
    sizes[i] next of the strings at begins, all of which differ, and ends depth bytes after the last of these begins.

    rank: of each place in the order of what stands there; common: the first bytes that each in that order has in common
    with the one before; leads: for each string the rank of the first that equals it. A piece's last bytes, n of them, come
    just before the first place that begins with them, which is the last one up to their own that has fewer than n in
    common with the one before.
    """
    lengths = sizes + depth - 1
    ends = np.cumsum(lengths + 1) - 1
    last = begins[np.cumsum(sizes) - 1] + depth
    bits, pieces = np.uint64(max(1, len(sizes).bit_length())), np.arange(len(sizes), dtype=np.uint64)
    small = np.uint64(max(1, depth.bit_length()))
    # One number each: the place's rank, the length (of whole strings depth, as these are told by their rank), and the piece.
    keys = np.empty(len(sizes) * (depth - 1) + len(begins), np.uint64)
    less = last_below(common)
    for n in range(1, depth):
        own = rank[last - n]
        far = np.flatnonzero(common[own] >= n)
        while len(far):
            own[far] = less[own[far]]
            far = far[common[own[far]] >= n]
        keys[(n - 1) * len(sizes) : n * len(sizes)] = ((own.astype(np.uint64) << small | np.uint64(n)) << bits) | pieces
    keys[len(sizes) * (depth - 1) :] = (leads.astype(np.uint64) << small | np.uint64(depth)) << bits
    keys.sort()
    place = np.empty(len(common), np.int64)
    place[leads] = np.repeat(ends - lengths - np.cumsum(sizes) + sizes, sizes) + np.arange(len(begins))
    length = ((keys >> bits) & np.uint64((1 << int(small)) - 1)).astype(np.int64)
    order = ends[(keys & np.uint64((1 << int(bits)) - 1)).astype(np.int64)] - length
    whole = np.flatnonzero(length == depth)
    order[whole] = place[(keys[whole] >> (bits + small)).astype(np.int64)]
    return np.concatenate([ends, order])


def invert(bwt: np.ndarray, rows: np.ndarray, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From transforms one behind another the text of their pieces, and for each entry where its suffix begins (one place
    past the piece for its terminator).

    bwt: symbols, 0 for a terminator; rows: the transform of each entry; pieces: how many pieces each transform has;
    lengths: of all pieces. All pieces are walked backwards at once, from their terminators, which come first in each order.
    """
    by_symbol = np.argsort(bwt, kind="stable")
    by_symbol = by_symbol[np.argsort(rows[by_symbol], kind="stable")]
    before = np.empty(len(bwt), np.int64)
    before[by_symbol] = np.arange(len(bwt))
    sizes = np.bincount(rows, minlength=len(pieces))
    entry = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(pieces) + pieces, pieces) + np.arange(pieces.sum())
    place = np.cumsum(lengths)
    text, where = np.zeros(int(lengths.sum()), np.uint8), np.empty(len(bwt), np.int64)
    while len(entry):
        where[entry] = place
        symbol = bwt[entry]
        go = symbol > 0
        entry, place = before[entry[go]], place[go] - 1
        text[place] = (symbol[go] - 1).astype(np.uint8)
    return text, where


class _Shard:
    """A chunk's texts in the order of doc_id, with the anchor of each of its strings of depth bytes."""

    def __init__(self, group: pa.Table, depth: int):
        group = group.sort_by("doc_id")
        self.column_ids = group.column("doc_id")
        self.known = len(self.column_ids) - self.column_ids.null_count
        self.ids = self.column_ids.fill_null(0).to_numpy().astype(np.int64)
        self.data, self.offsets = string_buffers(group.column("text"))
        self.keep_runs(depth)

    def keep_runs(self, depth: int) -> None:
        """Runs of strings that follow each other with the same anchor: where the first begins, how many, and the anchor."""
        begins, lengths, anchors, width = [], [], [], depth - GRAM + 1
        for a, b in slices(self.offsets[: self.known + 1], BYTES_AT_ONCE):
            lo, hi = self.offsets[a], self.offsets[b]
            grams = gram_hashes(self.data[lo:hi], GRAM)
            if len(grams) < width:
                continue
            # The low bits hold the place, so that the leftmost of equal grams is the anchor.
            low = np.uint64((1 << max(20, len(grams).bit_length())) - 1)
            spot = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), width) & low
            new = np.ones(len(spot), bool)
            new[1:] = spot[1:] != spot[:-1]
            # Strings that reach over a text's end count nothing; the next text begins a run of its own.
            ends = self.offsets[a + 1 : b + 1] - lo
            out = np.zeros(len(spot) + 1, np.int32)
            np.add.at(out, np.clip(ends - depth + 1, self.offsets[a:b] - lo, len(spot)), 1)
            np.subtract.at(out, np.minimum(ends, len(spot)), 1)
            bad = np.cumsum(out)[:-1] > 0
            new[1:] |= bad[1:] != bad[:-1]
            first = np.flatnonzero(new)
            length = np.diff(first, append=len(spot))
            good = ~bad[first]
            begins.append(first[good] + lo)
            lengths.append(length[good])
            # Mixed anew: the least of many hashes is small, and anchors are dealt by their high bits.
            anchors.append(mix(grams[spot[first[good]].astype(np.int64)]))
        self.run_at = np.concatenate([np.zeros(0, np.int64), *begins])
        self.run_length = np.concatenate([np.zeros(0, np.int64), *lengths])
        self.run_anchor = np.concatenate([np.zeros(0, np.uint64), *anchors])
        self.keys = np.sort(self.run_anchor)
        self.keys = self.keys[np.diff(self.keys, prepend=~self.keys[:1]) != 0]

    def order(self, shared: np.ndarray, depth: int) -> None:
        """Order what may repeat. shared: places in keys of anchors that other chunks have too."""
        key = np.searchsorted(self.keys, self.run_anchor)
        elsewhere = np.zeros(len(self.keys), bool)
        elsewhere[shared] = True
        own = np.bincount(key, minlength=len(self.keys)) > 1
        runs = np.flatnonzero((elsewhere | own)[key])
        sizes = self.run_length[runs]
        self.of_run = np.repeat(runs, sizes)
        self.at = at = np.repeat(self.run_at[runs] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        # Pieces end with the bytes of their last strings, so that the places after each run are ordered too.
        wide = np.zeros(len(self.data) + 1, np.int32)
        wide[self.run_at[runs]] += 1
        wide[self.run_at[runs] + sizes + depth - 1] -= 1
        wide = np.flatnonzero(np.cumsum(wide[:-1], dtype=np.int32) > 0)
        order, new, self.common = interleave(self.data, wide, depth, False)
        order = wide[order]
        self.rank = np.zeros(len(self.data), np.int32 if len(order) < 2**31 else np.int64)
        self.rank[order] = np.arange(len(order))
        self.lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))[self.rank[at]]
        number = np.full(len(self.data), -1, self.rank.dtype)
        number[at] = np.arange(len(at))
        self.sorted = number[order]
        strings = self.sorted >= 0
        self.sorted = self.sorted[strings]
        new = np.diff(self.lead[self.sorted], prepend=-1) != 0
        self.group = np.cumsum(new) - 1
        text = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))[at][self.sorted]
        lead = np.flatnonzero(new)
        self.late = self.ids[text] > self.ids[text[lead]][self.group] if len(lead) else np.zeros(0, bool)
        # An earlier start in the same text; equal ids of different texts are not earlier than each other.
        self.late[1:] |= ~new[1:] & (text[1:] == text[:-1])
        # The first of each class of equal strings stands for it in other chunks, and so does one of another text with the
        # same id, which isn't after it; all others go for the first's sake. In the order of the text.
        self.is_late = np.zeros(len(at), bool)
        self.is_late[self.sorted[self.late]] = True
        self.standing = np.flatnonzero(~self.is_late & np.repeat(elsewhere[key[runs]], sizes))


def runs_of(places: np.ndarray) -> np.ndarray:
    """Rising places as pairs (first, how many) of runs, one behind another."""
    first = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    return np.stack([places[first], np.diff(first, append=len(places))], axis=1).astype(np.uint32).ravel()


def of_runs(pairs: np.ndarray) -> np.ndarray:
    first, n = pairs.reshape(-1, 2).astype(np.int64).T
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, docs_per_chunk: int = DOCS_PER_CHUNK) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed [from, to) byte places).

    A byte goes if a string of `depth` bytes covers it that also starts in a document with a smaller id, or earlier in
    the same document. Strings lie within one text's UTF-8 bytes and are compared byte by byte. A null text is empty;
    rows without an id are never changed and change nothing; rows with equal ids are not earlier than each other.
    """
    sizes = measured(docs, id_col, text_col)
    chunks = chunked(docs, id_col, text_col, docs_per_chunk, sizes)
    buckets = sizes.buckets(BYTES_PER_BUCKET)
    bits = buckets.bit_length() - 1
    shared = earlier_elsewhere(chunks, lambda group: _Shard(group, depth).keys, buckets, any_other=True)

    def send(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        """A row for each bucket: the transform of the shard's pieces there, without its terminators, where these are, and
        of each piece which of the standing strings it begins with and how many it holds. And a row for the shard itself,
        in a bucket of its own: what goes for its own strings' sake, and where the standing ones are."""
        rows: dict[str, list] = {"bucket": [], "base": [], "sizes": [], "bwt": [], "ends": []}
        if group.num_rows:
            shard = _Shard(group, depth)
            shard.order(places(answers), depth)
            late = shard.at[shard.is_late]
            begins = shard.at[shard.standing]
            add = lambda *row: [rows[c].append(x) for c, x in zip(rows, row, strict=True)]
            add(-1 - hash(tuple(k.as_py() for k in key)) % buckets, runs_of(late).tobytes(), runs_of(begins).tobytes(), b"", b"")
            if len(begins):
                anchors = shard.run_anchor[shard.of_run[shard.standing]]
                piece = np.ones(len(begins), bool)
                piece[1:] = (np.diff(begins) != 1) | (anchors[1:] != anchors[:-1])
                base = np.flatnonzero(piece)
                sizes = np.diff(base, append=len(begins))
                lengths = sizes + depth - 1
                text = shard.data[np.repeat(begins[base] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
                leads = shard.lead[shard.standing]
                if np.bincount(leads).max() == 1:
                    order, symbol = piece_order(shard.rank, shard.common, leads, begins, sizes, depth), terminated(text, lengths)
                else:
                    # Texts of one id hold equal strings, which only what follows them puts in order.
                    order, symbol = suffix_order(text, lengths)
                # A part of the pieces has its suffixes in the same order.
                bucket = (anchors[base] >> np.uint64(64 - bits)).astype(np.int64)
                found, small = np.unique(bucket, return_inverse=True)
                kind = np.uint16 if len(found) < 65536 else np.int64
                of = np.repeat(small.astype(kind), lengths + 1)
                order = order[np.argsort(of[order], kind="stable")]
                last = np.concatenate([symbol[:1] * 0, symbol[:-1]])[order]
                pieces = np.bincount(small, minlength=len(found))
                edges, cuts = np.cumsum(np.bincount(of, minlength=len(found))), np.cumsum(pieces)
                by_bucket = np.argsort(small, kind="stable")
                # A bucket's part of the transform has a terminator for each of its pieces.
                bwt = (last[last > 0] - last.dtype.type(1)).astype(np.uint8).tobytes()
                ends = np.flatnonzero(last == 0) - np.repeat(np.append(0, edges[:-1]), pieces)
                ends, bases, counts = (x.astype(np.uint32).tobytes() for x in (ends, base[by_bucket], sizes[by_bucket]))
                edges, cuts = edges.tolist(), cuts.tolist()
                for b, lo, hi, p, q in zip(found.tolist(), [0, *edges], edges, [0, *cuts], cuts, strict=False):
                    add(b, bases[4 * p : 4 * q], counts[4 * p : 4 * q], bwt[lo - p : hi - q], ends[4 * p : 4 * q])
        return pa.table({"bucket": pa.array(rows["bucket"], pa.int64()), **key_columns([k.as_py() for k in key], len(rows["bucket"])), **{c: pa.array(rows[c], pa.binary()) for c in ("base", "sizes", "bwt", "ends")}})

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        keys = {c: group.column(c) for c in KEY}
        if key[0].as_py() < 0:
            return pa.table({**keys, "at": group.column("base"), "standing": group.column("sizes")})
        read = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in group.column(c)]
        ends, bytes_, pieces = read("ends", np.uint32), read("bwt", np.uint8), np.array([len(x.as_py()) // 4 for x in group.column("base")])
        base, sizes = (np.concatenate(read(c, np.uint32)).astype(np.int64) for c in ("base", "sizes"))
        total = np.array([len(e) + len(x) for e, x in zip(ends, bytes_, strict=True)])
        bwt, body = np.zeros(total.sum(), np.uint16), np.ones(total.sum(), bool)
        body[np.concatenate([e.astype(np.int64) + o for e, o in zip(ends, np.cumsum(total) - total, strict=True)])] = False
        bwt[body] = np.concatenate(bytes_).astype(np.uint16) + np.uint16(1)
        row = np.repeat(np.arange(len(total), dtype=np.uint16 if len(total) < 65536 else np.int64), total)
        lengths = sizes + depth - 1
        text, where = invert(bwt, row, pieces, lengths)
        # The strings' places in the text, and which of the standing ones each is.
        steps = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        starts = np.repeat(np.cumsum(lengths) - lengths, sizes) + steps
        string = np.full(len(text) + 1, -1, np.int64)
        string[starts] = np.arange(len(starts))
        # A terminator's place is the next piece's first one: entries of terminators come first in their order.
        first = np.arange(len(where)) - np.repeat(np.cumsum(total) - total, total) < np.repeat(pieces, total)
        runs = string[where[~first]]
        runs = runs[runs >= 0]
        order, new, _ = interleave(text, starts[runs], depth, True)
        order = runs[order]
        owner = np.repeat(np.arange(len(total)), pieces)
        owner = np.repeat(owner, sizes)
        late = np.sort(late_of(order, new, group.column(CHUNK).to_numpy()[owner]))
        out = told(group, owner, np.repeat(base, sizes) + steps, late)
        return out.append_column("standing", pa.nulls(out.num_rows, pa.binary()))

    sent = chunks.groupBy(*KEY).cogroup(shared.groupBy(*KEY)).applyInArrow(send, f"bucket bigint, {KEY_DDL}, base binary, sizes binary, bwt binary, ends binary")
    answered = sent.groupBy("bucket").applyInArrow(merge, f"{KEY_DDL}, at binary, standing binary")

    def finish(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return schema.empty_table()
        group = group.sort_by("doc_id")
        column_ids = group.column("doc_id")
        data, offsets = string_buffers(group.column("text"))
        at = np.zeros(0, np.int64)
        if answers.num_rows:
            own = pc.is_valid(answers.column("standing"))
            mine = answers.filter(own)
            standing = of_runs(np.frombuffer(mine.column("standing")[0].as_py(), np.uint32))
            at = np.concatenate([of_runs(np.frombuffer(mine.column("at")[0].as_py(), np.uint32)), standing[places(answers.filter(pc.invert(own)))]])
        steps = np.zeros(len(data) + 1, np.int32)
        steps[: len(data)] += np.bincount(at, minlength=len(data)).astype(np.int32)[: len(data)]
        steps -= np.bincount(at + depth, minlength=len(steps)).astype(np.int32)
        gone = np.cumsum(steps)[:-1] > 0
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            mask = gone[a:b]
            n = int(mask.sum())
            edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).tolist() if n else []
            kept = data[a:b][~mask].tobytes() if n else data[a:b].tobytes()
            for k, v in zip(out, (b - a, n, len(edges) // 2, hashlib.sha256(kept).hexdigest(), list(map(list, zip(edges[::2], edges[1::2], strict=True)))), strict=True):
                out[k].append(v)
        return pa.table([column_ids, *(pa.array(out[f.name], f.type) for f in list(schema)[1:])], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])
    return chunks.groupBy(*KEY).cogroup(answered.groupBy(*KEY)).applyInArrow(finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<array<bigint>>")
