"""Whole texts as numpy arrays of word hashes. A word is a run of bytes other than space and \\t \\n \\v \\f \\r."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random odd number for each byte; the white-space bytes count nothing.
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
BYTE_VALUES[~IS_WORD] = 0
#: The same with A-Z counted as a-z.
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[ord("A") : ord("Z") + 1] = BYTE_VALUES[ord("a") : ord("z") + 1]
MOST_POWERS = 1 << 21
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; the longest run so far is kept, up to a bound."""
    kept = sys.__dict__.setdefault("_powers", {})
    if base not in kept or len(kept[base]) < n:
        out = np.full(max(n, 1 << 12), base % 2**64, np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if n > MOST_POWERS:
            return out[:n]
        kept[base] = out
    return kept[base][:n]


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `most` bytes each; a longer text has a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray, values: np.ndarray = BYTE_VALUES) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word, and for each text where its words begin (n + 1 places)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = IS_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    lengths = np.diff(starts, append=n)
    place = np.arange(n - starts[0], dtype=np.int64) - np.repeat(starts - starts[0], lengths)
    terms = values[data[starts[0] :]] * powers(int(lengths.max()))[place]
    hashes = mix(np.add.reduceat(terms, starts - starts[0]))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def window_hashes(tokens: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every `width` consecutive tokens of one text, and the place of each window's first token."""
    n = len(tokens)
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    if not counts.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(tokens * powers(n), out=sums[1:])
    starts = np.repeat(bounds[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    return mix((sums[starts + width] - sums[starts]) * powers(n, INVERSE)[starts]), starts
