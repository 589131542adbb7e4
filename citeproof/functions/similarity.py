"""Similarities that the JVM has no function for: the one place where rows go to Python, as Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


#: Pairs of more characters than this together are not kept by a worker, and this many others at most.
KEPT_LENGTH, KEPT = 512, 8192


@lru_cache(maxsize=KEPT)
def _kept_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def ratio(a: str | None, b: str | None) -> float:
    """Characters of a that b lacks match nothing, whichever they are: they are made one, so that texts which differ in
    such characters only, numbers say, are compared once."""
    if a is None or b is None:
        return 0.0
    if len(a) + len(b) > KEPT_LENGTH:
        return SequenceMatcher(None, a, b).ratio()
    if "\0" not in b:
        for c in set(a).difference(b):
            a = a.replace(c, "\0")
    return _kept_ratio(a, b)


@F.pandas_udf(DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all; not symmetric."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def title_similarity(a: pd.Series, b: pd.Series, tokens: pd.Series) -> pd.Series:
    """0.6 of the ratio and 0.4 of the token similarity (the ratio again where that is null), to 3 places."""
    out = []
    for x, y, t in zip(a, b, tokens, strict=True):
        r = ratio(x, y) if x and y else None
        out.append(0.0 if r is None else round(0.6 * r + 0.4 * (r if pd.isna(t) else t), 3))
    return pd.Series(out, dtype=float)


@F.pandas_udf(StructType([StructField("lexical", DoubleType()), StructField("semantic", DoubleType())]))
def sentence_scores(claim: pd.Series, sentence: pd.Series, stems: pd.Series, grams: pd.Series, concepts: pd.Series, tokens: pd.Series) -> pd.DataFrame:
    """Both channels to 2 places: lexical from stems, trigrams and ratio; semantic from concepts (null: tokens) and ratio."""
    out = []
    for x, y, s, g, c, t in zip(claim, sentence, stems, grams, concepts, tokens, strict=True):
        if not x or not y:
            out.append((0.0, 0.0))
            continue
        r = ratio(x, y)
        meaning = 0.5 * t + 0.5 * r if pd.isna(c) else 0.7 * c + 0.3 * r
        out.append((round(0.5 * s + 0.3 * g + 0.2 * r, 2), round(min(1.0, meaning), 2)))
    return pd.DataFrame(out, columns=["lexical", "semantic"], dtype=float)


#: Scores that are worked out at once.
SCORES = 2**20


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows filled up with zeros, their lengths, and which are whole: neither null nor with a null."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    own = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.array(lists.is_valid())
    whole[own[np.array(flat.is_null())]] = False
    rows = np.zeros((len(sizes), max(1, sizes.max(initial=0))))
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    return rows, sizes, whole


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added one after the other as evaluate.cosine adds them."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def nearest_rows(vectors: pa.Table, queries: pa.Table, limit: int) -> pa.Table:
    """(query_id, vec_id, c): for each of queries (query_id, q) the `limit` of vectors (vec_id, embedding) with another id
    and the greatest evaluate.cosine, and of equals the smaller ids.

    A product of matrices, which is right but for rounding, tells which pairs can be among them; these are worked out
    in evaluate.cosine's own order, so that scores and ties are the same to the last bit.
    """
    v, v_size, v_whole = _vectors(vectors["embedding"])
    q, q_size, q_whole = _vectors(queries["q"])
    width = max(v.shape[1], q.shape[1])
    v, q = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (v, q))
    v_id, q_id = (t[n].to_numpy() for t, n in ((vectors, "vec_id"), (queries, "query_id")))
    found = []
    with np.errstate(all="ignore"):
        v_norm, q_norm = np.sqrt(_dots(v, v)), np.sqrt(_dots(q, q))
        # Where the order of additions could matter more than by rounding, all pairs are worked out.
        v_odd, q_odd = (~((n == 0) | ((n > 1e-100) & (n < 1e100))) for n in (v_norm, q_norm))

        def held(dots: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            norms = q_norm[i] * v_norm[j]
            c = dots / norms
            c = np.where(np.isnan(c) | (q_size[i] != v_size[j]), 1.0, np.clip(c, 0.0, 1.0))
            return np.where(q_whole[i] & v_whole[j] & ((norms > 0) | np.isnan(norms)), c, 0.0)

        every, some = np.arange(len(v)), max(1, SCORES // max(1, len(v)))
        for at in range(0, len(q), some):
            part = np.arange(at, min(at + some, len(q)))
            near = held(q[part] @ v.T, part[:, None], every[None, :])
            near[q_odd[part][:, None] | v_odd[None, :]] = np.inf
            near[q_id[part][:, None] == v_id[None, :]] = -np.inf
            last = np.partition(near, len(v) - limit, axis=1)[:, [len(v) - limit]] if len(v) > limit else -np.inf
            # Odd pairs stand before all others and must not hide them: then everything is worked out.
            last = np.where(last == np.inf, -np.inf, last)
            if v_odd.any():
                last = np.full((len(part), 1), -np.inf)
            i, j = np.nonzero((near >= last - (1e-12 + 1e-15 * width)) & (near > -np.inf))
            i = part[i]
            c = np.empty(len(i))
            for k in range(0, len(i), SCORES // 16):
                few = slice(k, k + SCORES // 16)
                c[few] = held(_dots(q[i[few]], v[j[few]]), i[few], j[few])
            order = np.lexsort((v_id[j], -c, i))
            i, j, c = i[order], j[order], c[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < limit
            found.append((q_id[i[first]], v_id[j[first]], c[first]))
    columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [[], [], []]
    return pa.table({n: pa.array(x, t) for n, x, t in zip(("query_id", "vec_id", "c"), columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)})
