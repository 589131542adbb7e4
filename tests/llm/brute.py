"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def substrings(rows, width=50):
    """rows: (doc_id, text)."""
    least, cut = {}, []
    for i, text in rows:
        words = WORD.findall(text or "")
        cut.append(words)
        if i is not None:
            for k in range(len(words) - width + 1):
                w = tuple(words[k : k + width])
                least[w] = min(least.get(w, i), i)
    out = []
    for (i, _), words in zip(rows, cut, strict=True):
        gone = [False] * len(words)
        if i is not None:
            for k in range(len(words) - width + 1):
                if least[tuple(words[k : k + width])] < i:
                    gone[k : k + width] = [True] * width
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), sha(kept.encode())))
    return out


def suffixes(rows, depth=100):
    first = {}
    for n, (i, text) in enumerate(rows):
        if i is not None:
            b = (text or "").encode()
            for k in range(len(b) - depth + 1):
                first.setdefault(b[k : k + depth], []).append((i, n, k))
    out = []
    for n, (i, text) in enumerate(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - depth + 1):
                if any(j < i or (m == n and s < k) for j, m, s in first[b[k : k + depth]]):
                    gone[k : k + depth] = b"\1" * depth
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, sha(kept)))
    return out


def shingles(text, width=4):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def near_copies(rows, width=4, percent=80):
    sets = [(i, shingles(t, width)) for i, t in rows]
    links = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[:n] if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y)]
    root = roots({i for i, _ in sets if i is not None}, links)
    return [(i, len(x), root.get(i), i is None or root[i] == i) for i, x in sets]


def vectors(rows, cosine=0.93):
    """rows: (vec_id, label, vector)."""

    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        top = max(map(abs, v))
        v = [x / top for x in v]
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v]

    units = [(i, label, unit(v)) for i, label, v in rows]
    count, links = defaultdict(int), []
    for n, (i, a, x) in enumerate(units):
        for m, (j, b, y) in enumerate(units):
            if n != m and None not in (i, j, a, b) and a == b and x and y and len(x) == len(y) and sum(p * q for p, q in zip(x, y, strict=True)) >= cosine:
                count[n] += 1
                links.append((i, j))
    root = roots({i for i, _, _ in units if i is not None}, links)
    return [(i, count[n], root.get(i), i is None or root[i] == i) for n, (i, _, _) in enumerate(units)]


def base(text):
    words = WORD.findall(text or "")
    windows = defaultdict(list)
    for k in range(len(words) - 4):
        windows[tuple(words[k : k + 5])].append(k)
    hit = {p for ks in windows.values() if len(ks) > 1 for k in ks for p in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n)


def _lines(text):
    """(place, normalized line, words) of the lines with a word."""
    found = [(k, re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()) for k, x in enumerate((text or "").split("\n"))]
    return [(k, x, x.count(" ") + 1) for k, x in found if x]


def _without(text, gone):
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


def quality(rows):
    """rows: (doc_id, text, host). For each row (kept, text without the lines above the limits, lines removed)."""
    texts, hosts = defaultdict(set), defaultdict(set)
    for _, t, h in rows:
        if t is not None:
            hosts[h].add(t)
            for _, line, _ in _lines(t):
                texts[h, line].add(t)
    over = {k for k, v in texts.items() if len(v) > 10 and (len(v) * 200 > len(hosts[k[0]]) or len(v) >= 1000)}
    out = []
    for _, t, h in rows:
        gone = {k: n for k, line, n in _lines(t) if (h, line) in over}
        n = base(t)[0]
        left = n - sum(gone.values())
        out.append((not base(t)[-1] and left >= 5 and left * 100 >= n * 30, t if not gone else _without(t, gone), len(gone)))
    return out


def boilerplate(rows):
    """rows: (doc_id, text, site). Each text without the lines on 10 sites and in 20 texts or more."""
    sites, texts = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        for _, line, _ in _lines(t):
            sites[line].add(s)
            texts[line].add(t)
    out = []
    for _, t, _ in rows:
        gone = {k for k, line, _ in _lines(t) if len(sites[line]) >= 10 and len(texts[line]) >= 20}
        out.append(t if not gone else _without(t, gone))
    return out


def schedule(weights, slots):
    """The source of each slot: of the blocks released, the one due first, ties by name; worked out slot by slot."""
    total, done, out = sum(weights.values()), dict.fromkeys(weights, 0), []
    for t in range(slots):
        ready = [(-(-(k + 1) * total // weights[s]), s) for s, k in done.items() if k * total // weights[s] <= t]
        due, s = min(ready)
        assert due > t
        out.append((s, done[s]))
        done[s] += 1
    return out
