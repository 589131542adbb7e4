from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from citeproof.llm.packing import Ids, first_fit_decreasing, pack_documents, without_padding
from citeproof.llm.queries import QUERIES

from .test_llm import DDL, SF, docs, texts

P = pytest.importorskip("public_tokenizers")
FILE = P.path("byte_bpe_50k.json")


def tokenizer():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(FILE)
    out.encode_special_tokens = True
    return out


def test_first_fit_decreasing():
    """Bin by bin as trying all bins in turn would have it."""
    rnd = random.Random(2)
    for t in range(200):
        sizes = [rnd.randint(1, 40) if t % 2 else rnd.choice([3, 20, 40]) for _ in range(rnd.randint(0, 70))]
        room, want = [], []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            at = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            if at == len(room):
                room.append(40)
                want.append([])
            room[at] -= sizes[i]
            want[at].append(i)
        assert first_fit_decreasing(sizes, 40) == want


def test_no_bin_needs_padding():
    rnd = random.Random(4)
    for _ in range(300):
        sizes = [rnd.randint(1, 63) for _ in range(rnd.randint(0, 40))]
        bins = [[(i, 0, sizes[i]) for i in b] for b in first_fit_decreasing(sizes, 64)]
        out = without_padding(bins, 64)
        loads = [sum(n for _, _, n in b) for b in out]
        assert all(0 < x <= 64 and x & (x - 1) == 0 for x in loads) and sum(loads) == sum(sizes)
        spans = sorted((i, s, s + n) for b in out for i, s, n in b)
        assert all((a == c and y == z) or (a != c and z == 0 and y == sizes[a]) for (a, _, y), (c, z, _) in zip(spans, spans[1:]))
        # Full bins of the first fit stay as they are.
        assert all(b in out for b in bins if sum(n for _, _, n in b) == 64)


def test_ids_are_the_tokenizers():
    own, want = Ids(open(FILE, encoding="utf-8").read()), tokenizer()
    rnd = random.Random(3)
    odd = "a b\tZ9.,'s  \u00a0\u2003\x1c\u0085é日😀\x00<|endoftext|>\n#ﬁ\u0301"
    samples = ["".join(rnd.choice(odd) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    samples += ["x" * 30_000, " " * 200_000, "a" + "\n" * 150_000 + "b", "日本" * 9000, "we'll they'LL <|endoftext|> end", *[t for _, t in texts() if t]]
    assert own.fast is not None
    for x in samples:
        assert np.frombuffer(own.encode(x), "<u4").tolist() == want.encode(x, add_special_tokens=False).ids
    own.fast = None
    assert np.frombuffer(own.encode(samples[-1]), "<u4").tolist() == want.encode(samples[-1], add_special_tokens=False).ids


def check(rows, pieces, length=2048):
    """Every document's ids lie in one piece each, and no sequence needs padding. rows: (doc_id, text), ids may repeat."""
    t = tokenizer()
    left: dict = defaultdict(list)
    for i, text in rows:
        left[i].append([*t.encode(text or "", add_special_tokens=False).ids, 1])
    ids_of = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    found, wanted = defaultdict(int), defaultdict(int)
    for p in pieces:
        fits = [d for d in left[p.doc_id] if len(d) == p.doc_tokens and ids_of(d[p.start : p.start + p.length]) == p.ids_crc32]
        assert fits and p.start + p.length <= p.doc_tokens
        found[p.doc_id] += p.length
    for i, ds in left.items():
        wanted[i] = sum(map(len, ds))
    assert found == wanted
    for i, ds in left.items():
        if len(ds) == 1:
            spans = sorted((p.start, p.length) for p in pieces if p.doc_id == i)
            assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for spans in by_sequence.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        total = sum(n for _, n in spans)
        assert total == length or total < length and total & (total - 1) == 0


def test_pieces(spark):
    rows = [*texts(), (900, "word " * 40_000), (901, "<|endoftext|>"), *[(902, "twice the same")] * 3]
    for group in (2048, 4):
        got = pack_documents(docs(spark, rows), FILE, docs_per_group=group).collect()
        check(rows, got)
        assert sorted(map(str, got)) == sorted(map(str, pack_documents(docs(spark, rows), FILE, docs_per_group=group).collect()))
    short = pack_documents(docs(spark, rows), FILE, length=100, docs_per_group=5, with_ids=True).collect()
    check(rows, short, 100)
    assert all(zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length for p in short)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(rows, QUERIES["op11_packing"](spark, SF).collect())


def test_no_documents(spark):
    assert pack_documents(spark.createDataFrame([], DDL), FILE).count() == 0
