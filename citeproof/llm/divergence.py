"""Source divergence audit: sorted streams of (lang, term, source, document), scanned run by run.

A block of documents is scanned where its texts are and sends one row for each run of (lang, term, source), so that a
frequent term costs a row for each block and not for each document. Rows are dealt by (lang, term) and sorted by (lang, term,
source), blocks of documents one behind another; the scan adds up runs to document frequencies and counts, and keeps the
terms of enough documents. The kept terms are dealt and sorted once more, by parts of a language's terms; the second scan
adds each run of a term to the partial distances of all pairs of sources, and holds on to the most marked terms of each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeproof.llm.exchange import FEW
from citeproof.llm.runtime import cut

LEAST_DOCS, TOP, SCALE, ADDED = 30, 50, 1_000_000_000, 5
#: Counters of a block of documents; terms of a unit of the second scan, sources on its left, and cells of a dense block.
BLOCK_TERMS, UNIT_TERMS, UNIT_SOURCES, CELLS = 400_000, 4096, 256, 1 << 18
#: Bytes of a term: letters of ASCII and all of other characters; capitals of ASCII are lowered, all else parts terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, term, source, docs, n) of blocks of documents. The empty term, which no text has, names the group."""
    n: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def sent() -> pa.RecordBatch:
        langs, sources, sizes = [], [], []
        terms, count, held = [], [], []
        for group, counts in n.items():
            langs.append(group[0])
            sources.append(group[1])
            sizes.append(len(counts))
            terms.extend(counts)
            count.extend(counts.values())
            held.extend(map(docs[group].__getitem__, counts))
        n.clear()
        docs.clear()
        named = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(named), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(sources, pa.string()).take(named), pa.array(held, pa.int64()), pa.array(count, pa.int64())], ["lang", "term", "source", "docs", "n"])

    for batch in batches:
        for text, lang, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            group = (lang, source)
            if group not in n:
                n[group], docs[group] = Counter({b"": 0}), Counter()
            terms = text.encode().translate(_TERM_BYTES).split()
            n[group].update(terms)
            docs[group].update(set(terms))
            if sum(map(len, n.values())) > BLOCK_TERMS:
                yield sent()
    if n:
        yield sent()


def _begins(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Where a row differs from the one before in any of the columns."""
    new = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        differs = [pc.not_equal(table.column(c).slice(1), table.column(c).slice(0, table.num_rows - 1)).to_numpy() for c in columns]
        new[1:] = np.logical_or.reduce(differs)
    return new


def _runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(lang, term, source, n, leads) of terms in at least `least` documents of their language, from sorted rows of blocks.

    leads: 1 on the first row of a term. What a scan holds back is the last term's runs: a row for each source at most.
    """
    names = ["lang", "term", "source", "docs", "n"]

    def collapsed(table: pa.Table) -> pa.Table:
        first = np.flatnonzero(_begins(table, names[:3]))
        sums = [pa.array(np.add.reduceat(table.column(c).to_numpy(), first), pa.int64()) for c in names[3:]]
        return pa.table([*(table.column(c).take(pa.array(first)) for c in names[:3]), *sums], names)

    def kept(table: pa.Table) -> pa.RecordBatch:
        new = _begins(table, names[:2])
        first = np.flatnonzero(new)
        enough = np.add.reduceat(table.column("docs").to_numpy(), first) >= least
        enough |= pc.equal(table.column("term"), "").to_numpy()[first]
        keep = enough[np.cumsum(new) - 1]
        out = table.append_column("leads", pa.array(new.astype(np.int64))).filter(pa.array(keep)).drop_columns(["docs"])
        return out.combine_chunks().to_batches()[0] if out.num_rows else None

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = collapsed(pa.concat_tables([held, table]).combine_chunks() if held is not None else table)
        last = int(np.flatnonzero(_begins(table, names[:2]))[-1])
        if last and (out := kept(table.slice(0, last).combine_chunks())) is not None:
            yield out
        held = table.slice(last).combine_chunks()
    if held is not None and (out := kept(held)) is not None:
        yield out


def share(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / total), exactly, for 0 <= counts <= total < 9e15: three decimals at a time."""
    out, rest = counts // total, counts % total
    scale = SCALE
    while scale > 1:
        step = min(scale, 1000)
        rest = rest * step
        out, rest, scale = out * step + rest // total, rest % total, scale // step
    return out + 1


class _Unit:
    """A part of a language's terms, for some of its sources on the left and all of them on the right."""

    def __init__(self, lang: str, tile: int):
        self.lang, self.tile = lang, tile
        self.sources: list[str] = []
        self.totals: list[int] = []
        self.n_terms = 0
        self.distances = None

    def begin(self) -> None:
        self.left = range(self.tile * UNIT_SOURCES, min(len(self.sources), (self.tile + 1) * UNIT_SOURCES))
        self.total = np.array(self.totals, np.int64)
        self.distances = np.zeros((len(self.left), len(self.sources)), np.int64)
        self.marked: list[list[tuple[int, bytes]]] = [[] for _ in self.left]

    def add(self, terms: pa.Array, places: np.ndarray, n: np.ndarray, top: int) -> None:
        """Runs of whole terms, in order: places of sources in the language and how often the term stands there."""
        if self.distances is None:
            self.begin()
        new = _begins(pa.table({"t": terms}), ["t"])
        of, first = np.cumsum(new) - 1, np.flatnonzero(new)
        names = terms.take(pa.array(first)).to_pylist()
        step = max(1, CELLS // len(self.sources))
        for a in range(0, len(names), step):
            b = min(len(names), a + step)
            rows = slice(*np.searchsorted(of, [a, b]))
            counts = np.zeros((len(self.sources), b - a), np.int64)
            counts[places[rows], of[rows] - a] = n[rows]
            p = share(counts + ADDED, (self.total + ADDED * self.n_terms)[:, None])
            q = share(counts.sum(0) + ADDED, np.array(self.total.sum() + ADDED * self.n_terms))
            for k, i in enumerate(self.left):
                self.distances[k] += np.abs(p - p[i]).sum(1)
                over = p[i] - q
                at = np.flatnonzero((counts[i] > 0) & (over > 0))
                at = at[np.argsort(-over[at], kind="stable")][:top]
                self.marked[k] = sorted([*self.marked[k], *((-int(over[t]), names[a + t].encode()) for t in at)])[:top]

    def rows(self) -> pa.RecordBatch:
        if self.distances is None:
            self.begin()
        out = [(self.lang, self.sources[i], "pair", other, int(d)) for k, i in enumerate(self.left) for j, (other, d) in enumerate(zip(self.sources, self.distances[k], strict=True)) if i != j]
        out += [(self.lang, self.sources[i], "term", term.decode(), -v) for k, i in enumerate(self.left) for v, term in self.marked[k]]
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:4]), pa.array(columns[4], pa.int64())], ["lang", "source", "part", "item", "value"])


def _distances(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """Partial pairs and terms of each unit, from rows sorted by unit, its sources first, then by term and source."""
    unit, key, held = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        edges = [*np.flatnonzero(_begins(table, ["lang", "tile", "bucket"])).tolist(), table.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            part = table.slice(a, b - a)
            now = tuple(part.column(c)[0].as_py() for c in ("lang", "tile", "bucket"))
            if now != key:
                if unit is not None:
                    if held is not None:
                        unit.add(*held, top)
                    yield unit.rows()
                unit, key, held = _Unit(now[0], now[1]), now, None
            own = pc.equal(part.column("term"), "")
            for row in part.filter(own).select(["source", "n", "n_terms"]).to_pylist():
                unit.sources.append(row["source"])
                unit.totals.append(row["n"])
                unit.n_terms = row["n_terms"]
            runs = part.filter(pc.invert(own)).combine_chunks()
            if not runs.num_rows:
                continue
            terms, places, n = runs.column("term").combine_chunks(), runs.column("place").to_numpy(), runs.column("n").to_numpy()
            if held is not None:
                terms, places, n = pa.concat_arrays([held[0], terms]), np.concatenate([held[1], places]), np.concatenate([held[2], n])
            # The last term may go on in the next batch.
            last = int(np.flatnonzero(_begins(pa.table({"t": terms}), ["t"]))[-1])
            if last:
                unit.add(terms.slice(0, last), places[:last], n[:last], top)
            held = terms.slice(last), places[last:], n[last:]
    if unit is not None:
        if held is not None:
            unit.add(*held, top)
        yield unit.rows()


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language are from each other, and their marked terms.

    Terms are runs of letters of ASCII, lowered, and of other characters than ASCII. A language keeps the terms of at
    least `least_docs` of its documents, V of them. A group (lang, source), and a language as a whole, gives a kept term
    p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)), N being the group's count of all kept terms.
    Part `pair`: item is another source of the language, value the sum of |p - q| over all kept terms, 0 if there are none.
    Part `term`: item is a kept term that the group has and whose p is over the language's q, value p - q, the first
    `top` only. Ranks begin at 1 in each group and part, by value downwards, then item in the order of its UTF-8.
    A null text, language or source counts as ''; every row is a document, also repeated ones; no rows give no rows. A
    language of one source has no pairs. Only the three named columns are read. A task's memory follows the sources of
    a language, of which the pairs are the result's rows, and not the documents or terms.
    """
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    blocks = named.mapInArrow(_blocks, "lang string, term string, source string, docs bigint, n bigint")
    sorted_ = blocks.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    runs = cut(sorted_.mapInArrow(lambda x: _runs(x, least_docs), "lang string, term string, source string, n bigint, leads bigint"))
    terms = runs.where("term <> ''")
    groups = runs.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = groups.withColumns({"place": (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("bigint"), "n_sources": F.count("*").over(Window.partitionBy("lang"))})
    n_terms = F.coalesce("n_terms", F.lit(0)).cast("bigint").alias("n_terms")
    groups = groups.join(terms.groupBy("lang").agg(F.sum("leads").alias("n_terms")), "lang", "left").select("lang", "source", "n", "place", n_terms, F.expr(f"(n_sources - 1) div {UNIT_SOURCES}").alias("tiles"), F.expr(f"greatest(0, coalesce(n_terms, 0) - 1) div {UNIT_TERMS} + 1").alias("buckets"))
    groups = cut(groups)
    # Few groups go to every task; else the join's key is a group, which has each term once at most.
    few = F.broadcast(groups) if groups.count() <= FEW else groups
    tile = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles"))).alias("tile")
    heads = groups.select("*", tile).select("lang", "tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("buckets") - 1)).alias("bucket"), F.lit("").alias("term"), "source", "n", "n_terms", "place")
    bucket = F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket")
    rows = terms.join(few.drop("n"), ["lang", "source"]).select("lang", tile, bucket, "term", "source", "n", "n_terms", "place")
    units = heads.unionByName(rows).repartition("lang", "tile", "bucket").sortWithinPartitions("lang", "tile", "bucket", "term", "source")
    partial = units.mapInArrow(lambda x: _distances(x, top), "lang string, source string, part string, item string, value bigint")
    values = partial.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = values.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
