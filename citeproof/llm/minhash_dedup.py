"""MinHash near-dedup by tensored banding: table keys are pairs of half keys from two small collections of minhashes.

Two collections of `halves` half keys, each of `rows` minhashes, give halves ** 2 tables of 2 * rows minhashes each, for
2 * halves * rows minhashes in all instead of 2 * rows * halves ** 2. A pair with similarity s is missed only if all
half keys of one collection differ: with 8 halves of 2 rows that is at most 2 * (1 - s ** 2) ** 8, 0.06 % at s = 0.8 and
0.004 % at 0.86. Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeproof.llm.components import components
from citeproof.llm.runtime import cut, cut_few, power_of_two, release, tidy
from citeproof.llm.words import FOLDED_VALUES, mix, powers, slices, string_buffers, word_hashes
from citeproof.storage import bucketed

SHINGLE, HALVES, ROWS, PERCENT = 4, 8, 2, 80
BYTES_AT_ONCE, SHINGLES_AT_ONCE = 2 << 20, 1 << 15
#: Rounds in which each bucket's documents are compared with one of them, which then leaves it. Then pairs with a rare
#: shingle in common are made, and what may still link goes on in rounds of CENTRES centres and eight times as many each.
STAR_ROUNDS, CENTRES = 2, 16
#: In so many sets a shingle is common. A shingle is hot if its sets are more than 1 / HOT of all shingles of sets.
COMMON, HOT = 32, 1000
#: Pairs of a centre that are compared in one task.
CENTRE_PAIRS = 256
#: Bytes of all documents' sets, of which few are kept, for each bucket of those that are.
BYTES_PER_BUCKET = 32 << 20
#: Most bits (4 MB) that tell the texts which documents' sets are wanted.
BITS = 1 << 25
_MULTIPLIERS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = powers(SHINGLE + 1, 0xD1342543DE82EF95)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles; of fewer words, of all of them as one."""
    for a, b in slices(offsets, BYTES_AT_ONCE):
        lo, hi = offsets[a], offsets[b]
        tokens, bounds = word_hashes(data[lo:hi], offsets[a : b + 1] - lo, FOLDED_VALUES)
        grams = np.zeros(max(len(tokens) - width + 1, 0), np.uint64)
        for k, c in enumerate(powers(width + 1, 0xD1342543DE82EF95)[1:]):
            grams += tokens[k : k + len(grams)] * c
        grams = mix(grams)
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if e - s >= width:
                yield np.unique(grams[s : e - width + 1])
            elif e > s:
                yield mix(np.array([(tokens[s:e] * powers(e - s + 1, 0xD1342543DE82EF95)[1:]).sum() + np.uint64(e - s)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def _minhashes(grams: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, 2**64 - 1, np.uint64)
    for i in range(0, len(grams), SHINGLES_AT_ONCE):
        np.minimum(out, (grams[None, i : i + SHINGLES_AT_ONCE] * _MULTIPLIERS[:n, None]).min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, halves: int, rows: int) -> DataFrame:
    """(doc_id, n, s1, s2, halves): the set's size, its 128-bit identity, and its 2 * halves half keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, keys = [], [], [], []
            for grams in shingle_sets(*string_buffers(batch.column(1)), width):
                n.append(len(grams))
                s1.append(int(mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                s2.append(int((grams * _MULTIPLIERS[255]).sum(dtype=np.uint64).view(np.int64)))
                m = _minhashes(grams, 2 * halves * rows).reshape(2 * halves, rows)
                keys.append(mix((m * _C[1 : rows + 1]).sum(axis=1, dtype=np.uint64)).view(np.int64))
            flat = np.concatenate([np.zeros(0, np.int64), *keys])
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, 2 * halves, dtype=np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), lists], ["doc_id", "n", "s1", "s2", "halves"])

    return docs.select(id_col, text_col).mapInArrow(sign, "doc_id bigint, n bigint, s1 bigint, s2 bigint, halves array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc_id, grams): the shingle sets of the wanted documents (doc_id), and of few others, made where the texts are.

    Which documents are wanted goes to the texts as a table of bits, one for each hash of an id. It has BITS bits at most:
    where more documents are wanted than fit, more sets are made for nothing, and none is missing.
    """
    bits = power_of_two(8 * wanted.count(), 1 << 16, BITS)
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits)).cast("int")
    words = wanted.select(F.floor(at / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), at % 64).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).collect()
    table = np.zeros(bits // 64, np.int64)
    table[[r.word for r in words]] = [r.bit for r in words]
    held = docs.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(2).to_numpy()
            batch = batch.take(pa.array(np.flatnonzero(held.value[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1))))
            sets = [x.view(np.int64) for x in shingle_sets(*string_buffers(batch.column(1)), width)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))], ["doc_id", "grams"])

    return docs.where("doc_id is not null").select("doc_id", "text", at).mapInArrow(collect, "doc_id bigint, grams array<bigint>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b, centre) those whose full sets are as similar as asked. A centre that many pairs name is sent
    to several tasks, so that its pairs don't meet in one."""
    other = pairs.select("a", "b", "centre", F.when(F.col("centre") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("doc"))
    blocks = pairs.groupBy("centre").agg(F.ceil(F.count("*") / CENTRE_PAIRS).cast("int").alias("blocks")).repartition(F.xxhash64("centre"))
    dealt = other.join(blocks, "centre").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).drop("blocks")
    centres = sets.select(F.col("doc_id").alias("centre"), F.col("grams").alias("ga")).join(blocks, "centre").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    joined = dealt.join(sets.select(F.col("doc_id").alias("doc"), F.col("grams").alias("gb")), "doc").join(centres, ["centre", "block"])
    common = joined.select("a", "b", (F.size("ga") + F.size("gb")).alias("both"), F.size(F.array_intersect("ga", "gb")).alias("common"))
    return common.where((F.lit(100) + percent) * F.col("common") >= F.col("both") * percent).select("a", "b")


def _by_rare(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, centre) of different components of members (doc_id, n, component) that share rare shingles, and (doc_id, u).

    Let u be how many of a set's shingles are common, in COMMON sets or more. Two sets that share r rare shingles, which
    fewer than COMMON sets have, have at most r + min(u, u') in common: pairs for which that is too few are left out. So a
    pair that links either is here, or both its sets have enough common ones for their sizes without any rare one; that is
    seldom for near copies that differ in places of their own. Where an id has several texts, r and u count all of them.
    """
    held = sets.join(members.repartition(F.xxhash64("doc_id")), "doc_id").select("doc_id", "n", "component", F.explode("grams").alias("gram"))
    counted = cut_few(held.groupBy("gram").agg(F.count("*").alias("n_docs")).where("n_docs > 1"))
    total = counted.agg(F.sum("n_docs")).first()[0] or 0
    # Of shingles with so large a share there are as many as HOT at most: they are broadcast, and no task gets all of one's sets.
    hot = F.broadcast(counted.where(F.col("n_docs") >= max(COMMON, total / HOT)).select("gram"))
    rest = held.join(hot, "gram", "left_anti")
    rare = rest.join(counted.where(F.col("n_docs") < COMMON).select("gram"), "gram")
    other = rare.select("gram", F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("component").alias("its"))
    pairs = rare.withColumnRenamed("doc_id", "a").join(other, "gram").where((F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & F.expr("a < b and component <> its"))
    often = rest.join(counted.where(F.col("n_docs") >= max(COMMON, 2)).select("gram"), "gram").select("doc_id").unionByName(held.join(hot, "gram").select("doc_id"))
    common = cut_few(often.groupBy("doc_id").agg(F.count("*").alias("u")))
    shared = pairs.groupBy("a", "b").agg(F.count("*").alias("r"), (F.min("n") + F.min("m")).alias("both"))
    for end in ("a", "b"):
        shared = shared.join(common.select(F.col("doc_id").alias(end), F.col("u").alias(f"u_{end}")), end, "left")
    most = F.col("r") + F.least(F.coalesce("u_a", F.lit(0)), F.coalesce("u_b", F.lit(0)))
    return shared.where(most * (100 + percent) >= F.col("both") * percent).select("a", "b", F.col("a").alias("centre")), common


def _star(now: DataFrame, turn: int, centres: int) -> DataFrame:
    """now with is_centre: in each bucket the row of least rank, and about `centres` rows if that is more than one."""
    sizes = now.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("rank", "doc_id")).alias("first")).repartition(F.xxhash64("key"))
    first = F.col("doc_id") == F.col("first.doc_id")
    chosen = first | (F.pmod(F.xxhash64("key", "doc_id", F.lit(turn)), F.col("m")) < centres) if centres > 1 else first
    return now.join(sizes, "key").withColumn("is_centre", chosen).drop("m", "first")


def _met(starred: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, centre) of each bucket's centres with all of its rows that may link and are of other components."""
    u = [F.col("u").alias("uc")] * ("u" in starred.columns)
    centres = starred.where("is_centre").select("key", F.col("doc_id").alias("centre"), F.col("n").alias("nc"), F.col("component").alias("its"), *u).repartition(F.xxhash64("key"))
    fits = (F.least("n", "nc") * 100 >= F.greatest("n", "nc") * percent) & F.expr("component <> its and doc_id <> centre and (not is_centre or doc_id < centre)")
    if u:
        fits &= F.least("u", "uc") * (100 + percent) >= (F.col("n") + F.col("nc")) * percent
    pairs = starred.join(centres, "key").where(fits)
    return pairs.select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b"), "centre")


def dedup_minhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Documents link if their sets of word shingles (A-Z lower-cased) have a Jaccard similarity of percent / 100 or more.
    Documents with equal sets are one class, and only classes are compared. Texts without words, null texts and rows
    without an id link with nothing and are kept; their component_id is their own id. Rows with equal ids are one
    document with several texts. Only the two named columns are read.
    """
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(signatures(named, "doc_id", "text", width, halves, rows))
    able = signed.where("n > 0 and doc_id is not null")
    classes = cut_few(able.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")))
    reps = able.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")

    # Half keys that only one class has can't make a shared table key.
    # They are shuffled once: what is told of them reads the same columns, so that it reads the same shuffle.
    held = reps.select("doc_id", "n", F.posexplode("halves").alias("place", "half")).repartition("place", "half")
    shared = held.groupBy("place", "half").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("n").alias("most")).where("lo < hi and most > 0").select("place", "half")
    live = held.join(shared, ["place", "half"]).groupBy("doc_id", "n").agg(F.collect_set(F.struct("place", "half")).alias("live"))
    first, second = F.filter("live", lambda x: x["place"] < halves), F.filter("live", lambda x: x["place"] >= halves)
    tables = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x["place"], x["half"], y["place"], y["half"]))))
    keyed = live.select("doc_id", "n", F.explode(tables).alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").repartition(F.xxhash64("key"))
    # The more documents of all its buckets a document meets, the sooner it is a centre: of near copies of a text, the text.
    keyed = cut_few(keyed.join(crowded, "key").withColumn("rank", -F.sum("c").over(Window.partitionBy("doc_id"))).drop("c"))

    wanted = keyed.select("doc_id").distinct()
    # A set has 8 bytes a shingle; every round's joins read the buckets where they lie.
    buckets = power_of_two(8 * (able.agg(F.sum("n")).first()[0] or 0) / BYTES_PER_BUCKET, 16)
    sets = bucketed(_sets(named, wanted, width).repartition(buckets, "doc_id"), "doc_id", buckets)
    tested = labels = None
    turn, centres, common_only = 0, 1, False
    while True:
        tidy(docs.sparkSession)
        if labels is None:
            now = keyed.withColumn("component", F.col("doc_id"))
        else:
            # Buckets whose rows are all of one component are done.
            now = keyed.join(labels.withColumnRenamed("node", "doc_id").repartition(F.xxhash64("doc_id")), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
            mixed = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key").repartition(F.xxhash64("key"))
            now = cut_few(now.join(mixed, "key"))
            release(keyed)
            if now.isEmpty():
                break
            if turn == 1:
                # Every further round reads the sets of what is left alone.
                old, sets = sets, bucketed(sets.join(now.select("doc_id").distinct().repartition(F.xxhash64("doc_id")), "doc_id", "left_semi"), "doc_id", buckets)
                release(old)
        if turn == STAR_ROUNDS and not common_only:
            met, common = _by_rare(now.select("doc_id", "n", "component").distinct(), sets, percent)
            counted = now.drop("component").join(common.repartition(F.xxhash64("doc_id")), "doc_id")
            least = counted.groupBy("key").agg(F.min("n").alias("least")).repartition(F.xxhash64("key"))
            enough = F.col("u") * (100 + percent) >= (F.col("n") + F.greatest(F.col("least"), F.col("n") * percent / 100)) * percent
            keyed, common_only, starred, centres = cut_few(counted.join(least, "key").where(enough).drop("least")), True, None, CENTRES
        else:
            starred = cut_few(_star(now, turn, centres))
            met = _met(starred, percent)
        met = met.groupBy("a", "b").agg(F.min("centre").alias("centre"))
        met = cut_few(met if tested is None else met.join(tested, ["a", "b"], "left_anti"))
        release(now)
        if starred is not None:
            # The centres have met all rows of their buckets.
            keyed = cut_few(starred.where("not is_centre").drop("is_centre", "component"))
            release(starred)
            turn, centres = turn + 1, 8 * centres if common_only else 1
        pairs = met.select("a", "b")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = cut_few(_confirmed(met, sets, percent))
        if labels is None or not found.isEmpty():
            # Labels are links to the smallest of each component, and stand for all links of earlier rounds.
            links = found if labels is None else found.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
            old, labels = labels, cut_few(components(links))
            release(*[old] * (old is not None))
        release(found)
    release(sets, tested)
    tidy(docs.sparkSession)

    named_classes = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"), "members", "rep")
    known = named_classes.where("members > 1 or component <> rep").select("s1", "s2", "component").repartition(F.xxhash64("s1", "s2"))
    rest = signed.where("n = 0 or doc_id is null").select("doc_id", "n", F.lit(None).cast("bigint").alias("component"))
    out = able.join(known, ["s1", "s2"], "left").select("doc_id", "n", "component").unionByName(rest)
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
