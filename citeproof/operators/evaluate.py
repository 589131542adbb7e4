"""Evaluation metrics and retrieval baselines."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeproof.functions.similarity import nearest_rows
from citeproof.functions.text import words_from
from citeproof.storage import written


def confusion(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """(label, tp, fp, fn) of pairs (gold, pred), one row per label; one pass over the pairs."""
    each = pairs.select("gold", "pred", F.explode(F.array(*map(F.lit, labels))).alias("label"))
    is_gold, is_pred = F.col("gold").eqNullSafe(F.col("label")), F.col("pred").eqNullSafe(F.col("label"))
    return each.groupBy("label").agg(F.count_if(is_gold & is_pred).alias("tp"), F.count_if(~is_gold & is_pred).alias("fp"), F.count_if(is_gold & ~is_pred).alias("fn"))


def precision_recall_f1(counts: DataFrame, least: float = 1e-6) -> DataFrame:
    """counts (tp, fp, fn) with precision, recall and f1; empty denominators count as 1."""
    df = counts.withColumns({"precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), "recall": F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))})
    return df.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(least)))


def with_default(gold: DataFrame, predictions: DataFrame, key: str, default: str = "NEUTRAL") -> DataFrame:
    """gold with its prediction; the default where there is none."""
    return gold.join(predictions, key, "left").withColumn("pred", F.coalesce("pred", F.lit(default)))


def strongest_label(labels: Column) -> Column:
    """Of a set of evidence labels the one that counts."""
    return F.when(F.array_contains(labels, "SUPPORT"), "SUPPORTS").when(F.array_contains(labels, "CONTRADICT"), "CONTRADICTS").otherwise("NEUTRAL")


def gold_label(state: Column) -> Column:
    return F.when(state.isin("SUPPORTED", "PARTIAL"), "SUPPORTS").when(state == "CONTRADICTED", "CONTRADICTS").otherwise("NEUTRAL")


def threshold_label(score: Column, supports: float, neutral: float) -> Column:
    """SUPPORTS from `supports` on, NEUTRAL up to `neutral`, and SUPPORTS between them."""
    return F.when(score >= supports, "SUPPORTS").when(score <= neutral, "NEUTRAL").otherwise("SUPPORTS")


def ranking_metrics(ranks: DataFrame) -> DataFrame:
    """top1, mrr and recall5 of ranks (rank of the right one, null if it isn't there)."""
    return ranks.agg(F.count("*").alias("n"), F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("top1"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.avg(F.when(F.col("rank") <= 5, 1.0).otherwise(0.0)).alias("recall5"))


def abstention_accuracy(results: DataFrame) -> DataFrame:
    """Of results (expected, found: ids, null for none) how many ask for no answer, how many of these got none, and the share."""
    none = F.col("expected").isNull()
    right = F.count_if(none & F.col("found").isNull())
    return results.agg(F.count_if(none).alias("n_abstain"), right.alias("abstained"), F.try_divide(right, F.count_if(none)).alias("abstention_accuracy"))


def detection_counts(results: DataFrame) -> DataFrame:
    """Of results (kind: retracted, fake or real; status; matched) the retracted ones detected, the fakes rejected and the real ones matched."""
    kind, matched = F.col("kind"), F.coalesce("matched", F.lit(False))
    return results.agg(F.count("*").alias("total"), F.count_if((kind == "retracted") & (F.col("status") == "RETRACTED")).alias("retracted_detected"), F.count_if((kind == "fake") & ~matched).alias("fake_rejected"), F.count_if((kind == "real") & matched).alias("matched_count"))


def mean_token_lengths(texts: DataFrame, *columns: str) -> DataFrame:
    """The mean number of words, between white space, of each text column; empty and null texts have none."""
    n = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    return texts.agg(*[F.avg(n(c)).alias(f"mean_{c}") for c in columns])


def evidence_pairs(claims: DataFrame, corpus: DataFrame) -> DataFrame:
    """(claim_id, claim, doc_id, label, title, abstract): claims (claim_id, claim, evidence: map of doc_id to labels,
    cited: doc_ids) with the documents of the corpus that they name. The first label of the evidence counts, NEUTRAL where
    a document is cited without; documents that the corpus lacks are dropped."""
    named = claims.select("claim_id", "claim", F.explode(F.array_distinct(F.concat(F.coalesce(F.map_keys("evidence"), F.array().cast("array<string>")), F.coalesce("cited", F.array().cast("array<string>"))))).alias("doc_id"), "evidence")
    label = F.coalesce(F.get(F.try_element_at("evidence", F.col("doc_id")), F.lit(0)), F.lit("NEUTRAL"))
    return named.select("claim_id", "claim", "doc_id", label.alias("label")).join(corpus.select("doc_id", "title", "abstract"), "doc_id")


def timed(run: Callable[[], int]) -> dict[str, float]:
    """Seconds, items a second and milliseconds an item of run(), which returns how many items it went through."""
    began = time.perf_counter()
    n = run()
    took = time.perf_counter() - began
    return {"items": n, "seconds": took, "qps": n / max(took, 1e-9), "ms_per_item": 1000 * took / max(n, 1)}


def observed(rows: DataFrame, observation: Observation, latency: str = "ms", failure: str | None = "failure") -> DataFrame:
    """The same rows; the query that reads them also counts them and tells their latencies, without a pass of its own.

    After that query observation.get has n, failures, total, p50, p99 and most: milliseconds of column latency, quantiles
    within 1/10,000 of the rows. Without rows all but the counts are null. Read the result once, written say: a query that
    runs it again is not counted again.
    """
    failures = F.count(failure) if failure else F.lit(0).cast("bigint") * F.count("*")
    quantile = lambda q: F.percentile_approx(latency, q, 10000)
    return rows.observe(observation, F.count("*").alias("n"), failures.alias("failures"), F.sum(latency).alias("total"), quantile(0.5).alias("p50"), quantile(0.99).alias("p99"), F.max(latency).alias("most"))


def latency_sketches(rows: DataFrame, by: list[str], latency: str = "ms") -> DataFrame:
    """(*by, n, total, sketch) of latencies: small rows that can be kept, and merged over any groups by merged_latencies."""
    given = rows.where(F.col(latency).isNotNull())
    return given.groupBy(by).agg(F.count("*").alias("n"), F.sum(latency).alias("total"), F.kll_sketch_agg_double(F.col(latency).cast("double")).alias("sketch"))


def merged_latencies(sketches: DataFrame, by: list[str], at_once: int = 1) -> DataFrame:
    """(*by, n, mean, qps, p50, p99) from kept sketches; qps is for at_once requests at a time that never pause."""
    merged = sketches.groupBy(by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch").alias("sketch"))
    quantile = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(q))
    per_second = F.col("n") * F.lit(1000.0 * at_once) / F.when(F.col("total") > 0, F.col("total"))
    return merged.select(*by, "n", (F.col("total") / F.col("n")).alias("mean"), per_second.alias("qps"), quantile(0.5).alias("p50"), quantile(0.99).alias("p99"))


def term_counts(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf) of the words of two or more characters."""
    return texts.select(key, F.explode(words_from(F.col(text), 2)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def idf(terms: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf) with ln((n + 1) / (df + 1)) + 1; n_docs has the one row (n)."""
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n_docs)).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def tfidf_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame, weights: DataFrame, a: str, b: str) -> DataFrame:
    """pairs (a, b) with the cosine of their term vectors; terms without a weight have 1.

    left and right are term counts by a and by b. Norms are made once for each text, and only shared terms are joined.
    """

    def weighted(terms: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
        w = terms.join(weights.select("term", "idf"), "term", "left").select(key, "term", (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias(name))
        return w, w.groupBy(key).agg(F.sqrt(F.sum(F.col(name) * F.col(name))).alias(f"norm_{name}"))

    (x, nx), (y, ny) = weighted(left, a, "x"), weighted(right, b, "y")
    dots = pairs.join(x, a).join(y, [b, "term"]).groupBy(a, b).agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    return pairs.join(dots, [a, b], "left").join(nx, a, "left").join(ny, b, "left").select(a, b, F.coalesce(F.col("dot") / (F.col("norm_x") * F.col("norm_y")), F.lit(0.0)).alias("score"))


def bm25(pairs: DataFrame, queries: DataFrame, texts: DataFrame, weights: DataFrame, lengths: DataFrame, a: str, b: str, k1: float = 1.5, b_: float = 0.75) -> DataFrame:
    """pairs (a, b) with the score of text b for query a over the query's distinct terms; terms without a weight have 0.

    lengths: (b, length, avg_length).
    """
    wanted = queries.select(a, "term").join(weights.select("term", "idf"), "term")
    hits = pairs.join(wanted, a).join(texts, [b, "term"]).join(lengths, b)
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b_ + b_ * F.col("length") / F.greatest("avg_length", F.lit(1.0))))
    scores = hits.groupBy(a, b).agg(F.sum(part).alias("score"))
    return pairs.join(scores, [a, b], "left").select(a, b, F.coalesce("score", F.lit(0.0)).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors of numbers, held to 0..1; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norms))).otherwise(0.0)


#: Numbers of the vectors that meet at once in a task, of either side: 4 MB as doubles.
BLOCK = 2**19
#: Tasks that blocks are dealt to; few bytes make much work, so Spark must not put them together.
TASKS = 200


def nearest(vectors: DataFrame, queries: DataFrame, limit: int = 5, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, c): the `limit` of vectors (label, vec_id, embedding) that are nearest by cosine to each of
    queries (label, query_id, q), among those of its label with another id. Of equals the smaller vec_id is first.

    Every pair of a label is compared: its vectors and its queries are cut into blocks by their ids' hashes, each block of
    the one meets each block of the other in a task, and of a pair of blocks only `limit` rows a query go on.
    """

    def parts(df: DataFrame, vector: str, name: str) -> DataFrame:
        numbers = F.count("*") * F.greatest(F.max(F.size(vector)), F.lit(1))
        return df.groupBy("label").agg(F.greatest(F.ceil(numbers / block), F.lit(1)).alias(name))

    v, q = vectors.where("vec_id is not null and label is not null"), queries.where("query_id is not null and label is not null")
    v, q = v.select("label", "vec_id", "embedding"), q.select("label", "query_id", "q")
    cut = parts(v, "embedding", "_nv").join(parts(q, "q", "_nq"), "label")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    own = lambda n, *what: F.pmod(F.xxhash64(*what), n)
    key = lambda side: [f"_{side}_label", f"_{side}_v", f"_{side}_q"]
    v = v.join(cut, "label").select(F.col("label").alias("_a_label"), "vec_id", "embedding", own("_nv", "vec_id", "embedding").alias("_a_v"), each("_nq").alias("_a_q"))
    q = q.join(cut, "label").select(F.col("label").alias("_b_label"), "query_id", "q", own("_nq", "query_id", "q").alias("_b_q"), each("_nv").alias("_b_v"))
    met = v.repartition(TASKS, *key("a")).groupBy(*key("a")).cogroup(q.repartition(TASKS, *key("b")).groupBy(*key("b")))
    best = met.applyInArrow(lambda a, b: nearest_rows(a, b, limit), "query_id bigint, vec_id bigint, c double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("c"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", "vec_id", "c")


def batches(df: DataFrame, order: str, size: int = 55) -> DataFrame:
    """df with batch, in runs of `size` by the order column, numbered without gathering the rows in one task."""
    # Written once: both branches must see the same parts.
    parts = written(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return parts.withColumn("_i", inside).join(F.broadcast(before), "_part").withColumn("batch", F.floor((F.col("_before") + F.col("_i")) / size)).drop("_part", "_i", "_before")
