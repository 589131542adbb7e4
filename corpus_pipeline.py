"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing to target weights, and tokens.

Every stage takes all that its predecessor kept and returns the columns of documents, but for the last one, which returns
a row of token counts and digests per document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeproof.llm.bpe import encode_decode
from citeproof.llm.line_dedup import dedup_lines
from citeproof.llm.minhash_dedup import dedup_minhash
from citeproof.llm.mixing import mix_sources
from citeproof.llm.quality_rules import keep_quality
from citeproof.llm.runtime import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can't encode by a vocabulary; the tests hold the stages against brute force.
ORACLE_SQL = None


def _with_text(out: DataFrame) -> DataFrame:
    """The columns of documents from (doc, kept_text, n_removed); n_chars follows where a text has changed."""
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("doc.n_chars"))
    return out.select("doc.doc_id", F.col("kept_text").alias("text"), "doc.lang", "doc.source", n_chars.cast("bigint").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines above the limits of their host."""
    return _with_text(keep_quality(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without cross-site boilerplate lines."""
    return _with_text(dedup_lines(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Of rows that repeat an id and a text one stays."""
    gone = dedup_minhash(docs).where("not kept").select("doc_id").distinct()
    left = docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if twice.isEmpty():
        return left
    single = left.join(twice, "doc_id", "left_anti").select(COLUMNS)
    return single.unionByName(left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix; the last stage names each one's place in it."""
    return mix_sources(docs).orderBy("slot", "start", "doc_id").select(*[f"doc.{c}" for c in COLUMNS])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, and its place in the mix: slot and start.

    Rows that are read again may come in any order, and the columns of documents have no place for it. A document's place
    follows from ids, sources and lengths alone, so it is told again here; sorted by it, the rows are the mix.
    """
    import public_tokenizers

    placed = mix_sources(docs).select("doc.doc_id", "doc.text", "slot", "start")
    return encode_decode(placed, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["slot", "start"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("mix", mix),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole of documents; what a stage keeps is written once before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
