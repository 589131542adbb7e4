"""Retractions: the dimension, its lookup, and what providers say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeproof.functions.text import contains_any, normalize_doi
from citeproof.lexicons import KNOWN_RETRACTIONS, RETRACTED_TITLE


def known_retractions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN_RETRACTIONS, "doi string, title string, journal string, date string, reason string")


def save_retractions(records: DataFrame, path: str) -> None:
    """Add records (doi, title, journal, date, reason, seq) to the table at path; retraction_dimension takes the last of each DOI."""
    records.select("doi", "title", "journal", "date", "reason", "seq").write.mode("append").parquet(path)


def load_retractions(spark: SparkSession, path: str) -> DataFrame:
    """The records at path over the known ones, which come first."""
    known = known_retractions(spark).withColumn("seq", F.lit(-1).cast("bigint"))
    return known.unionByName(spark.read.schema(known.schema).parquet(path))


def retraction_dimension(records: DataFrame, order: str = "seq") -> DataFrame:
    """records by normalized DOI; the last record of a DOI counts, and those without a DOI don't."""
    last = F.row_number().over(Window.partitionBy("doi").orderBy(F.desc(order)))
    return records.withColumn("doi", normalize_doi(F.col("doi"))).where("doi is not null").withColumn("_n", last).where("_n = 1").drop("_n")


def with_retractions(citations: DataFrame, dimension: DataFrame, doi: str = "doi") -> DataFrame:
    """citations with norm_doi and retraction (the dimension's row, null where there is none).

    A left join by equality on the normalized DOI; which side is broadcast is left to sizes.
    """
    facts = dimension.select(F.col("doi").alias("norm_doi"), F.struct("*").alias("retraction"))
    return citations.withColumn("norm_doi", normalize_doi(F.col(doi))).join(facts, "norm_doi", "left")


def retracted_title(title: Column, kind: str = "merged") -> Column:
    return contains_any(F.lower(title), RETRACTED_TITLE[kind])


def crossref_retracted(title: Column, update_types: Column, kind: Column) -> Column:
    """A retraction among the updates, in the title, or as the work's type."""
    return F.coalesce(F.exists(update_types, lambda t: t == "retraction"), F.lit(False)) | retracted_title(title, "crossref_doi") | F.coalesce(kind.isin("retraction", "retracted-article"), F.lit(False))


def merge_providers(first: DataFrame, second: DataFrame, key: str = "doi") -> DataFrame:
    """One row per DOI that either provider has: the first title that isn't empty, retracted if either says so or the title
    does, the first provider's abstract, and which providers know it (provenance)."""
    a = first.select(key, *[F.col(c).alias(f"a_{c}") for c in ("title", "is_retracted", "abstract")], F.lit(True).alias("a_has"))
    b = second.select(key, *[F.col(c).alias(f"b_{c}") for c in ("title", "is_retracted")], F.lit(True).alias("b_has"))
    both = a.join(b, key, "full_outer")
    title = F.coalesce(F.when(F.col("a_title") != "", F.col("a_title")), F.col("b_title"))
    no = F.lit(False)
    flag = F.coalesce("a_is_retracted", no) | F.coalesce("b_is_retracted", no) | retracted_title(title)
    provenance = F.concat_ws("+", F.when(F.col("a_has"), "openalex"), F.when(F.col("b_has"), "crossref"))
    return both.select(key, title.alias("title"), flag.alias("is_retracted"), F.coalesce("a_abstract", F.lit("")).alias("abstract"), provenance.alias("provenance"))


def retraction_label(doi: Column, hit: Column) -> Column:
    """What a lookup says about a DOI."""
    return F.when(F.coalesce(doi, F.lit("")) == "", "INVALID_INPUT").when(hit, "RETRACTED").when(normalize_doi(doi).isNull(), "NOT_A_DOI").otherwise("NO_RETRACTION_FOUND")
