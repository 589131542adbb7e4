"""Provider records as one candidate schema: JSON in, columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeproof.functions.text import provider_doi, strip, text_of_positions
from citeproof.operators.retraction import crossref_retracted, retracted_title

OPENALEX = "struct<doi:string,title:string,display_name:string,publication_year:int,is_retracted:boolean,cited_by_count:bigint,abstract_inverted_index:map<string,array<int>>,authorships:array<struct<author:struct<display_name:string>>>>"
CROSSREF = "struct<DOI:string,title:array<string>,publisher:string,type:string,`update-to`:array<struct<type:string>>,author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<int>>>>"
SEMANTIC = "struct<title:string,year:int,venue:string,abstract:string,isRetracted:boolean,externalIds:struct<DOI:string,ArXiv:string>,authors:array<struct<name:string>>>"


def openalex_works(raw: DataFrame, json: str = "json") -> DataFrame:
    w = F.from_json(json, OPENALEX)
    df = raw.withColumn("_w", w).withColumn("title", F.coalesce("_w.title", "_w.display_name"))
    return df.select(
        *[c for c in raw.columns if c != json],
        "title",
        provider_doi(F.col("_w.doi")).alias("doi"),
        F.transform("_w.authorships", lambda a: a["author"]["display_name"]).alias("authors"),
        F.col("_w.publication_year").alias("year"),
        F.lit(None).cast("string").alias("venue"),
        F.when(F.col("_w.abstract_inverted_index").isNotNull(), text_of_positions(F.col("_w.abstract_inverted_index"))).otherwise("").alias("abstract"),
        (F.coalesce("_w.is_retracted", F.lit(False)) | retracted_title(F.col("title"), "openalex")).alias("is_retracted"),
        F.col("_w.cited_by_count").alias("cited_by_count"),
        F.lit("OpenAlex").alias("source"),
    )


def crossref_works(raw: DataFrame, json: str = "json", by_doi: bool = False) -> DataFrame:
    df = raw.withColumn("_w", F.from_json(json, CROSSREF)).withColumn("title", F.get("_w.title", F.lit(0)))
    updates = F.transform(F.col("_w.update-to"), lambda u: u["type"])
    retracted = crossref_retracted(F.col("title"), updates, F.col("_w.type")) if by_doi else retracted_title(F.col("title"), "crossref_title")
    return df.select(
        *[c for c in raw.columns if c != json],
        "title",
        F.lower("_w.DOI").alias("doi"),
        F.transform("_w.author", lambda a: strip(F.concat_ws(" ", a["given"], a["family"]))).alias("authors"),
        F.get(F.get("_w.issued.date-parts", F.lit(0)), F.lit(0)).alias("year"),
        F.col("_w.publisher").alias("venue"),
        F.lit("").alias("abstract"),
        retracted.alias("is_retracted"),
        F.lit("Crossref").alias("source"),
    )


def semantic_scholar_works(raw: DataFrame, json: str = "json") -> DataFrame:
    df = raw.withColumn("_w", F.from_json(json, SEMANTIC))
    return df.select(
        *[c for c in raw.columns if c != json],
        "_w.title",
        F.lower(F.coalesce("_w.externalIds.DOI", "_w.externalIds.ArXiv")).alias("doi"),
        F.filter(F.transform("_w.authors", lambda a: a["name"]), lambda n: n != "").alias("authors"),
        "_w.year",
        "_w.venue",
        F.coalesce("_w.abstract", F.lit("")).alias("abstract"),
        F.coalesce("_w.isRetracted", F.lit(False)).alias("is_retracted"),
        F.lit("Semantic Scholar").alias("source"),
    )
