"""From the path of manuscripts to their reports, in one call; and one citation by itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeproof.operators import report as P
from citeproof.operators.audit import VERDICT, audit, report, verify
from citeproof.operators.extract import arxiv_citations, extract_citations
from citeproof.operators.retraction import known_retractions, load_retractions, retraction_dimension
from citeproof.sources.connectors import Connection, ask_providers
from citeproof.sources.files import kind_of_target, read_documents, read_papers
from citeproof.sources.reports import write_reports
from citeproof.storage import checkpointed

#: How a kind of failure is told to the user.
TOLD = {"HTTP_429": "RATE_LIMIT", "TIMEOUT": "PROVIDER_ERROR", "NETWORK": "PROVIDER_ERROR", "NOT_JSON": "PROVIDER_ERROR", "NO_ANSWER": "PROVIDER_ERROR"}


@dataclass
class Audited:
    """results: a row per citation; summary: a row per manuscript, also for those without citations; errors: (doc_id,
    status, error) of files that could not be read and of providers that could not be asked."""

    results: DataFrame
    summary: DataFrame
    errors: DataFrame

    def write(self, path: str, extension: str = ".md", mode: str = "append") -> None:
        """A report for each manuscript that has citations: .md or .html."""
        texts = P.html(self.results) if extension == ".html" else P.markdown(self.results)
        write_reports(texts.toDF("doc_id", "text"), path, extension, mode)


def _retractions(spark: SparkSession, path: str | None) -> DataFrame:
    records = load_retractions(spark, path) if path else known_retractions(spark).withColumn("seq", F.lit(-1).cast("bigint"))
    return retraction_dimension(records)


def audit_path(spark: SparkSession, path: str, refs: str | None = None, net: Connection = Connection(), retractions: str | None = None) -> Audited:
    """The audit of a manuscript, of all manuscripts below a folder, or of an arXiv target.

    refs: a folder of reference papers; retractions: a table of retraction.save_retractions. Files that can't be read are
    errors and do not stop the others; providers that can't be asked leave their citations PROVIDER_UNAVAILABLE.
    """
    if kind_of_target(path) == "arxiv":
        found = arxiv_citations(spark.createDataFrame([(path,)], "target string")).select(F.col("target").alias("doc_id"), F.lit(1).alias("line_no"), "citation_id", "raw_text", "doi", "title", F.array().cast("array<string>").alias("authors"), F.lit(None).cast("int").alias("year"), "location_info", "claim", "context")
        docs = found.select("doc_id", F.lit(None).cast("string").alias("error"))
    else:
        docs = read_documents(spark, path)
        found = extract_citations(docs.where("text is not null"))
    cited = checkpointed(found.withColumn("citation_key", F.concat_ws(":", "doc_id", "line_no")))
    gone = _retractions(spark, retractions)
    verdicts = checkpointed(verify(cited, gone, **ask_providers(cited, gone, net)))
    results = checkpointed(audit(cited, verdicts, read_papers(spark, refs) if refs else None))
    summary = docs.where("error is null").select("doc_id").join(report(results), "doc_id", "left").na.fill(0)
    unread = docs.where("error is not null").select("doc_id", F.lit("PARSER_ERROR").alias("status"), "error")
    told = F.lit("PROVIDER_ERROR")
    for failure, status in TOLD.items():
        told = F.when(F.col("failure_reason") == failure, status).otherwise(told)
    unasked = results.where("failure_reason is not null").groupBy("doc_id", told.alias("status")).agg(F.concat(F.count("*"), F.lit(" citations: "), F.array_join(F.array_sort(F.collect_set("failure_reason")), ", ")).alias("error"))
    return Audited(results, summary, unread.unionByName(unasked))


def verify_text(spark: SparkSession, text: str, net: Connection = Connection(), retractions: str | None = None) -> DataFrame:
    """The verdict on one title, raw citation or DOI: the columns of audit.verify."""
    doi = text.strip() if "10." in text else None
    one = spark.createDataFrame([("1", "" if doi else text, doi, text, [], None)], "citation_key string, title string, doi string, raw_text string, authors array<string>, year int")
    gone = _retractions(spark, retractions)
    return verify(one, gone, **ask_providers(one, gone, net)).select(VERDICT)
