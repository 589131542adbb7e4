"""Requests to the providers and their answers as tables: addresses, one request a key, a cache in between, records out."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeproof.functions.text import arxiv_id, blank_as_null, cache_key, looks_like_doi, normalize_doi, provider_doi, quoted, strip
from citeproof.operators.audit import query_text
from citeproof.operators.cache import Table, read_through
from citeproof.operators.resolve import union_candidates
from citeproof.operators.retraction import merge_providers
from citeproof.sources.fetch import Policy, fetch
from citeproof.sources.providers import crossref_works, openalex_works, semantic_scholar_works
from citeproof.storage import checkpointed

#: The providers' public addresses, and the fields that are asked for.
OPENALEX, CROSSREF, SEMANTIC = "https://api.openalex.org/works", "https://api.crossref.org/works", "https://api.semanticscholar.org/graph/v1/paper/search"
SEMANTIC_FIELDS = "title,authors,year,externalIds,abstract,isRetracted,venue"


@dataclass(frozen=True)
class Connection:
    """Where and how to ask: addresses, the mailbox that providers ask polite users for, the cache, and the limits that
    hold for all partitions together."""

    openalex: str = OPENALEX
    crossref: str = CROSSREF
    semantic: str = SEMANTIC
    mailto: str | None = None
    cache: Table | None = None
    #: Takes a kind of request and its answers (key, json, failure, ms), and returns them: see evaluate.observed.
    watch: Callable[[str, DataFrame], DataFrame] | None = None
    policy: Policy = field(default_factory=Policy)
    at_once: int = 5
    per_second: float | None = None
    limit: int = 5
    opener: Callable | None = None

    def _with(self, url: Column, *parameters: Column) -> Column:
        more = [*parameters, *([F.concat(F.lit("mailto="), quoted(F.lit(self.mailto)))] if self.mailto else [])]
        return F.concat_ws("?", url, F.concat_ws("&", *more)) if more else url

    def address(self, kind: str, value: Column) -> Column:
        """What is asked for a DOI, an arXiv id or a title."""
        n = lambda name, k: F.lit(f"{name}={k}")
        one = lambda name: F.concat(F.lit(f"{name}="), quoted(value))
        return {
            "openalex_doi": lambda: self._with(F.concat(F.lit(f"{self.openalex}/doi:"), quoted(value))),
            "openalex_arxiv": lambda: self._with(F.lit(self.openalex), one("search"), n("per_page", 1)),
            "openalex_title": lambda: self._with(F.lit(self.openalex), one("search"), n("per_page", self.limit)),
            "crossref_doi": lambda: self._with(F.concat(F.lit(f"{self.crossref}/"), quoted(value))),
            "crossref_title": lambda: self._with(F.lit(self.crossref), one("query.title"), n("rows", self.limit)),
            "semantic_title": lambda: F.concat(F.lit(f"{self.semantic}?"), F.concat_ws("&", one("query"), n("limit", self.limit), F.lit(f"fields={SEMANTIC_FIELDS}"))),
        }[kind]()

    def ask(self, values: DataFrame, kind: str) -> DataFrame:
        """(value, json, failure) for the different values: from the cache where it knows, else asked for once each."""
        spark = values.sparkSession
        own = [F.col("value"), F.lit(str(self.limit))] if kind.endswith("title") else [F.col("value")]
        asked = values.select("value").where("value <> ''").distinct().withColumns({"key": cache_key(kind, *own), "url": self.address(kind, F.col("value"))})
        # Cache keys ignore case and outer blanks, and so may fewer keys than values be asked for.
        now = F.lit(int(time.time()))

        def get(missing: DataFrame) -> DataFrame:
            asked_for = fetch(missing, self.at_once, self.policy, self.opener, self.per_second)
            return (self.watch(kind, asked_for) if self.watch else asked_for).withColumnRenamed("json", "value")

        requests = checkpointed(asked)
        entries = self.cache.entries(requests) if self.cache else spark.createDataFrame([], Table.SCHEMA)
        answers, new = read_through(requests.select("key", "url"), entries, now, get)
        if self.cache:
            self.cache.set(new.withColumn("seq", F.lit(time.time_ns())))
        one = answers.dropDuplicates(["key"]).select("key", F.col("value").alias("json"), "failure")
        return checkpointed(requests.join(one, "key").select("value", "json", "failure"))


def _items(answers: DataFrame, path: str) -> DataFrame:
    """(value, position from 1, json of one record) for answers that hold lists."""
    *outer, last = path.split(".")
    kind = f"{last}:array<string>"
    for name in reversed(outer):
        kind = f"{name}:struct<{kind}>"
    rows = answers.select("value", F.from_json("json", f"struct<{kind}>")[outer[0] if outer else last].alias("_x"))
    for name in [*outer[1:], last] if outer else []:
        rows = rows.withColumn("_x", F.col("_x")[name])
    return rows.select("value", F.posexplode("_x").alias("position", "json")).withColumn("position", F.col("position") + 1)


def records_by_doi(dois: DataFrame, net: Connection) -> tuple[DataFrame, DataFrame]:
    """((doi, title, is_retracted, abstract, provenance), (value, failure)) for dois (value): both providers' records of a
    DOI merged. What OpenAlex lacks and looks like an arXiv id is searched there by that id."""
    wanted = dois.select(provider_doi(strip(F.col("value"))).alias("value")).where("value <> ''").distinct()
    a, b = net.ask(wanted, "openalex_doi"), net.ask(wanted, "crossref_doi")
    lacking = a.where("json is null and failure is null").select(F.col("value").alias("doi"), arxiv_id(F.col("value")).alias("value")).where("value is not null")
    found = _items(net.ask(lacking, "openalex_arxiv"), "results").where("position = 1").join(lacking, "value").select(F.col("doi").alias("value"), "json")
    works = openalex_works(a.where("json is not null").select("value", "json").unionByName(found)).drop("doi").withColumnRenamed("value", "doi")
    message = F.from_json("json", "struct<message:string>")["message"]
    other = crossref_works(b.where("json is not null").select("value", message.alias("json")), by_doi=True).drop("doi").withColumnRenamed("value", "doi")
    failed = a.join(b.select("value", F.col("failure").alias("_b")), "value").where("json is null and failure is not null and _b is not null").select("value", "failure")
    return merge_providers(works, other), failed


def candidates_by_title(titles: DataFrame, net: Connection) -> tuple[DataFrame, DataFrame]:
    """(candidates of union_candidates, (citation_key, failure_reason)) for titles (citation_key, query): what the three
    providers find, and which citations none of them could be asked for."""
    wanted = titles.select("citation_key", strip(F.col("query")).alias("value"))
    kinds = [("openalex_title", "results", openalex_works), ("semantic_title", "data", semantic_scholar_works), ("crossref_title", "message.items", crossref_works)]
    answers = [net.ask(wanted, kind) for kind, _, _ in kinds]
    found = [works(_items(a, path)).join(wanted, "value").drop("value") for a, (_, path, works) in zip(answers, kinds, strict=True)]
    failures = reduce(DataFrame.unionByName, [a.select("value", "failure") for a in answers])
    out = failures.groupBy("value").agg(F.count("failure").alias("n"), F.min("failure").alias("failure")).where(F.col("n") == len(kinds))
    status = wanted.join(out, "value").select("citation_key", F.col("failure").alias("failure_reason"))
    return union_candidates(found, net.limit), status


def ask_providers(citations: DataFrame, retractions: DataFrame, net: Connection) -> dict[str, DataFrame]:
    """by_doi, candidates and status, as audit.verify takes them, for citations (citation_key, title, doi, raw_text, ...).

    Only what is needed is asked for: DOIs of citations that aren't known as retracted, and titles of those whose DOI no
    provider knows.
    """
    cited = citations.select("citation_key", "title", "raw_text", F.coalesce(blank_as_null(F.col("doi")), F.when(looks_like_doi(F.col("title")), strip(F.col("title")))).alias("doi"))
    gone = retractions.select(F.col("doi").alias("_gone"))
    left = checkpointed(cited.withColumn("_gone", normalize_doi(F.col("doi"))).join(gone, "_gone", "left_anti").drop("_gone"))
    by_doi, _ = records_by_doi(left.select(F.lower(strip(F.col("doi"))).alias("value")), net)
    by_doi = checkpointed(by_doi)
    known = by_doi.where("title <> ''").select(F.col("doi").alias("_d"))
    rest = left.withColumn("_d", provider_doi(strip(F.col("doi")))).join(known, "_d", "left_anti")
    candidates, status = candidates_by_title(rest.select("citation_key", query_text(F.col("title"), F.col("doi")).alias("query")).where("query is not null"), net)
    # verify looks records up by the DOI as the citation spells it.
    spelled = left.select(F.lower(strip(F.col("doi"))).alias("_s")).where("_s <> ''").distinct().withColumn("_d", provider_doi(F.col("_s")))
    by_doi = spelled.join(by_doi.withColumnRenamed("doi", "_d"), "_d").drop("_d").withColumnRenamed("_s", "doi")
    return {"by_doi": by_doi, "candidates": candidates, "status": status}
