"""The audit: a verdict for each citation, its risk, and a report for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeproof.config import THRESHOLDS
from citeproof.functions.alignment import align
from citeproof.functions.text import blank_as_null, core_title, let, looks_like_doi, strip
from citeproof.lexicons import CORE_JOURNALS
from citeproof.operators.resolve import best_candidates, by_kind, dedup_candidates, local_matches, score_candidates
from citeproof.operators.retraction import with_retractions
from citeproof.storage import written

VERDICT = ["matched", "doi", "title", "is_retracted", "abstract", "confidence", "match_confidence", "match_margin", "evidence_status", "is_uncertain", "source", "failure_reason"]
RISKS = ["PASS", "NOTICE", "WARNING", "DANGER"]


def journal_of(corpus: Column) -> Column:
    """The first core journal, in the list's order, that the text names."""
    return F.get(F.filter(F.array(*map(F.lit, CORE_JOURNALS)), lambda j: F.contains(corpus, j)), F.lit(0))


def query_text(title: Column, doi: Column) -> Column:
    """What a title search asks for: the core title of five characters or more, else the title or DOI; null below three."""
    text = let(core_title(title), lambda core: F.when(F.length(core) >= 5, core).otherwise(F.coalesce(blank_as_null(title), doi)))
    return let(text, lambda x: F.when(F.length(x) >= 3, x))


def enriched(best: DataFrame, by_doi: DataFrame) -> DataFrame:
    """best (doi, abstract, ...) with the abstract of the DOI's record (doi, abstract) where it has none of its own."""
    lacking = F.when(F.coalesce("abstract", F.lit("")) == "", F.col("doi"))
    # Records are many, and few are asked for: the others go no further than where they are read.
    asked = best.select(lacking.alias("_found")).where("_found is not null").distinct()
    more = by_doi.select(F.col("doi").alias("_found"), F.col("abstract").alias("_more")).join(asked, "_found", "left_semi")
    return best.withColumn("_found", lacking).join(more, "_found", "left").withColumn("abstract", F.coalesce(blank_as_null(F.col("abstract")), F.col("_more"), F.lit(""))).drop("_found", "_more")


def verify(citations: DataFrame, retractions: DataFrame, by_doi: DataFrame, candidates: DataFrame, status: DataFrame | None = None, asked: str = "citation_key") -> DataFrame:
    """citations (citation_key, title, doi, raw_text, authors, year) with their verdict (the VERDICT columns).

    The first source that knows decides: the retraction dimension; the providers' merged record of the DOI (by_doi: doi,
    title, is_retracted, abstract); the best of the candidates for the title (citation_key, seq, title, doi, authors,
    year, venue, abstract, is_retracted, source); the name of a core journal; nothing. Each stage sees only what the ones
    before have left. status (citation_key, failure_reason) tells of citations whose providers all failed; they are not
    "not found". asked: the column of citations that candidates have in the place of citation_key where several
    citations share them; they are told apart, scored and ranked once for each kind of citation (resolve.by_kind).
    """
    doi = F.coalesce(blank_as_null(F.col("doi")), F.when(looks_like_doi(F.col("title")), strip(F.col("title"))))
    cited = citations.select("citation_key", doi.alias("doi"), "title", "raw_text", "authors", "year", F.col(asked).alias("_asked"))
    cited = with_retractions(cited, retractions)
    known = by_doi.where("title <> ''").select(F.col("doi").alias("_d"), F.col("title").alias("_title"), F.col("is_retracted").alias("_gone"), F.col("abstract").alias("_abstract"))
    gone = F.col("retraction").isNotNull()
    # Written, as each source's citations are read from it; what only later sources need is null before them.
    cited = cited.withColumn("_d", F.when(~gone, F.lower(strip(F.col("doi"))))).join(known, "_d", "left")
    later = ~gone & F.col("_title").isNull()
    told = written(cited.select("citation_key", "norm_doi", gone.alias("_hit"), F.col("retraction.title").alias("_rtitle"), F.col("retraction.reason").alias("_reason"), "title", "_d", "_title", "_gone", "_abstract", *[F.when(later, F.col(c)).alias(c) for c in ("doi", "raw_text", "authors", "year", "_asked")]))
    null = F.lit(None)
    retracted = told.where("_hit").select(
        "citation_key",
        F.lit(True).alias("matched"),
        F.col("norm_doi").alias("doi"),
        F.coalesce("_rtitle", "title").alias("title"),
        F.lit(True).alias("is_retracted"),
        F.concat(F.lit("retracted: "), F.coalesce("_reason", F.lit("unknown"))).alias("abstract"),
        F.lit(1.0).alias("confidence"),
        null.cast("string").alias("match_confidence"),
        null.cast("double").alias("match_margin"),
        null.cast("string").alias("evidence_status"),
        F.lit(False).alias("is_uncertain"),
        F.lit("offline retractions").alias("source"),
        null.cast("string").alias("failure_reason"),
    )
    direct = told.where("not _hit and _title is not null").select("citation_key", F.lit(True).alias("matched"), F.col("_d").alias("doi"), F.col("_title").alias("title"), F.col("_gone").alias("is_retracted"), F.col("_abstract").alias("abstract"), F.lit(1.0).alias("confidence"), null.cast("string").alias("match_confidence"), null.cast("double").alias("match_margin"), null.cast("string").alias("evidence_status"), F.lit(False).alias("is_uncertain"), F.lit("DOI lookup").alias("source"), null.cast("string").alias("failure_reason"))
    left = told.where("not _hit and _title is null").select("citation_key", "doi", "title", "raw_text", "authors", "year", "_asked")

    # Those that ask for nothing have no candidates.
    searchable = query_text(F.col("title"), F.col("doi")).isNotNull()
    wanted = left.select("*", F.when(searchable, F.col("_asked")).alias("_for"), F.col("title").alias("c_title"), F.col("raw_text").alias("c_raw"), F.col("authors").alias("c_authors"), F.col("year").alias("c_year")).drop("_asked")
    given = written(dedup_candidates(candidates.withColumnRenamed("citation_key", "_for") if asked == "citation_key" else candidates.withColumnRenamed(asked, "_for"), "_for"))
    kept, kinds = by_kind(wanted, given, "_for")
    best = best_candidates(score_candidates(kinds.join(given, "_for")), "kind").where("title <> ''")
    # Written, so that the optimizer knows how few they are.
    best = enriched(written(best.select("kind", "doi", "title", "is_retracted", "abstract", "match_score", "match_confidence", "match_margin", "is_uncertain", "source")), by_doi)
    gone = F.coalesce("is_retracted", F.lit(False))
    best = written(best.select("kind", F.lit(True).alias("matched"), "doi", "title", gone.alias("is_retracted"), "abstract", F.bround("match_score", 2).alias("confidence"), "match_confidence", "match_margin", F.when(gone, "RETRACTED").otherwise("ARTICLE_MATCHED").alias("evidence_status"), "is_uncertain", F.concat("source", F.lit(" (rerank)")).alias("source"), null.cast("string").alias("failure_reason")))
    searched = kept.select("citation_key", "kind").join(best, "kind").drop("kind")
    left = kept.join(best.select("kind"), "kind", "left_anti").select("citation_key", "doi", "title", "raw_text")

    journal = journal_of(F.concat_ws(" ", "title", F.coalesce("raw_text", F.lit(""))))
    rest = left.withColumn("_journal", journal)
    rest = rest.join(status, "citation_key", "left") if status is not None else rest.withColumn("failure_reason", null.cast("string"))
    in_journal, failed = F.col("_journal").isNotNull(), F.col("failure_reason").isNotNull()
    last = rest.select(
        "citation_key",
        F.when(in_journal | failed, null.cast("boolean")).otherwise(F.lit(False)).alias("matched"),
        "doi",
        F.when(in_journal, F.coalesce(blank_as_null(core_title(F.col("title"))), F.col("title"))).otherwise(F.col("title")).alias("title"),
        F.lit(False).alias("is_retracted"),
        F.lit("").alias("abstract"),
        F.when(in_journal, 0.40).otherwise(0.0).alias("confidence"),
        null.cast("string").alias("match_confidence"),
        null.cast("double").alias("match_margin"),
        F.when(in_journal, "JOURNAL_MATCHED_ARTICLE_UNVERIFIED").when(failed, "PROVIDER_UNAVAILABLE").otherwise("NOT_FOUND").alias("evidence_status"),
        F.lit(False).alias("is_uncertain"),
        F.when(in_journal, F.concat(F.lit("journal "), F.col("_journal"))).otherwise("none").alias("source"),
        F.when(~in_journal, F.col("failure_reason")).alias("failure_reason"),
    )
    return retracted.unionByName(direct).unionByName(searched).unionByName(last)


def risk_columns(retracted: Column, uncertain: Column, journal: Column, matched: Column, has_text: Column, state: Column) -> dict[str, Column]:
    """status, risk and alignment_state; the first case that holds decides."""
    cases = [
        (retracted, "RETRACTED", "DANGER", F.lit(None).cast("string")),
        (uncertain, "UNVERIFIED", "WARNING", F.lit("UNCERTAIN")),
        (journal, "UNVERIFIED", "NOTICE", F.lit("UNVERIFIED")),
        (~matched, "UNVERIFIED", "WARNING", F.lit("UNVERIFIED")),
        (~has_text, "VALID", "PASS", F.lit("NEUTRAL")),
        (state == "CONTRADICTED", "CLAIM_MISMATCH", "DANGER", state),
        (state == "NEUTRAL", "CLAIM_MISMATCH", "NOTICE", state),
        (state == "PARTIAL", "CLAIM_MISMATCH", "NOTICE", state),
        (state == "SUPPORTED", "VALID", "PASS", state),
    ]
    out = {"status": F.lit("UNVERIFIED"), "risk": F.lit("WARNING"), "alignment_state": state}
    for when, status, risk, shown in reversed(cases):
        when = F.coalesce(when, F.lit(False))
        out = {"status": F.when(when, status).otherwise(out["status"]), "risk": F.when(when, risk).otherwise(out["risk"]), "alignment_state": F.when(when, shown).otherwise(out["alignment_state"])}
    return out


def audit(citations: DataFrame, verdicts: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """One row per citation (doc_id, citation_key, title, raw_text, claim, ...): verdict, evidence, alignment, status and risk.

    papers, where given, are asked for citations that no source has matched for certain or whose record has no abstract.
    """
    v = verdicts.select("citation_key", *[F.col(c).alias(f"v_{c}") for c in VERDICT])
    df = citations.join(v, "citation_key")
    sure = F.coalesce("v_matched", F.lit(False)) & ~F.col("v_is_uncertain")
    if papers is not None:
        asked = df.where(~F.col("v_is_retracted") & (~sure | (F.coalesce("v_abstract", F.lit("")) == "")))
        local = local_matches(asked.select("citation_key", "title", "raw_text"), papers).withColumnRenamed("confidence", "local_confidence")
        df = df.join(local, "citation_key", "left")
    else:
        df = df.withColumns({"target_text": F.lit(None).cast("string"), "filename": F.lit(None).cast("string"), "local_confidence": F.lit(None).cast("double")})
    df = df.withColumns({"target_abstract": F.coalesce(blank_as_null(F.col("v_abstract")), F.col("target_text")), "_matched": sure | F.col("filename").isNotNull()})
    journal = F.coalesce(F.col("v_evidence_status") == "JOURNAL_MATCHED_ARTICLE_UNVERIFIED", F.lit(False))
    needed = F.col("_matched") & ~F.col("v_is_retracted") & ~F.col("v_is_uncertain") & ~journal & F.col("target_abstract").isNotNull()
    states = align(df.where(needed).select("citation_key", "claim", F.col("target_abstract").alias("abstract")), ["citation_key"])
    df = df.join(states.withColumnRenamed("alignment_state", "_state"), "citation_key", "left")
    columns = risk_columns(F.col("v_is_retracted"), F.col("v_is_uncertain"), journal, F.col("_matched"), F.col("target_abstract").isNotNull(), F.col("_state"))
    evidence = F.coalesce(blank_as_null(F.col("best_sentence")), F.col("target_abstract"), F.col("v_abstract"))
    granularity = F.when(blank_as_null(F.col("best_sentence")).isNotNull(), "SENTENCE").when(F.col("target_abstract").isNotNull(), "FULL_ABSTRACT")
    certain = F.when(F.col("v_is_retracted") | F.col("v_is_uncertain") | journal, F.col("v_confidence")).when(F.col("filename").isNotNull(), F.col("local_confidence")).when(F.col("_matched"), F.col("v_confidence")).otherwise(0.0)
    shown = F.coalesce("v_evidence_status", F.when(F.col("v_failure_reason").isNotNull(), "PROVIDER_UNAVAILABLE").when(F.col("_matched"), "ARTICLE_MATCHED").otherwise("NOT_FOUND"))
    return df.withColumns(columns).select(*citations.columns, "status", "risk", shown.alias("evidence_status"), F.col("v_failure_reason").alias("failure_reason"), F.col("v_title").alias("verified_title"), F.col("v_doi").alias("verified_doi"), evidence.alias("evidence_text"), granularity.alias("evidence_granularity"), certain.alias("reference_confidence"), F.col("score").alias("claim_alignment_score"), "alignment_state", F.col("v_match_margin").alias("match_margin"))


def report(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of each risk per document and the share that passed, in per cent."""
    counts = [F.count_if(F.col("risk") == r).alias(n) for r, n in zip(RISKS, ("passed", "notice", "warning", "danger"), strict=True)]
    df = results.groupBy(key).agg(F.count("*").alias("total"), *counts)
    return df.withColumn("pass_rate", F.round(100 * F.col("passed") / F.greatest("total", F.lit(1)), 1))
