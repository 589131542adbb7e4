"""Quality rules: words, symbols and repeats of each text, and how often its lines stand in other documents of its host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeproof.llm.lines import fenced, let, line_rows, row_key, without_places, words_of

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: A line of any length is above the limits of a host if more than DOCS different texts of the host have it and these are
#: more than 1 / SHARE of the host's different texts, or MANY at least.
DOCS, SHARE, MANY = 10, 200, 1000
#: A document is depleted if less than KEPT_PERCENT of its words, or fewer than KEPT_WORDS, are left.
KEPT_PERCENT, KEPT_WORDS = 30, 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated(words: Column) -> Column:
    """How many words stand in WINDOW-word windows that are found twice or more.

    The windows' hashes are sorted with their places, and only in texts where two are equal; equal neighbours give the
    places, and the places' windows are added up without what overlaps.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    h = lambda ranked, k: F.get(ranked, k)["h"]

    def covered(ranked: Column) -> Column:
        places = F.transform(ranked, lambda x, k: F.when(h(ranked, k - 1).eqNullSafe(x["h"]) | h(ranked, k + 1).eqNullSafe(x["h"]), x["i"]))
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
        add = lambda a, x: F.struct((a["n"] + x + WINDOW - F.greatest(x, a["end"])).alias("n"), (x + WINDOW).alias("end"))
        return F.aggregate(F.sort_array(F.filter(places, lambda x: x.isNotNull())), start, add, lambda a: a["n"])

    def of_windows(g: Column) -> Column:
        ranked = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) < F.size(g), let(ranked, covered)).otherwise(F.lit(0).cast("bigint"))

    return F.when(n >= WINDOW, let(hashes, of_windows)).otherwise(F.lit(0).cast("bigint"))


def base_counts(text: Column) -> Column:
    """A struct of COUNTS for a whole text, fenced: a filter on what it gives stays above it. A null text is empty."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("word_chars"),
            F.regexp_count(whole, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            _repeated(w).alias("n_repeat_words"),
        )

    return fenced(let(words_of(text), of_words))


def frequent_lines(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(site, line) above the limits. Equal texts count as one document, in a line's documents and in the host's."""
    counted = lines.groupBy("site", "line").agg(F.count_distinct("content").alias("n_docs")).where(F.col("n_docs") > DOCS)
    hosts = docs.groupBy("site").agg(F.count_distinct(F.when(F.col("text").isNotNull(), F.xxhash64("text"))).alias("n_texts"))
    return counted.join(hosts, "site").where((F.col("n_docs") * SHARE > F.col("n_texts")) | (F.col("n_docs") >= MANY)).select("site", "line")


def _named(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    return docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("site"), F.col(text_col).alias("text"))


def _frequent(named: DataFrame) -> DataFrame:
    """(row, n_frequent_words, places) of the rows that have lines above the limits: how many words these have, and where they are."""
    lines = line_rows(named)
    over = frequent_lines(lines, named).repartition(F.xxhash64("site", "line"))
    # Equal rows share their identity, so a place counts once.
    found = lines.join(over, ["site", "line"]).groupBy("row", "place").agg(F.max("n_words").alias("n"))
    return found.groupBy("row").agg(F.sum("n").alias("n_frequent_words"), F.collect_list("place").alias("places"))


def _failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def _depleted() -> Column:
    left = F.col("n_words") - F.coalesce("n_frequent_words", F.lit(0))
    return (left < KEPT_WORDS) | (left * 100 < F.col("n_words") * KEPT_PERCENT)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_frequent_words and n_frequent_lines (lines above the limits of the host, which keep_quality removes), kept.

    base_failed: fewer than 10 words, or more than 20 % of the words in repeated windows. A document that passes is
    kept unless lines above the limits of its host leave too little of it. A null text has no words and fails; rows
    without a host are one host; equal rows get equal results; only the three named columns are read.
    """
    named = _named(docs.select(id_col, text_col, host_col), id_col, text_col, host_col)
    base = named.select("doc_id", row_key("doc_id", "site", "text").alias("row"), base_counts(F.col("text")).alias("base")).select("doc_id", "row", "base.*")
    out = base.join(_frequent(named), "row", "left")
    words, lines = F.coalesce("n_frequent_words", F.lit(0)).cast("bigint"), F.coalesce(F.size("places"), F.lit(0)).cast("bigint")
    return out.select("doc_id", *COUNTS, _failed().alias("base_failed"), words.alias("n_frequent_words"), lines.alias("n_frequent_lines"), (~_failed() & ~_depleted()).alias("kept"))


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc, kept_text, n_removed) for the rows of docs that quality_rules keeps: the whole row as a struct, its text
    without the lines above the limits of its host, and how many lines went.

    Texts are judged where they are read; those that pass meet their frequent lines once.
    """
    named = _named(docs, id_col, text_col, host_col)
    judged = named.select("doc", row_key("doc_id", "site", "text").alias("row"), "text", base_counts(F.col("text")).alias("base")).select("doc", "row", "text", "base.n_words", "base.n_repeat_words")
    passed = judged.where(~_failed()).drop("n_repeat_words").join(_frequent(named), "row", "left").where(~_depleted())
    return passed.select("doc", without_places(F.col("text"), F.col("places")).alias("kept_text"), F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias("n_removed"))
