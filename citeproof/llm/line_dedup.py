"""Line dedup by the spread of a line over sites: HyperLogLog sketches for every line, exact counts near the thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeproof.llm.lines import line_rows, row_key, without_places
from citeproof.llm.runtime import cut

#: Boilerplate is a line of any length on SITES sites or more, in TEXTS different texts or more; fewer texts are copies of
#: whole documents, which would lose their own lines everywhere.
SITES, TEXTS = 10, 20
#: Buckets of a sketch (a power of two: 12 has a standard error of 1.6 %), and the share of a threshold, six such errors,
#: within which a sketch doesn't decide.
LOG_BUCKETS, BAND = 12, 0.1


def boilerplate(lines: DataFrame, sites: int = SITES, texts: int = TEXTS) -> DataFrame:
    """(line) of lines that spread widely. Equal texts count as one text."""
    drawn = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LOG_BUCKETS)).alias("s"), F.hll_sketch_agg("content", F.lit(LOG_BUCKETS)).alias("t"))
    spread = drawn.select("line", F.hll_sketch_estimate("s").alias("n_sites"), F.hll_sketch_estimate("t").alias("n_texts"))
    low = lambda n: n - max(1, n * BAND)
    high = lambda n: n + max(1, n * BAND)
    likely = spread.where((F.col("n_sites") >= low(sites)) & (F.col("n_texts") >= low(texts)))
    likely = likely.select("line", ((F.col("n_sites") > high(sites)) & (F.col("n_texts") > high(texts))).alias("sure"))
    near = likely.where("not sure").select("line").repartition(F.xxhash64("line"))
    exact = lines.join(near, "line").groupBy("line").agg(F.count_distinct("site").alias("n_sites"), F.count_distinct("content").alias("n_texts"))
    return likely.where("sure").select("line").unionByName(exact.where((F.col("n_sites") >= sites) & (F.col("n_texts") >= texts)).select("line"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(doc, kept_text, n_lines, n_removed) for each row of docs: doc is the whole row as a struct, whatever its columns are called.

    Lines are compared normalized (lower case, single spaces); lines without a word stay. Every occurrence of a
    boilerplate line goes, at the site where it was first seen as well. A null text stays null and has no lines; a text
    of boilerplate alone becomes empty; rows without a site are one site; equal rows get equal results.
    """
    named = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.col(text_col).alias("text"))
    # Lines are cut and hashed once; what is written is a small part of the texts.
    lines = cut(line_rows(named).select("row", "place", "site", "content", "line"))
    spread = boilerplate(lines).repartition(F.xxhash64("line"))
    gone = lines.join(spread, "line").groupBy("row").agg(F.collect_set("place").alias("places"))
    joined = named.select("doc", "text", row_key("doc_id", "site", "text").alias("row")).join(gone, "row", "left")
    text = F.col("text")
    return joined.select(
        "doc",
        without_places(text, F.col("places")).alias("kept_text"),
        F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("bigint").alias("n_lines"),
        F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("bigint").alias("n_removed"),
    )
