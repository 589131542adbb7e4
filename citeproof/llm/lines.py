"""Lines of documents as rows, and the rows' identity; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that ends a word.
SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def normalized(line: Column) -> Column:
    """Lower case, every run of white space one space, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def row_key(*columns: str) -> Column:
    """64-bit identity of a row's values, nulls told from values. Equal rows share it, and with it every result."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is worked out once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fenced(value: Column) -> Column:
    """The value, as a column that no filter is pushed below and no other projection takes in: else it would be worked
    out anew for each use."""
    return F.when(F.spark_partition_id() >= 0, value)


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row, site, content, place, line, n_words) for each line with a word of docs (doc_id, site, text).

    line is the hash of the normalized line, content that of the whole text: equal texts have equal contents.
    """
    lines = docs.select("doc_id", "site", row_key("doc_id", "site", "text").alias("row"), F.xxhash64("text").alias("content"), F.posexplode(F.split("text", "\n")).alias("place", "raw"))
    named = lines.withColumn("norm", normalized(F.col("raw"))).where("norm <> ''")
    return named.select("doc_id", "row", "site", "content", "place", F.xxhash64("norm").alias("line"), F.size(F.split("norm", " ")).alias("n_words"))


def without_places(text: Column, places: Column) -> Column:
    """The text without the lines at these places; the text itself where places is null."""
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    # A lambda would split the text anew for each place.
    kept = let(lines, lambda all_: F.array_join(F.transform(left, lambda i: F.get(all_, i)), "\n"))
    return F.when(places.isNull(), text).otherwise(kept)
