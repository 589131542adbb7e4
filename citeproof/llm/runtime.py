"""What the operators share about the session: materializing, sizes and row identity."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeproof.storage import delete, shared_folder, written


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the reliable checkpoint folder, with their lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: For what is far smaller than the documents: a table of its own, whose size the optimizer knows however many rounds of
#: an iteration went before, and how it goes when nothing reads it any more.
cut_few, release = written, delete


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffles of jobs whose tables are gone, as it does when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def power_of_two(least: float, low: int, high: int | None = None) -> int:
    """The first of low, 2 * low, 4 * low, ... that is not under least; high bounds it where one is given."""
    n = low
    while n < least and (high is None or n < high):
        n *= 2
    return n


def text_key(text: Column) -> Column:
    """Identity of a text for telling rows apart; null differs from the empty text."""
    return F.xxhash64(text, text.isNull())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
