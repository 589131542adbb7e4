"""Streams: a cache that forgets, and manuscripts that are audited as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter


def first_within(entries: DataFrame, key: list[str], time: str, ttl: str) -> DataFrame:
    """The first entry of each key within ttl of event time; state older than that is dropped."""
    return entries.withWatermark(time, ttl).dropDuplicatesWithinWatermark(key)


def audited(documents: DataFrame, audit: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that audits each micro-batch of documents (doc_id, text, location_prefix) and gives the results to sink with
    the batch's number, by which a sink can drop a batch that comes twice."""
    return documents.writeStream.foreachBatch(lambda batch, number: sink(audit(batch), number)).option("checkpointLocation", checkpoint)


class LedgerSink:
    """A sink for micro-batches that counts a batch once, however often it comes.

    Each batch is a folder of its own below path; its success mark, written last, is its entry in the ledger. A batch whose
    mark stands is left alone, and what a broken attempt has left is written over. One feed a path, as numbers are a feed's.
    """

    SUCCESS = "_SUCCESS"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _done(self, number: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={number}/{self.SUCCESS}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def __call__(self, results: DataFrame, number: int) -> None:
        if not self._done(number):
            results.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def batches(self) -> list[int]:
        """The numbers in the ledger."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []
        return sorted(n for n in (int(x.removeprefix("batch=")) for x in names if x.startswith("batch=")) if self._done(n))

    def read(self) -> DataFrame:
        """The results of the batches in the ledger, with their batch; there must be one at least."""
        return self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/batch={n}" for n in self.batches()])
