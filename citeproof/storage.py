"""Tables written in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the session's spark.checkpoint.dir. Where none is set, a session on one machine (tests) gets
    a temporary one; on a cluster, where other machines could not see such a folder, that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not (context.master or "").partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in the shared folder; Spark deletes them with the DataFrame where
    spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows as a table written in the shared folder: its lineage is cut, and its size known to the optimizer."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """Like written, in buckets of a column's hashes, so that a join on the column shuffles only what is joined. Rows that
    are dealt by it already make a file a bucket. The catalog names the table only until it is read."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, by).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name, format="parquet")
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def delete(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more: what was made from them has been written itself."""
    for path in {f.rpartition("/")[0] for df in tables for f in df.inputFiles()}:
        spark = tables[0].sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
