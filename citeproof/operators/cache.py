"""A key-value cache with expiry, as a table: entries (key, value, expires_at in epoch seconds, seq)."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeproof.config import THRESHOLDS
from citeproof.storage import checkpointed


def latest(entries: DataFrame, order: str = "seq") -> DataFrame:
    """The last entry of each key."""
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(order)))
    return entries.withColumn("_n", last).where("_n = 1").drop("_n")


def expiry(stored_at: Column, ttl: Column | None = None) -> Column:
    return stored_at + F.coalesce(ttl, F.lit(THRESHOLDS.cache_ttl_seconds)) if ttl is not None else stored_at + THRESHOLDS.cache_ttl_seconds


def alive(entries: DataFrame, now: Column) -> DataFrame:
    """Entries that a read still returns, and that a purge leaves: those that expire now or later."""
    return entries.where(F.col("expires_at") >= now)


def stats(entries: DataFrame, now: Column) -> DataFrame:
    expired = F.count_if(F.col("expires_at") < now)
    return entries.agg(F.count("*").alias("total"), expired.alias("expired"), (F.count("*") - expired).alias("valid"))


def upsert(entries: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    return latest(entries.unionByName(new), order)


def delete(entries: DataFrame, keys: DataFrame) -> DataFrame:
    return entries.join(keys.select("key").distinct(), "key", "left_anti")


class Table:
    """A cache kept as Parquet: every write adds files, and the last entry of a key, by seq, counts.

    Entries lie by buckets of their keys' hashes, so that a read of some keys opens the files of their buckets alone. What
    the table holds is a list of writes in a numbered commit. A commit is made by renaming a file to a name that must be
    free, so that of two writers one has to begin anew from the other's commit, and neither loses entries. A purge puts one
    write in the place of those it has read and leaves later ones. Files that it replaces stay until the next purge, for
    readers that still use them; files of writers that never came to commit stay until clear(). That a name is taken once
    only is the file system's promise: HDFS keeps it, links keep it on file systems of one machine or a mount; object stores
    without a rename that fails where the name is taken allow one writer at a time.
    """

    SCHEMA = "key string, value string, expires_at bigint, seq bigint"
    #: How often a writer begins anew before it gives up.
    ATTEMPTS = 100

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        """buckets counts for a new table; one that exists keeps its own."""
        self.spark, self.path, self._buckets = spark, path.rstrip("/"), buckets
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._of = lambda *parts: hadoop.Path("/".join([self.path, *parts]))
        self._fs = self._of().getFileSystem(self._conf)

    def _commits(self) -> list[int]:
        if not self._fs.exists(self._of("commits")):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._of("commits"))]
        return sorted(int(n) for n in names if n.isdigit())

    def _state(self) -> dict:
        """The newest commit: its number, the writes that make up the table, and those that the last purge replaced."""
        numbers = self._commits()
        if not numbers:
            return {"number": 0, "buckets": self._buckets, "live": [], "replaced": []}
        stream = self._fs.open(self._of("commits", f"{numbers[-1]:020d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {"number": numbers[-1], **json.loads(text)}

    def _commit(self, after: dict, **changes) -> bool:
        """Make the commit that follows after; False if another writer was first."""
        jvm = self.spark._jvm
        state = {k: v for k, v in (after | changes).items() if k != "number"}
        staged, final = self._of("staged", uuid.uuid4().hex), self._of("commits", f"{after['number'] + 1:020d}")
        out = self._fs.create(staged, False)
        out.write(json.dumps(state).encode())
        out.close()
        self._fs.mkdirs(self._of("commits"))
        if self._fs.getUri().getScheme() == "file":
            # Its rename looks first and then replaces; a link is made in one step, or not where the name is taken.
            try:
                os.link(staged.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            finally:
                self._fs.delete(staged, False)
            return True
        none = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(staged, final, none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            self._fs.delete(staged, False)
            return False
        return True

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")

    def _write(self, entries: DataFrame, buckets: int) -> str:
        name = uuid.uuid4().hex
        rows = entries.select("key", "value", "expires_at", "seq", self._bucket(buckets).alias("bucket"))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/part={name}")
        return name

    def _read(self, state: dict) -> DataFrame:
        if not state["live"]:
            return self.spark.createDataFrame([], f"{self.SCHEMA}, bucket int")
        paths = [f"{self.path}/data/part={name}" for name in state["live"]]
        return self.spark.read.schema(f"{self.SCHEMA}, part string, bucket int").option("basePath", f"{self.path}/data").parquet(*paths).drop("part")

    def entries(self, keys: DataFrame | None = None) -> DataFrame:
        """All entries that were written and not purged, older ones of a key too.

        With keys (key): only the buckets that these fall in are read; other keys of those buckets come with them. What is
        told to the driver are numbers of buckets.
        """
        state = self._state()
        rows = self._read(state)
        if keys is not None and state["live"]:
            wanted = [r.bucket for r in keys.where("key is not null").select(self._bucket(state["buckets"]).alias("bucket")).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(wanted))
        return rows.drop("bucket")

    def set(self, entries: DataFrame) -> None:
        state = self._state()
        name = self._write(entries, state["buckets"])
        for _ in range(self.ATTEMPTS):
            if self._commit(state, live=[*state["live"], name]):
                return
            held, state = state["buckets"], self._state()
            if state["buckets"] != held:
                name = self._write(entries, state["buckets"])
        raise RuntimeError(f"other writers were always first to commit to {self.path}")

    def get(self, keys: DataFrame, now: Column) -> DataFrame:
        return alive(latest(self.entries(keys)), now).join(keys.select("key").distinct(), "key", "left_semi")

    def purge(self, now: Column, gone: DataFrame | None = None) -> None:
        """Keep the last entry of each key that is alive, without the keys of gone; entries set meanwhile stay."""
        for _ in range(self.ATTEMPTS):
            state = seen = self._state()
            kept = alive(latest(self._read(seen).drop("bucket")), now)
            name = self._write(kept if gone is None else delete(kept, gone), seen["buckets"])
            while set(seen["live"]) <= set(state["live"]):
                later = [x for x in state["live"] if x not in seen["live"]]
                if self._commit(state, live=[name, *later], replaced=seen["live"]):
                    for old in state["replaced"]:
                        self._fs.delete(self._of("data", f"part={old}"), True)
                    return
                state = self._state()
            # Another purge replaced what this one has read.
            self._fs.delete(self._of("data", f"part={name}"), True)
        raise RuntimeError(f"other writers were always first to commit to {self.path}")

    def clear(self) -> None:
        self._fs.delete(self._of(), True)


def read_through(requests: DataFrame, entries: DataFrame, now: Column, fetch, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(answers, new entries) for requests (key, ...): live entries answer, fetch(missing requests) -> (key, value) the rest.

    answers (key, value) has a row for each request, also repeated ones; value is null where nothing answered. A key that
    is asked for several times is fetched once, and what was fetched is written once, so that reading either result, or
    both, asks nobody again. Nulls aren't kept as entries. Other columns that fetch returns come with the answers.
    """
    held = alive(latest(entries, order), now).select("key", "value")
    missing = requests.join(held.select("key"), "key", "left_anti").dropDuplicates(["key"])
    fetched = checkpointed(fetch(missing))
    answers = requests.select("key").join(held.unionByName(fetched, allowMissingColumns=True), "key", "left")
    return answers, fetched.where("value is not null").select("key", "value", expiry(now).alias("expires_at"))
