from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from citeproof.operators import cache as K
from citeproof.streaming.feeds import LedgerSink, audited
from citeproof.streaming.state import STATE_STORE, collect_answers, last_writes

PROVIDERS = ["OpenAlex", "Semantic Scholar", "Crossref"]


@pytest.fixture()
def timers(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    yield spark
    spark.conf.set(name, before)


def put(spark, folder, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").json(folder)


def wait(what, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if what():
            return
        time.sleep(0.3)
    raise AssertionError("nothing came in time")


def test_answers_before_after_and_never(timers, tmp_path):
    """All in at once, one that comes too late, one that never comes, and answers that count nothing."""
    spark, folder, ddl = timers, str(tmp_path / "in"), "citation_key string, provider string, json string"
    put(spark, folder, [("all", p, json.dumps({"from": p})) for p in reversed(PROVIDERS)] + [("late", "OpenAlex", "1"), ("late", "Crossref", "2"), ("late", "Crossref", "again"), ("late", "Nobody", "x"), ("never", "Crossref", None), (None, "Crossref", "x")], ddl)
    stream = spark.readStream.schema(ddl).json(folder)
    q = collect_answers(stream, PROVIDERS).writeStream.format("memory").queryName("collected").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        rows = lambda: {(r.citation_key, r.state): (r.providers.split("\n"), r.answers.split("\n"), r.missing.split("\n") if r.missing else []) for r in spark.sql("select * from collected").collect()}
        wait(lambda: len(rows()) == 3)
        got = rows()
        assert got["all", "COMPLETE"] == (PROVIDERS, [json.dumps({"from": p}) for p in PROVIDERS], [])
        assert got["late", "WINDOW_CLOSED"] == (["OpenAlex", "Crossref"], ["1", "2"], ["Semantic Scholar"])
        assert got["never", "WINDOW_CLOSED"] == (["Crossref"], [""], ["OpenAlex", "Semantic Scholar"])
        put(spark, folder, [("late", "Semantic Scholar", "3"), ("all", "OpenAlex", "4")], ddl)
        wait(lambda: len(rows()) == 5)
        assert rows()["late", "LATE"][:2] == (["Semantic Scholar"], ["3"]) and rows()["all", "LATE"][:2] == (["OpenAlex"], ["4"])
    finally:
        q.stop()


def test_last_write_holds_and_purge_frees(timers, tmp_path):
    """A stream of writes, with the entries it started from, ends where the table's own functions end."""
    spark, folder = timers, str(tmp_path / "in")
    rnd = random.Random(5)
    ddl = "key string, value string, expires_at bigint, seq bigint, ts string"
    stamp = lambda s: time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(s))
    start = [("a", "old", 150, 1), ("k1", "kept", 10**6, 2), ("gone", "x", 105, 3), ("k2", None, 10**6, 4)]
    writes = [(f"k{rnd.randrange(12)}", rnd.choice(["v", "w", None]), rnd.randint(100, 400), 10 + i, 100 + i) for i in range(120)]
    late_seq = ("k1", "older write that comes later", 10**6, 1, 221)
    rounds = [writes[:40], writes[40:80], [*writes[80:], late_seq], [("clock", "x", 10**6, 999, 300)]]
    put(spark, folder, [(*r[:4], stamp(r[4])) for r in rounds[0]], ddl)
    q = last_writes(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(folder).withColumn("ts", F.to_timestamp("ts")), initial=spark.createDataFrame(start, "key string, value string, expires_at bigint, seq bigint"))
    q = q.writeStream.format("memory").queryName("changes").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        for r in rounds[1:]:
            put(spark, folder, [(*x[:4], stamp(x[4])) for x in r], ddl)
            q.processAllAvailable()
        changes = spark.sql("select * from changes").collect()
    finally:
        q.stop()
    held = {k: (v, e, s) for k, v, e, s in start}
    for c in sorted(changes, key=lambda c: (c.seq, c.op == "PURGED")):
        if c.op == "SET":
            held[c.key] = (c.value, c.expires_at, c.seq)
        elif held.get(c.key, (None, None, None))[2] == c.seq:
            del held[c.key]
    whole = spark.createDataFrame(start + [r[:4] for x in rounds for r in x], "key string, value string, expires_at bigint, seq bigint")
    # The clock has reached 300 seconds.
    want = {r.key: (r.value, r.expires_at, r.seq) for r in K.alive(K.latest(whole), F.lit(300)).collect()}
    assert held == want and "gone" not in held and any(c.op == "PURGED" for c in changes)


def test_a_batch_that_comes_twice_counts_once(spark, tmp_path):
    sink = LedgerSink(spark, str(tmp_path / "out"))
    one = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, n int")
    assert sink.batches() == []
    sink(one, 0)
    sink(one.unionByName(one), 0)
    broken = f"{tmp_path}/out/batch=1"
    one.write.parquet(broken)
    (tmp_path / "out" / "batch=1" / "_SUCCESS").unlink()
    assert sink.batches() == [0] and sink.read().count() == 2
    sink(one.where("n = 1"), 1)
    assert sorted((r.doc_id, r.batch) for r in sink.read().collect()) == [("a", 0), ("a", 1), ("b", 0)]


def test_audited_feed(spark, tmp_path):
    """Manuscripts audited as they arrive; a run that starts again after its last batch was not marked adds nothing twice."""
    folder, ddl = str(tmp_path / "in"), "doc_id string, text string, location_prefix string"
    sink = LedgerSink(spark, str(tmp_path / "out"))
    audit = lambda docs: docs.selectExpr("doc_id", "length(text) as n")

    def run():
        q = audited(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(folder), audit, sink, str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    put(spark, folder, [("a", "xx", "Text")], ddl)
    run()
    put(spark, folder, [("b", "yyy", "Text")], ddl)
    run()
    # As if the driver had died between the sink and the stream's own mark.
    for f in (tmp_path / "cp" / "commits").iterdir():
        if f.name.lstrip(".").startswith("1"):
            f.unlink()
    run()
    assert sorted((r.doc_id, r.n, r.batch) for r in sink.read().collect()) == [("a", 2, 0), ("b", 3, 1)]
