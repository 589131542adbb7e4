"""Citation relations derived from the driver's tables, which hold none: the same ones as DataFrames here and as SQL in plans.sql."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a claim says of its topic, by order status, and its evidence, by order priority.
CLAIM_VERBS = {"F": "increases", "O": "does not increase", "P": "reduces"}
EVIDENCE = {
    "1-URGENT": "promotes {} demand; cost was stable",
    "2-HIGH": "was never linked to {} demand, although supply increased",
    "3-MEDIUM": "inhibited {} demand in all regions",
    "4-NOT SPECIFIED": "and {} demand were measured without effect",
    "5-LOW": "raised {} demand however prices failed to follow",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_citation() -> Column:
    """The raw text of a citation, from its parts."""
    return F.concat(F.lit("["), "o_orderkey", F.lit("] "), "c_name", F.lit(". "), "p_name", F.lit(" "), "p_type", F.lit("[J]. "), "c_mktsegment", F.lit(", "), "yr", F.lit(". https://doi.org/10.1000/ORD."), "o_orderkey")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw citation per order: its customer is the author and its first part the title."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p_partkey"))
    o = table(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"))
    df = o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "part"), "p_partkey")
    df = df.select("o_orderkey", "o_custkey", "c_name", "c_mktsegment", "c_nationkey", "o_orderstatus", "o_orderpriority", "p_partkey", "p_name", "p_type", "p_brand", F.year("o_orderdate").alias("yr"))
    return df.withColumn("raw_text", raw_citation())


def retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A retraction for each order whose first line came back, its DOI spelled in one of three ways."""
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_linenumber = 1").select("l_orderkey").distinct()
    key = F.col("l_orderkey").cast("string")
    doi = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("doi: 10.1000/ord."), key)).when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit("HTTPS://DOI.ORG/10.1000/ORD."), key)).otherwise(F.concat(F.lit(" 10.1000/Ord."), key))
    return back.select(doi.alias("doi"), F.col("l_orderkey").alias("seq"), F.lit(None).cast("string").alias("title"), F.lit("returned").alias("reason"))


def provider_works(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three catalogues of parts as works (work_id, title, ...), which overlap: all, the larger and the smaller ones."""
    p = table(spark, sf_dir, "part")
    out = []
    for source, keep in (("A", F.lit(True)), ("B", F.col("p_size") >= 15), ("C", F.col("p_size") <= 35)):
        doi = F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("https://doi.org/10.5000/P." if source == "B" else "10.5000/P."), "p_partkey"))
        out.append(p.where(keep).select(F.col("p_partkey").alias("work_id"), "p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("title"), doi.alias("doi"), F.array("p_brand").alias("authors"), (F.col("p_size") + 1960).alias("year"), F.lit(None).cast("string").alias("venue"), F.lit(source).alias("source")))
    return out


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(citation_key, query): the different titles that citations name."""
    title = F.concat_ws(" ", "p_name", "p_type")
    return citations(spark, sf_dir).select(title.alias("citation_key"), title.alias("query")).distinct()


def claim_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, claim, evidence) with verbs and negations that agree or not."""
    c = citations(spark, sf_dir)
    verb, what = F.lit(""), F.lit("")
    for k, v in CLAIM_VERBS.items():
        verb = F.when(F.col("o_orderstatus") == k, v).otherwise(verb)
    for k, v in EVIDENCE.items():
        a, b = v.split("{}")
        what = F.when(F.col("o_orderpriority") == k, F.concat(F.lit(a), F.lower("c_mktsegment"), F.lit(b))).otherwise(what)
    return c.select("o_orderkey", F.concat_ws(" ", "p_name", verb, F.lower("c_mktsegment"), F.lit("demand")).alias("claim"), F.concat_ws(" ", F.lit("the"), "p_name", what).alias("evidence"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, claim, abstract): each turn of a conversation with the next one."""
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("abstract"))
    return c.select("conv_id", "turn", F.col("text").alias("claim")).join(after, ["conv_id", "turn"])


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cache writes: the key is type and user, and the time to live depends on the type."""
    e = table(spark, sf_dir, "events")
    ttl = F.when(F.col("event_type") == "error", 86400).when(F.col("event_type") == "view", 7 * 86400).otherwise(14 * 86400)
    at = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    return e.select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), F.col("value").cast("string").alias("value"), (at + ttl).alias("expires_at"), F.col("event_id").alias("seq"))


#: The fixed time of cache queries, in seconds from the first of January 2024.
NOW = 20 * 86400


def manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, location_prefix, text): one manuscript per customer. Each reference is cited by a line with a list or range of
    numbers, and the reference list follows."""
    return manuscripts_of(citations(spark, sf_dir))


def manuscripts_of(c: DataFrame) -> DataFrame:
    """The manuscripts of citations."""
    cite = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("As "), "p_name", F.lit(" shows ["), "o_orderkey", F.lit(", "), F.col("o_orderkey") + 100000, F.lit("].")))
    cite = cite.otherwise(F.concat(F.lit("As "), "p_name", F.lit(" shows ["), "o_orderkey", F.lit("-"), F.col("o_orderkey") + 2, F.lit("].")))
    lines = c.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", cite.alias("cite"), "raw_text"))).alias("l"))
    text = F.array_join(F.concat(F.transform("l", lambda x: x["cite"]), F.array(F.lit("")), F.transform("l", lambda x: x["raw_text"])), "\n")
    return lines.select(F.col("o_custkey").alias("doc_id"), F.lit("Text").alias("location_prefix"), text.alias("text"))
