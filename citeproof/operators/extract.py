"""Citations and the claims that cite them, from manuscript texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeproof.functions.text import DOI, YEAR, arxiv_id, blank_as_null, extract_doi, fenced, let, strip, strip_math_and_code
from citeproof.storage import written

REFERENCE = r"(?U)^\[(\d+)\]\s*(.+)"
#: Of lines and keys that meet by document: at 10 GB of them, 25 MB each.
PARTITIONS = 400
BRACKETS = r"(?U)\[\s*([\d\s,\-–—]+)\s*\]"


def reference_fields(line: Column) -> Column:
    """What a reference-list line says, as one struct: number, doc_type (type tag), authors, title, year and doi.

    Without a type tag only what stands before the first dot is the title. Each step is worked out once.
    """
    none = F.array().cast("array<string>")

    def of(content: Column, tag: Column, parts: Column) -> Column:
        more = F.size(parts) > 1
        title = strip(F.when(more, F.get(parts, F.lit(1))).otherwise(parts[0]))
        authors = F.when(more, F.filter(F.transform(F.split(parts[0], ","), strip), lambda a: a != "")).otherwise(none)
        return F.struct(
            F.regexp_extract(line, REFERENCE, 1).alias("number"),
            F.upper(F.coalesce(tag, F.lit("J"))).alias("doc_type"),
            authors.alias("authors"),
            let(title, lambda t: F.when(t != "", t).otherwise(line)).alias("title"),
            let(F.regexp_extract(content, YEAR, 1), blank_as_null).try_cast("int").alias("year"),
            let(F.regexp_extract(line, DOI, 0), lambda d: F.rtrim(blank_as_null(d), F.lit(".,;:!?)]}>"))).alias("doi"),
        )

    def tagged(content: Column, tag: Column) -> Column:
        head = F.when(tag.isNotNull(), F.call_function("substring_index", content, F.concat(F.lit("["), tag, F.lit("]")), F.lit(1))).otherwise(F.substring_index(content, ".", 1))
        return let(F.split(head, r"\.", 2), lambda parts: of(content, tag, parts))

    return let(F.regexp_extract(line, REFERENCE, 2), lambda content: let(F.regexp_extract(content, r"(?i)\[([JMDCRNPS])\]", 1), lambda t: let(blank_as_null(t), lambda tag: tagged(content, tag))))


def lines_of(documents: DataFrame) -> DataFrame:
    """(doc_id, location_prefix, line_no, raw, line) for every line that isn't blank; numbered after code and math are gone."""
    clean = documents.select("doc_id", "location_prefix", F.posexplode(F.split(strip_math_and_code(F.col("text")), "\n")).alias("at", "raw"))
    return clean.select("doc_id", "location_prefix", (F.col("at") + 1).alias("line_no"), "raw", strip(F.col("raw")).alias("line")).where("line <> ''")


def bracket_mentions(lines: DataFrame, most: int = 10_000) -> DataFrame:
    """(doc_id, line_no, line, lo, hi) for every number or range in the bracket lists of a line. Ranges stay ranges."""
    lists = lines.select("doc_id", "line_no", "line", F.explode(F.regexp_extract_all("line", F.lit(BRACKETS), F.lit(1))).alias("list"))
    parts = lists.select("doc_id", "line_no", "line", F.explode(F.split("list", ",")).alias("part")).withColumn("ends", F.transform(F.split(strip(F.col("part")), "[-–—]"), strip))
    number = lambda i: F.when(F.get("ends", F.lit(i)).rlike(r"^\d+\z"), F.get("ends", F.lit(i)).try_cast("bigint"))
    hi = F.when(F.size("ends") == 1, number(0)).when(F.size("ends") == 2, number(1))
    return parts.select("doc_id", "line_no", "line", number(0).alias("lo"), hi.alias("hi")).where("lo <= hi")


def key_mentions(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, key, claim_line, claim): the first line of a document in whose brackets a key stands alone, whether the key
    is a number or not. keys: (doc_id, key), or (doc_id, keys) with the keys of a document as an array.

    Lines meet their document's keys as one row, so that neither keys nor brackets are sent as rows of their own.
    """
    own = keys.select("doc_id", "keys") if "keys" in keys.columns else keys.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    inside = F.filter(F.regexp_extract_all("line", F.lit(r"(?U)\[\s*([^\[\]]*?)\s*\]"), F.lit(1)), lambda x: x != "")
    # Shuffled, as arrays made from few bytes look small enough to broadcast, and in a fixed number of partitions, as they
    # compress so well that Spark would put most of them together again.
    parted = lines.select("doc_id", "line_no", "line").repartition(PARTITIONS, "doc_id")
    met = parted.join(own.repartition(PARTITIONS, "doc_id").hint("merge"), "doc_id")
    hits = met.select("doc_id", "line_no", "line", F.explode(F.array_intersect(inside, "keys")).alias("key"))
    return hits.groupBy("doc_id", "key").agg(F.min(F.struct("line_no", "line")).alias("m")).select("doc_id", "key", F.col("m.line_no").alias("claim_line"), F.col("m.line").alias("claim"))


def first_mentions(references: DataFrame, mentions: DataFrame, lines: DataFrame, widest: int = 1000) -> DataFrame:
    """(doc_id, ref_line, claim_line, claim) with the first other line of a document whose brackets hold a reference's number.

    Ranges up to `widest` numbers become rows and join by equality; wider ones, which only mistakes make, join by bounds
    within their document. Lines are told by number; their texts are fetched from lines when the first is known.
    """
    wanted = references.select("doc_id", F.col("line_no").alias("ref_line"), F.col("number").try_cast("bigint").alias("n"))
    mentions = mentions.select("doc_id", "line_no", "lo", "hi")
    narrow = mentions.where(F.col("hi") - F.col("lo") < widest).select("doc_id", "line_no", F.explode(F.sequence("lo", "hi")).alias("n"))
    hits = wanted.join(narrow, ["doc_id", "n"]).select("doc_id", "ref_line", "line_no")
    wide = mentions.where(F.col("hi") - F.col("lo") >= widest)
    hits = hits.unionByName(wanted.join(wide, "doc_id").where("n between lo and hi").select("doc_id", "ref_line", "line_no"))
    first = hits.where("line_no <> ref_line").groupBy("doc_id", "ref_line").agg(F.min("line_no").alias("claim_line"))
    texts = lines.select("doc_id", F.col("line_no").alias("claim_line"), F.col("line").alias("claim"))
    return first.join(texts, ["doc_id", "claim_line"]).select("doc_id", "ref_line", "claim_line", "claim")


def extract_citations(documents: DataFrame) -> DataFrame:
    """One row per citation of documents (doc_id, text, location_prefix): reference-list lines and lines that give a DOI.

    Its key is (doc_id, line_no), as numbers can repeat. A reference that no line cites has a placeholder claim.
    """
    # Written, as references, mentions and other DOIs read them: else every text would be cleaned and split for each.
    lines = written(lines_of(documents).drop("raw"))
    is_ref = F.col("line").rlike(REFERENCE)
    refs = lines.where(is_ref).withColumn("_said", fenced(reference_fields(F.col("line")))).select("*", "_said.*").drop("_said")
    numbers = written(bracket_mentions(lines).drop("line"))
    mentions = first_mentions(refs, numbers, lines).withColumnRenamed("ref_line", "line_no").drop("claim_line")
    refs = refs.join(mentions, ["doc_id", "line_no"], "left")
    unsaid = F.concat(F.lit("正文中引用了文献 ["), F.col("number"), F.lit("]。"))
    location = F.concat(F.col("location_prefix"), F.lit(" Line "), F.col("line_no"))
    refs = refs.select("doc_id", "line_no", F.concat(F.lit("cit_"), F.col("number")).alias("citation_id"), F.col("line").alias("raw_text"), "doi", "title", "authors", "year", location.alias("location_info"), F.coalesce("claim", unsaid).alias("claim"), F.coalesce("claim", "line").alias("context"))
    said = F.col("line").contains("http") | F.lower("line").contains("doi")
    dois = lines.where(~is_ref & said).withColumn("doi", extract_doi(F.col("line"))).where("doi is not null")
    dois = dois.select("doc_id", "line_no", F.lit(None).cast("string").alias("citation_id"), F.col("line").alias("raw_text"), "doi", F.substring("line", 1, 60).alias("title"), F.array().cast("array<string>").alias("authors"), F.lit(None).cast("int").alias("year"), location.alias("location_info"), F.col("line").alias("claim"), F.col("line").alias("context"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    both = refs.unionByName(dois).withColumn("place", order)
    return both.withColumn("citation_id", F.coalesce("citation_id", F.concat(F.lit("cit_doi_"), F.col("place")))).drop("place")


def arxiv_citations(targets: DataFrame) -> DataFrame:
    """The citation that an arXiv address or id stands for; other addresses are taken whole."""
    name = F.coalesce(arxiv_id(F.col("target")), F.col("target"))
    where = F.concat(F.lit("arXiv Target: "), F.col("target"))
    return targets.select("target", F.lit("cit_arxiv_1").alias("citation_id"), F.concat(F.lit("arXiv:"), name).alias("raw_text"), F.concat(F.lit("10.48550/arxiv."), name).alias("doi"), F.concat(F.lit("arXiv Preprint "), name).alias("title"), where.alias("location_info"), F.concat(F.lit("arXiv paper "), name).alias("claim"), where.alias("context"))
