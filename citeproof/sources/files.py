"""Manuscripts and reference papers from files. A file that can't be read gives a row with an error, not a failed job."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeproof.functions.text import YEAR, basename, extension, found, strip

KINDS = {"Text": [".md", ".txt"], "LaTeX/BibTeX": [".tex", ".bib"], "DOCX": [".docx"], "PDF": [".pdf"]}
PAPERS = [".txt", ".md", ".docx", ".pdf"]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """The paragraphs that aren't blank, one a line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in body.iter(f"{_W}p"))
    return "\n".join(p for p in paragraphs if p)


def pdf_text(content: bytes) -> str:
    """Pages with text, each under its number; needs pypdf."""
    from pypdf import PdfReader

    pages = ((i, (p.extract_text() or "").strip()) for i, p in enumerate(PdfReader(io.BytesIO(content)).pages, 1))
    return "\n".join(f"--- Page {i} ---\n{t}" for i, t in pages if t)


def _extracted(files: DataFrame, pdf: Callable[[bytes], str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    texts.append(docx_text(content) if path.lower().endswith(".docx") else pdf(content))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - any damage of a file becomes its row's error
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": batch["path"], "text": texts, "error": errors})

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def kind_of(path: Column) -> Column:
    """The format that a path's extension names; text by default."""
    kind = F.lit("Text")
    for name, extensions in KINDS.items():
        kind = F.when(extension(path).isin(extensions), name).otherwise(kind)
    return kind


def read_documents(spark: SparkSession, path: str, only: list[str] | None = None, pdf: Callable[[bytes], str] = pdf_text) -> DataFrame:
    """(doc_id, location_prefix, text, error) of the files below a path; only: extensions to take, all by default.

    Text formats are decoded in the JVM; DOCX and PDF go through Arrow batches. Unknown extensions are read as text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").withColumn("ext", extension(F.col("path")))
    if only:
        files = files.where(F.col("ext").isin(only))
    packed = F.col("ext").isin(".docx", ".pdf")
    # Bytes that aren't UTF-8 become replacement marks, which are dropped.
    text = F.regexp_replace(F.expr("cast(content as string)"), "�", "")
    plain = files.where(~packed).select("path", text.alias("text"), F.lit(None).cast("string").alias("error"))
    both = plain.unionByName(_extracted(files.where(packed), pdf))
    return both.select(F.col("path").alias("doc_id"), kind_of(F.col("path")).alias("location_prefix"), "text", "error")


def paper_columns(papers: DataFrame) -> DataFrame:
    """papers (filename, filepath, fulltext) with title, authors, year and abstract, as their first lines tell them."""
    lines = F.filter(F.transform(F.split("fulltext", "\n"), strip), lambda x: x != "")
    df = papers.where(strip(F.coalesce("fulltext", F.lit(""))) != "").withColumn("_l", lines)
    second = F.get("_l", F.lit(1))
    named = (F.length(second) < 100) & ~F.lower(second).rlike("abstract|摘要|university|大学")
    abstract = found(F.col("fulltext"), r"(?isU)(abstract|摘要)[:\s]+(.*?)(?=\n\n|\n[1-9]|introduction|引言|\z)", 2)
    return df.select(
        "filename",
        "filepath",
        F.substring(F.coalesce(F.get("_l", F.lit(0)), F.col("filename")), 1, 200).alias("title"),
        F.when(named, F.filter(F.transform(F.split(second, r"[,;]\s*"), strip), lambda a: a != "")).otherwise(F.array().cast("array<string>")).alias("authors"),
        found(F.substring("fulltext", 1, 1500), YEAR, 1).try_cast("int").alias("year"),
        F.coalesce(F.substring(strip(abstract), 1, 1000), strip(F.substring("fulltext", 1, 500))).alias("abstract"),
        "fulltext",
    )


def read_papers(spark: SparkSession, path: str, pdf: Callable[[bytes], str] = pdf_text) -> DataFrame:
    """The reference papers below a path, with seq in the order of their paths; files without text are skipped."""
    docs = read_documents(spark, path, PAPERS, pdf).where("text is not null")
    named = paper_columns(docs.select(basename(F.col("doc_id")).alias("filename"), F.col("doc_id").alias("filepath"), F.col("text").alias("fulltext")))
    return named.withColumn("seq", F.col("filepath"))


def kind_of_target(target: str) -> str:
    """arxiv, or the format that a path's extension names."""
    if target.startswith(("http://", "https://")) or "arxiv.org" in target or re.match(r"^\d{4}\.\d{4,5}(v\d+)?$", target):
        return "arxiv"
    ext = re.search(r"(?<=[^/])(\.[^./]*)$", target)
    return next((k for k, v in KINDS.items() if ext and ext[1].lower() in v), "Text")
