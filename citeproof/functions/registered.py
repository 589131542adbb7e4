"""The library's functions by name, for queries in SQL.

Functions of columns become SQL functions whose body is the column's own expression: the optimizer puts it in the place of
the call, and nothing leaves the JVM. Only the sequence ratios run in Python, as Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from citeproof.functions import alignment, similarity, text

_WORDS = "array<string>"
#: Name: (function, the types of its parameters).
FUNCTIONS: dict[str, tuple[Callable[..., Column], tuple[str, ...]]] = {
    "normalize_doi": (text.normalize_doi, ("string",)),
    "provider_doi": (text.provider_doi, ("string",)),
    "extract_doi": (text.extract_doi, ("string",)),
    "arxiv_id": (text.arxiv_id, ("string",)),
    "is_arxiv_target": (text.is_arxiv_target, ("string",)),
    "looks_like_doi": (text.looks_like_doi, ("string",)),
    "year_of": (text.year_of, ("string",)),
    "strip_math_and_code": (text.strip_math_and_code, ("string",)),
    "core_title": (text.core_title, ("string",)),
    "normalized_title": (text.normalized_title, ("string",)),
    "title_tokens": (text.title_tokens, ("string",)),
    "stem_word": (text.stem, ("string",)),
    "stem_set": (text.stems, ("string",)),
    "char_trigrams": (text.trigrams, ("string",)),
    "split_sentences": (text.sentences, ("string",)),
    "split_clauses": (text.clauses, ("string",)),
    "token_jaccard": (text.jaccard, (_WORDS, _WORDS)),
    "token_overlap": (text.overlap, (_WORDS, _WORDS)),
    "escape_html": (text.escape_html, ("string",)),
    "url_quoted": (text.quoted, ("string",)),
    "file_extension": (text.extension, ("string",)),
    "is_negated": (alignment.negated, ("string", _WORDS)),
    "cache_key": (text.cache_key, ("string", "string")),
}
#: Name: an Arrow function.
IN_PYTHON = {"gestalt_ratio": similarity.gestalt_ratio, "title_similarity": similarity.title_similarity}
#: Name of a table function: the function that splits a text, and the name of its part.
SPLITS = {"claims_of": (text.sentences, "claim"), "clauses_of": (text.clauses, "clause")}
#: A string literal, or an operator that an expression's text writes in front of its operands.
_PREFIX = re.compile(r"""'(?:[^'\\]|\\.)*'|([-=<>!+*/%&|^~]+|\b(?:and|or|not)\b)\(""", re.DOTALL)


def _sql(column: Column) -> str:
    """A column's expression as SQL. Operators are functions in it, whose names SQL takes in backticks."""
    return _PREFIX.sub(lambda m: f"`{m[1]}`(" if m[1] else m[0], column._jc.node().sql())


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make all functions known to the session's SQL as temporary ones, and return their names with the prefix.

    Scalar: FUNCTIONS and IN_PYTHON. Table functions (pos, claim) and (pos, clause), positions from 1, for lateral joins:
    SELECT doc_id, c.* FROM docs, LATERAL claims_of(docs.text) AS c. They are joined where the row is, so that a table
    split by them isn't shuffled. A null text has no parts. Functions of the same names that the session had are replaced.
    """
    names = []
    for name, (function, types) in FUNCTIONS.items():
        parameters = [f"p{i}" for i in range(1, len(types) + 1)]
        column = function(*map(F.col, parameters))
        empty = spark.createDataFrame([], ", ".join(f"{p} {t}" for p, t in zip(parameters, types, strict=True)))
        returns = empty.select(column.alias("r")).schema["r"].dataType.simpleString()
        given = ", ".join(f"{p} {t}" for p, t in zip(parameters, types, strict=True))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({given}) RETURNS {returns} RETURN {_sql(column)}")
        names.append(prefix + name)
    for name, function in IN_PYTHON.items():
        spark.udf.register(prefix + name, function)
        names.append(prefix + name)
    for name, (split, part) in SPLITS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(body string) RETURNS TABLE (pos int, {part} string) RETURN SELECT p + 1, c FROM (SELECT posexplode({_sql(split(F.col('body')))}) AS (p, c))")
        names.append(prefix + name)
    return names
