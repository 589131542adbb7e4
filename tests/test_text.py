from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeproof.functions import text as T


def one(spark, expr, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(expr.alias("r")).first()
    return row.r


def test_stem(spark):
    for word, want in (("increasing", "increas"), ("promoted", "promot"), ("reduction", "reduc"), ("cat", "cat"), ("is", "is"), ("business", "busi")):
        assert one(spark, T.stem(F.col("c0")), word) == want


def test_trigrams(spark):
    assert sorted(one(spark, T.trigrams(F.col("c0")), "hello")) == ["ell", "hel", "llo"]
    assert one(spark, T.trigrams(F.col("c0")), "") == [] and one(spark, T.trigrams(F.col("c0")), "ab") == []


def test_sentences_and_clauses(spark):
    assert len(one(spark, T.sentences(F.col("c0")), "第一句话很长。第二句话更长！第三句话如何？第四句话结束；")) == 4
    assert one(spark, T.clauses(F.col("c0")), "it rose, however prices fell; ok then") == ["it rose", "prices fell", "ok then"]
    assert one(spark, T.clauses(F.col("c0")), "") == [] and one(spark, T.clauses(F.col("c0")), "a") == ["a"]


def test_math_and_code_go(spark):
    assert one(spark, T.strip_math_and_code(F.col("c0")), "a $x_1$ b `code` c ```\nblock\n``` d $$e$$ f costs $ 100") == "a  b  c  d  f costs $ 100"


def test_doi(spark):
    for raw in ("https://doi.org/10.1000/XYZ", "doi: 10.1000/xyz", " 10.1000/Xyz ", "http://dx.doi.org/10.1000/xyz"):
        assert one(spark, T.normalize_doi(F.col("c0")), raw) == "10.1000/xyz"
    assert one(spark, T.normalize_doi(F.col("c0")), "cnki.123") is None
    assert one(spark, T.extract_doi(F.col("c0")), "see (https://doi.org/10.1126/science.1112286).") == "10.1126/science.1112286"
    assert one(spark, T.extract_doi(F.col("c0")), "none") is None


def test_core_title(spark):
    assert one(spark, T.core_title(F.col("c0")), "[1] Smith J. Deep learning for text[J]. Nature, 2020.") == "Deep learning for text"
    assert one(spark, T.core_title(F.col("c0")), "") == ""


def test_cache_key_and_html(spark):
    import hashlib

    assert one(spark, T.cache_key("ns", F.col("c0"), F.col("c1")), " A ", "") == hashlib.sha256(b"ns|a").hexdigest()
    assert one(spark, T.escape_html(F.col("c0")), "<a href=\"x\">'&") == "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;"


def test_inverted_index(spark):
    df = spark.createDataFrame([({"the": [0, 3], "cat": [1], "saw": [2], "dog": [4]},)], "i map<string,array<int>>")
    assert df.select(T.text_of_positions(F.col("i"))).first()[0] == "the cat saw the dog"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=40))
def test_normalize_doi_twice_is_once(spark, raw):
    first = one(spark, T.normalize_doi(F.col("c0")), raw)
    assert first is None or one(spark, T.normalize_doi(F.col("c0")), first) == first
