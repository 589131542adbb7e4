from __future__ import annotations

import zipfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from citeproof.functions.alignment import align, polarity_conflict
from citeproof.functions.similarity import ratio
from citeproof.operators import audit as A
from citeproof.operators import cache as K
from citeproof.operators import evaluate as E
from citeproof.operators import extract as X
from citeproof.operators import report as P
from citeproof.operators import resolve as R
from citeproof.operators import retraction as Q
from citeproof.sources import files, providers
from citeproof.streaming.feeds import first_within


def states(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "k int, claim string, abstract string")
    return {r.k: r for r in align(df, ["k"]).collect()}


def test_alignment(spark):
    got = states(
        spark,
        [
            ("The drug increases survival of patients", "We tested a drug. The drug inhibits survival of patients."),
            ("Treatment reduces mortality in diabetic patients", "Treatment did not reduce mortality in diabetic patients."),
            ("Deep learning improves protein structure prediction", "Deep learning improves protein structure prediction by a wide margin."),
            ("Quantum dots emit blue light", "Monetary policy and inflation were analysed."),
            ("人工智能显著提升了劳动力生产率", "Artificial intelligence affects labor productivity and employment."),
            ("", "text"),
            (None, "text"),
            ("药物显著提升疗效", "药物未显著提升疗效"),
        ],
    )
    assert got[0].alignment_state == "CONTRADICTED" and got[1].alignment_state == "CONTRADICTED" and got[7].alignment_state == "CONTRADICTED"
    assert got[0].score == 0.15
    assert got[2].alignment_state == "SUPPORTED"
    assert got[3].alignment_state == "NEUTRAL" and got[3].score < 0.25
    assert got[4].alignment_state in ("SUPPORTED", "PARTIAL") and got[4].score >= 0.20
    assert got[5].alignment_state == got[6].alignment_state == "UNVERIFIED"


def test_negation_in_another_clause_is_no_conflict(spark):
    df = spark.createDataFrame([("the drug lowers blood pressure", "the drug lowers blood pressure, although it was not tested in children")], "c string, s string")
    assert not polarity_conflict(df, "c", "s", "x").first().x


def test_ratio():
    assert ratio("abcd", "bcde") == 0.75 and ratio(None, "a") == 0.0


MANUSCRIPT = """Intro text cites prior work [1, 3-5] here.
Another line with [2].
Code `[2]` and $x[3]$.

[1] Smith J, Doe A. Deep learning for text[J]. Nature, 2020. https://doi.org/10.1000/abc.
[2] Unknown thing without tag
[3] Lee K. Graphs[M]. Press, 1999.
[9] Nobody N. Unused[J]. X, 2001.
See https://doi.org/10.2000/xyz for data."""


def test_extraction(spark):
    df = spark.createDataFrame([("d", "Text", MANUSCRIPT)], "doc_id string, location_prefix string, text string")
    got = {r.citation_id: r for r in X.extract_citations(df).collect()}
    assert set(got) == {"cit_1", "cit_2", "cit_3", "cit_9", "cit_doi_5"}
    assert got["cit_1"].doi == "10.1000/abc" and got["cit_1"].year == 2020 and got["cit_1"].authors == ["Smith J", "Doe A"] and got["cit_1"].title == "Deep learning for text"
    assert got["cit_1"].claim.startswith("Intro") and got["cit_3"].claim.startswith("Intro") and got["cit_2"].claim.startswith("Another")
    assert "[9]" in got["cit_9"].claim and got["cit_9"].context.startswith("[9]")
    assert got["cit_1"].location_info == "Text Line 5" and got["cit_doi_5"].doi == "10.2000/xyz"


def test_wide_range_joins_by_bounds(spark):
    df = spark.createDataFrame([("d", "Text", "All of [1-99999].\n[7] A. B[J]. C, 2000.")], "doc_id string, location_prefix string, text string")
    assert X.extract_citations(df).first().claim == "All of [1-99999]."


def test_arxiv(spark):
    df = spark.createDataFrame([("https://arxiv.org/abs/2301.01234v2",), ("2301.01234",), ("https://example.org/x",)], "target string")
    got = [r.doi for r in X.arxiv_citations(df).collect()]
    assert got == ["10.48550/arxiv.2301.01234", "10.48550/arxiv.2301.01234", "10.48550/arxiv.https://example.org/x"]
    assert files.kind_of_target("2301.01234") == "arxiv" and files.kind_of_target("a/b.docx") == "DOCX" and files.kind_of_target("x") == "Text"


CAND = "citation_key string, seq int, title string, doi string, authors array<string>, year int, venue string, source string"


def test_dedup_and_rank(spark):
    rows = [
        ("q", 1, "Attention is all you need", "https://doi.org/10.1/A", ["Vaswani"], 2017, None, "x"),
        ("q", 2, "Attention is all you need", "doi:10.1/a", ["Vaswani"], 2017, None, "y"),
        ("q", 3, "Attention is all you need!", None, ["Vaswani"], 2017, None, "z"),
        ("q", 4, "attention is  all you need", None, ["vaswani "], 2017, None, "w"),
        ("q", 5, "abc", None, [], None, None, "v"),
        ("q", 6, "abc", None, [], None, None, "u"),
    ]
    cands = R.dedup_candidates(spark.createDataFrame(rows, CAND))
    assert sorted(r.seq for r in cands.collect()) == [1, 3, 5, 6]
    again = R.dedup_candidates(cands)
    assert again.count() == cands.count()
    wanted = spark.createDataFrame([("q", "Attention is all you need", ["Vaswani A"], 2017, "Vaswani A. Attention is all you need[C]. 2017")], "citation_key string, c_title string, c_authors array<string>, c_year int, c_raw string")
    scored = R.score_candidates(cands.join(wanted, "citation_key"))
    assert all(0 <= r.match_score <= 1 for r in scored.collect())
    best = R.best_candidates(scored).first()
    assert best.is_uncertain and len(best.ambiguous_candidates) == 2 and best.seq == 1
    alone = R.best_candidates(scored.where("seq in (1, 5)")).first()
    assert alone.match_confidence == "HIGH" and alone.match_margin == 1.0 and alone.ambiguous_candidates is None


def test_local_store(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("Deep learning for protein folding\nJane Roe, John Poe\n2021\n\nAbstract: We fold proteins with networks.\n\n1. Introduction\nText body mentions a hidden masterpiece title here.")
    (tmp_path / "b.bin").write_text("skipped")
    (tmp_path / "c.docx").write_bytes(b"broken")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Second paper on graphs</w:t></w:r></w:p><w:p/></w:body></w:document>')
    docs = {r.doc_id.rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert docs["c.docx"].error and docs["c.docx"].text is None and docs["d.docx"].text == "Second paper on graphs" and docs["d.docx"].location_prefix == "DOCX"
    papers = files.read_papers(spark, str(tmp_path))
    first = {r.filename: r for r in papers.collect()}
    assert set(first) == {"a.txt", "d.docx"}
    assert first["a.txt"].abstract == "We fold proteins with networks." and first["a.txt"].year == 2021 and first["a.txt"].authors == ["Jane Roe", "John Poe"]
    cited = spark.createDataFrame([("1", "Deep learning for protein folding", "raw"), ("2", "hidden masterpiece title", "raw"), ("3", "nothing of the kind", "raw")], "citation_key string, title string, raw_text string")
    got = {r.citation_key: r for r in R.local_matches(cited, papers).collect()}
    assert got["1"].filename == "a.txt" and got["2"].confidence == 0.70 and "3" not in got


def test_verify_and_audit(spark):
    cited = spark.createDataFrame(
        [
            ("d", "r", "x", "10.1126/SCIENCE.1112286", "raw", "c", None, None),
            ("d", "k", "y", "10.5/known", "raw", "the drug increases survival", None, None),
            ("d", "s", "Attention is all you need", None, "raw", "c", None, None),
            ("d", "j", "某论文. 管理世界", None, "raw", "c", None, None),
            ("d", "n", "Nothing matches this title", None, "raw", "c", None, None),
            ("d", "f", "Providers all failed for this", None, "raw", "c", None, None),
        ],
        "doc_id string, citation_key string, title string, doi string, raw_text string, claim string, authors array<string>, year int",
    )
    by_doi = spark.createDataFrame([("10.5/known", "A known work", False, "The drug reduces survival.")], "doi string, title string, is_retracted boolean, abstract string")
    cands = spark.createDataFrame([("s", 1, "Attention is all you need", "10.9/att", ["V"], 2017, None, "A", "", False)], CAND + ", abstract string, is_retracted boolean")
    status = spark.createDataFrame([("f", "TIMEOUT")], "citation_key string, failure_reason string")
    v = A.verify(cited, Q.retraction_dimension(Q.known_retractions(spark).withColumn("seq", F.lit(1))), by_doi, cands, status)
    got = {r.citation_key: r for r in v.collect()}
    assert len(got) == 6 and got["r"].is_retracted and got["k"].confidence == 1.0 and got["s"].matched and got["j"].matched is None and got["j"].confidence == 0.40
    assert got["n"].evidence_status == "NOT_FOUND" and got["f"].evidence_status == "PROVIDER_UNAVAILABLE" and got["f"].failure_reason == "TIMEOUT"
    done = {r.citation_key: r for r in A.audit(cited, v).collect()}
    assert {k: (r.status, r.risk) for k, r in done.items()} == {
        "r": ("RETRACTED", "DANGER"),
        "k": ("CLAIM_MISMATCH", "DANGER"),
        "s": ("VALID", "PASS"),
        "j": ("UNVERIFIED", "NOTICE"),
        "n": ("UNVERIFIED", "WARNING"),
        "f": ("UNVERIFIED", "WARNING"),
    }
    assert done["r"].alignment_state is None
    total = A.report(A.audit(cited, v)).first()
    assert total.total == 6 and total.passed + total.notice + total.warning + total.danger == 6


def test_providers(spark):
    raw = spark.createDataFrame([('{"doi":"https://doi.org/10.1/X","title":"RETRACTED: t","publication_year":2001,"abstract_inverted_index":{"b":[1],"a":[0]},"authorships":[{"author":{"display_name":"A B"}}]}',)], "json string")
    r = providers.openalex_works(raw).first()
    assert (r.doi, r.is_retracted, r.abstract, r.authors, r.year) == ("10.1/x", True, "a b", ["A B"], 2001)
    raw = spark.createDataFrame([('{"DOI":"10.1/Y","title":["t"],"update-to":[{"type":"retraction"}],"author":[{"given":"A","family":"B"}],"issued":{"date-parts":[[1999,1]]}}',), ('{"DOI":"10.1/Z"}',)], "json string")
    a, b = providers.crossref_works(raw, by_doi=True).collect()
    assert a.is_retracted and a.authors == ["A B"] and a.year == 1999 and b.title is None and not b.is_retracted
    raw = spark.createDataFrame([('{"title":"t","externalIds":null,"authors":[{"name":"N"}]}',), ('{"title":"u","externalIds":{"ArXiv":"2301.1"}}',)], "json string")
    a, b = providers.semantic_scholar_works(raw).collect()
    assert a.doi is None and b.doi == "2301.1"


def test_cache(spark):
    e = spark.createDataFrame([("a", "1", 100, 1), ("a", "2", 200, 2), ("b", "1", 50, 3)], "key string, value string, expires_at bigint, seq bigint")
    last = K.latest(e)
    assert {r.key: r.value for r in last.collect()} == {"a": "2", "b": "1"}
    assert K.stats(last, F.lit(100)).first().asDict() == {"total": 2, "expired": 1, "valid": 1}
    assert [r.key for r in K.alive(last, F.lit(50)).collect() if r.key == "b"] == ["b"]
    assert K.delete(last, spark.createDataFrame([("a",)], "key string")).count() == 1
    answers, new = K.read_through(spark.createDataFrame([("a",), ("c",)], "key string"), e, F.lit(100), lambda missing: missing.withColumn("value", F.lit("new")))
    assert {r.key: r.value for r in answers.collect()} == {"a": "2", "c": "new"} and new.first().expires_at == 100 + 30 * 86400


def test_metrics(spark):
    pairs = spark.createDataFrame([("S", "S"), ("S", "N"), ("C", "S")], "gold string, pred string")
    got = {r.label: (r.tp, r.fp, r.fn) for r in E.confusion(pairs, ["S", "C"]).collect()}
    assert got == {"S": (1, 1, 1), "C": (0, 0, 1)}
    m = E.ranking_metrics(spark.createDataFrame([(1,), (2,), (None,)], "rank int")).first()
    assert (m.n, round(m.top1, 3), m.mrr) == (3, 0.333, 0.5)


def test_reports(spark):
    cols = "doc_id string, line_no int, citation_id string, raw_text string, title string, doi string, status string, risk string, verified_doi string, verified_title string, evidence_status string, claim string, evidence_text string, evidence_granularity string, reference_confidence double, claim_alignment_score double, alignment_state string, location_info string"
    rows = [("d.md", 1, "cit_1", "raw one", "T <1>", None, "VALID", "PASS", None, None, "X", "c", "e", "SENTENCE", 1.0, 0.9, "SUPPORTED", "l"), ("d.md", 2, "cit_2", "raw two", "T2", "10.1/a", "RETRACTED", "DANGER", None, None, "X", "c", "e", "SENTENCE", 1.0, None, None, "l")]
    df = spark.createDataFrame(rows, cols)
    md, page = P.markdown(df).first().markdown, P.html(df).first().html
    assert "🔴 [DANGER] T2" in md and "cit_1 | T <1>" in md and "T &lt;1&gt;" in page and 'data-risk="DANGER"' in page and "http" not in page.split("</style>")[0]
    assert set(P.disclose(df, "compact").columns) < set(P.disclose(df, "detailed").columns) < set(P.disclose(df, "debug").columns)
    assert P.disclose(df, None).columns == P.disclose(df, "odd").columns
    assert [r.citation_id for r in P.filtered(df, "DANGER", "t2").collect()] == ["cit_2"] and P.filtered(df).count() == 2
    assert P.terminal(df).count() == 2


def test_streamed_cache(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:30"), ("b", "2024-01-01 00:01:00")], "key string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    q = first_within(stream, ["key"], "ts", "10 minutes").writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.key for r in spark.sql("select key from kept").collect()) == ["a", "b"]


def test_fetch_retries(spark):
    from citeproof.sources import fetch as H

    policy = H.Policy(retries=2)
    waits, calls = [], []

    def opener(answers):
        left = list(answers)

        def one(url, timeout):
            calls.append(timeout)
            answer = left.pop(0)
            if isinstance(answer, Exception):
                raise answer
            return answer

        return one

    ask = lambda *answers: H.get_json("u", policy, opener(answers), waits.append)
    ok = (200, {}, b'{"a": 1}')
    assert ask(ok) == ('{"a": 1}', None) and ask((404, {}, b"")) == (None, None) and ask((500, {}, b"")) == (None, "HTTP_500") and ask((200, {}, b"<")) == (None, "NOT_JSON")
    assert not waits
    assert ask((429, {"Retry-After": "3"}, b""), ok) == ('{"a": 1}', None) and waits == [3.0]
    assert ask((503, {}, b""), TimeoutError(), OSError()) == (None, "NETWORK") and len(waits) == 3 and all(0.5 <= w <= 8 for w in waits[1:])
    assert H.get_json("u", H.Policy(total_s=0.0), opener([ok])) == (None, "TIMEOUT")
    assert H.backoff(9, 8.0, policy, lambda a, b: b) == 8.0 and H.backoff(0, 8.0, policy, lambda a, b: b) == 1.0
    rows = spark.createDataFrame([("a", "u/a"), ("b", None), ("c", "u/404")], "key string, url string")
    got = H.fetch(rows, 2, policy, lambda url, timeout: (404, {}, b"") if url.endswith("404") else (200, {}, b'{"x": "y"}'))
    assert {r.key: (r.json, r.failure) for r in got.collect()} == {"a": ('{"x": "y"}', None), "b": (None, "NO_URL"), "c": (None, None)}


def test_cache_table(spark, tmp_path):
    t = K.Table(spark, str(tmp_path / "cache"))
    new = lambda *rows: spark.createDataFrame(list(rows), K.Table.SCHEMA)
    assert t.entries().count() == 0
    t.purge(F.lit(0))
    t.set(new(("a", "1", 100, 1), ("b", "2", 50, 2)))
    t.set(new(("a", "3", 200, 3), ("c", "4", 300, 4)))
    keys = spark.createDataFrame([("a",), ("b",), ("x",)], "key string")
    assert {r.key: r.value for r in t.get(keys, F.lit(60)).collect()} == {"a": "3"}
    t.purge(F.lit(60), spark.createDataFrame([("c",)], "key string"))
    assert {r.key: r.value for r in t.entries().collect()} == {"a": "3"}
    t.set(new(("d", None, 900, 9)))
    assert K.stats(K.latest(t.entries()), F.lit(500)).first().asDict() == {"total": 2, "expired": 1, "valid": 1}
    t.clear()
    assert t.entries().count() == 0


def test_cache_table_reads_asked_buckets(spark, tmp_path):
    """A read of a few keys opens the files of their buckets; the rows are those of a read of everything."""
    t = K.Table(spark, str(tmp_path / "cache"), buckets=16)
    t.set(spark.range(400).selectExpr("concat('k', id) as key", "string(id) as value", "1000 as expires_at", "id as seq"))
    t.set(spark.range(0, 400, 2).selectExpr("concat('k', id) as key", "concat('new', id) as value", "1000 as expires_at", "id + 1000 as seq"))
    keys = spark.createDataFrame([("k6",), ("k6",), ("k7",), ("none",), (None,)], "key string")
    files = lambda df: {f for f in df.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    read, all_files = files(t.entries(keys)), files(t.entries())
    assert len(all_files) >= 28 and 0 < len(read) <= 6 and read < all_files
    assert "PartitionFilters: [bucket" in t.entries(keys)._jdf.queryExecution().toString().replace("isnotnull(bucket), ", "")
    assert {r.key: r.value for r in t.get(keys, F.lit(5)).collect()} == {"k6": "new6", "k7": "7"}
    assert K.Table(spark, t.path, buckets=3).get(keys, F.lit(5)).count() == 2
    assert t.get(spark.createDataFrame([], "key string"), F.lit(5)).count() == 0
    t.set(spark.createDataFrame([], K.Table.SCHEMA))
    assert t.entries().count() == 600


def test_cache_table_two_writers(spark, tmp_path):
    """Neither writers nor purges that run at the same time lose entries, and a purge that another one overtook starts anew."""
    t = K.Table(spark, str(tmp_path / "cache"), buckets=2)
    new = lambda *rows: spark.createDataFrame(list(rows), K.Table.SCHEMA)
    stale = t._state()
    t.set(new(("a", "1", 100, 1)))
    assert not t._commit(stale, live=["lost"]) and t.entries().count() == 1

    def write(i):
        w = K.Table(spark, t.path)
        w.set(new((f"w{i}", str(i), 100, 10 + i)))
        if i % 3 == 0:
            w.purge(F.lit(50))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(8)))
    assert {r.key for r in t.entries().collect()} == {"a", *(f"w{i}" for i in range(8))}
    # A write, and another purge, between the reading and the commit of a purge.
    commit, between = t._commit, [lambda: K.Table(spark, t.path).set(new(("b", "2", 100, 90))), lambda: K.Table(spark, t.path).purge(F.lit(50))]

    def interrupted(*args, **changes):
        if between:
            between.pop(0)()
        return commit(*args, **changes)

    t._commit = interrupted
    t.purge(F.lit(50), spark.createDataFrame([("a",)], "key string"))
    assert not between and {r.key for r in t.entries().collect()} == {"b", *(f"w{i}" for i in range(8))}
    t._commit = commit
    for _ in range(2):
        t.purge(F.lit(50))
    assert len(list((tmp_path / "cache" / "data").glob("part=*"))) == 2


def test_saved_retractions(spark, tmp_path):
    path = str(tmp_path / "retractions")
    rows = [("10.1126/SCIENCE.1112286", "later", "S", "2007", "again", 5), ("10.1/new", "new", "S", "2020", "x", 6)]
    Q.save_retractions(spark.createDataFrame(rows, "doi string, title string, journal string, date string, reason string, seq bigint"), path)
    got = {r.doi: r.title for r in Q.retraction_dimension(Q.load_retractions(spark, path)).collect()}
    assert got["10.1126/science.1112286"] == "later" and got["10.1/new"] == "new" and len(got) == 4


def test_containing(spark):
    texts = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "brown  fox"), (3, ""), (4, None)], "id int, body string")
    needles = spark.createDataFrame([("a", "ick brown fo"), ("b", "fox"), ("c", "n  f"), ("d", "own fox"), ("e", "missing words here")], "k string, needle string")
    got = {(r.id, r.k) for r in R.containing(texts, needles, "id", "body").collect()}
    assert got == {(1, "a"), (1, "b"), (2, "b"), (2, "c"), (1, "d")}


def test_timed():
    got = E.timed(lambda: 10)
    assert got["items"] == 10 and got["qps"] > 0 and got["ms_per_item"] >= 0


def test_key_mentions_with_a_documents_keys_as_one_row(spark):
    lines = spark.createDataFrame([(1, 1, "none [] here"), (1, 2, "see [ a ] and [b]"), (1, 3, "[a] again, [ab]"), (2, 1, "[b] of another, [c]"), (3, 1, None)], "doc_id int, line_no int, line string")
    rows = [(1, "a"), (1, "a"), (1, "c"), (1, ""), (2, "b"), (3, "a"), (4, "a")]
    arrays = [(1, ["a", "c", ""]), (1, ["a"]), (2, ["b"]), (2, None), (3, ["a"])]
    want = [(1, "a", 2, "see [ a ] and [b]"), (2, "b", 1, "[b] of another, [c]")]
    assert sorted(map(tuple, X.key_mentions(lines, spark.createDataFrame(rows, "doc_id int, key string")).collect())) == want
    assert sorted(map(tuple, X.key_mentions(lines, spark.createDataFrame(arrays, "doc_id int, keys array<string>")).collect())) == want


def test_citations_of_one_kind_are_scored_once(spark):
    cited = [(i, "t", "deep learning of protein structure", ["Ann Li"], None if i == 3 else 2001, "Nature, 2001") for i in range(5)] + [(5, "t", "deep learning of protein structure", ["Bo Wu"], 2001, "x"), (6, "v", "graphs", [], 2001, "In Nature, 2001 and more text"), (7, "v", "graphs", [], 2001, "In Science, 2001 and more"), (8, "none", None, None, None, None)]
    cited = spark.createDataFrame(cited, "citation_key int, asked string, c_title string, c_authors array<string>, c_year int, c_raw string")
    given = spark.createDataFrame([("t", 1, "deep learning of protein structure", ["Ann Li"], 2001, None), ("t", 2, "deep learning", ["Bo Wu"], 2001, ""), ("v", 1, "graphs", [], 2001, "Nature")], "asked string, seq int, title string, authors array<string>, year int, venue string")
    kept, kinds = R.by_kind(cited, given, "asked")
    of = {r.citation_key: r.kind for r in kept.collect()}
    assert sorted(of) == list(range(9)) and len({of[i] for i in range(5)}) == 1 and len(set(of.values())) == kinds.count() == 5
    shown = ["title_score", "author_score", "year_score", "venue_score", "status", "match_score"]
    told = R.score_candidates(kinds.join(given, "asked")).select("kind", "seq", *shown)
    got = kept.join(told, "kind").select("citation_key", "seq", *shown)
    want = R.score_candidates(cited.join(given, "asked")).select("citation_key", "seq", *shown)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 14


def test_tokens_of_authors_are_made_once_for_citations_that_agree(spark):
    cited = spark.createDataFrame([(i, "t", "graphs", ["Ann Li"] if i % 2 else ["ann", "LI"], 2001, "x") for i in range(6)], "citation_key int, asked string, c_title string, c_authors array<string>, c_year int, c_raw string")
    given = spark.createDataFrame([("t", None)], "asked string, venue string")
    kept, kinds = R.by_kind(cited, given, "asked")
    # Authors that differ may have the same tokens, which are one kind; the citations themselves are never cut into tokens.
    assert kinds.count() == 1 and kept.select("kind").distinct().count() == 1 and kept.count() == 6
    assert "array_join(" not in kept._jdf.queryExecution().optimizedPlan().toString()
