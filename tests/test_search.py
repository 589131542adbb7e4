"""Title search, containment and read-through against plain Python, with the plans that must not come back."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from citeproof.functions.similarity import ratio
from citeproof.operators import cache as K
from citeproof.operators import resolve as R
from citeproof.sources import title_search
from citeproof.sources.title_search import search, search_catalogues

STOP = {"the", "of", "and", "in", "for", "on", "with", "to", "by", "an", "at", "from"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def titles(n, seed):
    """Titles of two to seven words; one of the words stands in nine titles of ten."""
    rnd = random.Random(seed)
    words = [a + b + c for a in "bdfgk" for b in "aeo" for c in ("rt", "lm", "x")]
    weights = [1 / (i + 1) for i in range(len(words))]
    out = []
    for _ in range(n):
        t = rnd.choices(words, weights, k=rnd.randint(1, 6))
        out.append(" ".join(t + ["everywhere"] * (rnd.random() < 0.9)))
    return out


def by_python(queries, works, limit):
    out = []
    for key, q in queries:
        asked = set((q or "").split())
        found = sorted((-len(asked & set((t or "").split())), i) for i, t in works if t and asked & set(t.split()))
        out += [(key, k, i) for k, (_, i) in enumerate(found[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize("limit", [1, 5])
def test_search_finds_the_best(spark, limit):
    rnd = random.Random(limit)
    works = list(enumerate(titles(400, 1)))
    works += [(1000 + i, rnd.choice(works)[1]) for i in range(60)] + [(2000, None), (2001, ""), (2002, "1 2 3")]
    rnd.shuffle(works)
    queries = [(f"q{i}", t) for i, t in enumerate(titles(120, 2))] + [("none", None), ("empty", ""), ("unknown", "zzzz yyyy"), ("hot", "everywhere"), ("twice", works[0][1]), ("twice2", works[0][1])]
    w = spark.createDataFrame(works, "work_id int, title string").withColumn("extra", F.lit("x"))
    got = search(spark.createDataFrame(queries, "citation_key string, query string"), w, limit)
    assert got.columns == ["work_id", "citation_key", "position", "title", "extra"]
    assert sorted((r.citation_key, r.position, r.work_id) for r in got.collect()) == by_python(queries, works, limit)


def test_catalogues_are_searched_apart(spark):
    works = list(enumerate(titles(150, 5)))
    queries = [(f"q{i}", t) for i, t in enumerate(titles(40, 6))]
    parts = {"a": works, "b": works[50:], "c": [], "d": works[:30]}
    w = spark.createDataFrame([(c, i, t) for c, ws in parts.items() for i, t in ws], "catalogue string, work_id int, title string")
    got = search_catalogues(spark.createDataFrame(queries, "citation_key string, query string"), w, 3).collect()
    for c, ws in parts.items():
        assert sorted((r.citation_key, r.position, r.work_id) for r in got if r.catalogue == c) == by_python(queries, ws, 3)
    assert search(spark.createDataFrame([], "citation_key string, query string"), w.drop("catalogue")).count() == 0


def test_a_word_of_most_titles_is_not_joined_for_each_query(spark, monkeypatch):
    """Rows of posting lists that meet sets of tokens: far fewer than by joining each query's tokens."""
    works = list(enumerate(titles(3000, 7)))
    queries = [(f"q{i}", t) for i, t in enumerate(titles(400, 8))]
    counted = []
    keep = title_search.checkpointed
    monkeypatch.setattr(title_search, "checkpointed", lambda df: counted.append(df) or keep(df))
    search(spark.createDataFrame(queries, "citation_key string, query string"), spark.createDataFrame(works, "work_id int, title string")).count()
    lists = {}
    for i, t in {t: i for i, t in reversed(works)}.items():
        for x in set(i.split()):
            lists.setdefault(x, set()).add(t)
    every = sum(len(lists.get(x, ())) for _, q in queries for x in set(q.split()))
    rests = set()
    for _, q in queries:
        s = sorted((x for x in set(q.split()) if x in lists), key=lambda x: (len(lists[x]), x))
        rests.update(tuple(s[k:]) for k in range(len(s)))
    assert sum(len(lists[r[0]]) for r in rests) < every / 3
    # Queries, titles and sets, a table a round (sets have seven tokens at most: rounds of 1, 1, 2 and 4), and the places found.
    assert len(counted) <= 3 + 4 + 1


def test_containment_by_words_and_parts(spark):
    rnd = random.Random(3)
    words = ["alpha", "beta", "ab", "a", "ünï", "日本語", "x" * 300, "gamma-ray", "the", "thermal", "mal"]
    texts = [(i, rnd.choice([" ", "\n", "  "]).join(rnd.choices(words, k=rnd.randint(0, 25)))) for i in range(80)] + [(100, None), (101, ""), (102, " \n "), (103, "ends with thermal")]
    needles = ["alpha", "lph", "a", "ab a", "mal the", "the alpha beta", "beta  ab", "gamma-ray the mal", "日本", "本語 a", "zzz", "", " ", None, "x" * 250, "a b", "ha be", "thermal", "ends with thermal", " the", "alpha "]
    needles += [" ".join(rnd.choices(words, k=rnd.randint(1, 5))) for _ in range(60)]
    t = spark.createDataFrame(texts, "id int, body string").withColumn("other", F.lit(1))
    n = spark.createDataFrame(list(enumerate([*needles, "alpha"])), "k int, needle string")
    got = R.containing(t, n, "id", "body")
    want = sorted((i, k) for i, b in texts if b for k, x in enumerate([*needles, "alpha"]) if x and x.strip() and x in b)
    assert sorted((r.id, r.k) for r in got.collect()) == want
    assert got.columns == ["id", "k", "needle"] and "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_texts_are_not_repeated_for_their_words(spark):
    """No row that is exploded to words holds the text; the text is joined by its key alone."""
    t = spark.createDataFrame([(1, "some words of a text")], "id int, body string")
    n = spark.createDataFrame([("some words of",), ("text",)], "needle string")
    generated = [line for line in R.containing(t, n, "id", "body")._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in line]
    assert generated and all("body" not in line.split("explode")[0] and "body" not in line.partition("], false, [")[2] for line in generated)
    assert R.containing(t, n, "id", "body").count() == 2


def test_ratio_bound_holds_and_spares_python(spark):
    rnd = random.Random(4)
    make = lambda: "".join(rnd.choice("abc déf日 ") for _ in range(rnd.randint(0, 30))).strip()
    pairs = [(make(), make()) for _ in range(400)] + [("same title here", "same title here"), ("", ""), ("a", "")]
    bounds = spark.createDataFrame(pairs, "a string, b string").withColumn("bound", R.ratio_bound(F.col("a"), F.col("b"))).collect()
    assert all(r.bound >= ratio(r.a, r.b) - 1e-12 for r in bounds) and sum(r.bound < 0.5 for r in bounds) > 20
    given = spark.createDataFrame([(a, b) for a, b in pairs] + [("Graph theory of large networks", "zzz qqq vvv"), ("Graph theory of large networks", "Graph theory of large networks")], "c_title string, title string")
    exact = {}
    for r in given.distinct().collect():
        x, y = set(r.c_title.split()), set(r.title.split())
        exact[r.c_title, r.title] = (x, y)
    scored = R.title_scores(given).collect()
    assert len(scored) == len(exact)
    by = {(r.c_title, r.title): r.title_score for r in scored}
    assert by["Graph theory of large networks", "Graph theory of large networks"] == 1.0 and by["Graph theory of large networks", "zzz qqq vvv"] < 0.3


def test_pruned_pairs_have_the_same_outcome(spark, monkeypatch):
    """Statuses, scores, ranks and margins are what they are with every pair scored in Python."""
    rnd = random.Random(6)
    words = "graph theory networks deep learning protein folding quantum noise of the climate model".split()
    make = lambda: " ".join(rnd.choices(words, k=rnd.randint(1, 6)))
    rows = [(f"c{i % 40}", i, make().title(), [rnd.choice(["Ann Lee", "Bo Chen"])], 2000 + i % 3, "raw text of the citation " + str(i), make(), [rnd.choice(["Ann Lee", "Cy Roe"])], 2000 + i % 4, None, None, "s") for i in range(400)]
    rows = [(k, n, *(rows[int(k[1:])][2:6]), *r) for k, n, _, _, _, _, *r in rows]
    df = spark.createDataFrame(rows, "citation_key string, seq int, c_title string, c_authors array<string>, c_year int, c_raw string, title string, authors array<string>, year int, venue string, doi string, source string")
    outcome = lambda: sorted((r.citation_key, r.seq, r.status, r.match_score) for r in R.score_candidates(df).collect())
    ranked = lambda: sorted(map(str, R.best_candidates(R.score_candidates(df)).drop("title_score").collect()))
    python = lambda: R.ratio_bounds(df.select("c_title", "title").distinct().withColumns({"_a": F.lower("c_title"), "_b": F.lower("title"), "_shared": F.lit(0.0), "_long": F.lit(True)})).where("_ratio is null").count()
    pruned, best, sent = outcome(), ranked(), python()
    whole = R.ratio_bounds
    monkeypatch.setattr(R, "ratio_bounds", lambda both, limits=None: both.withColumn("_ratio", F.lit(None).cast("double")))
    assert outcome() == pruned and ranked() == best and {s for _, _, s, _ in pruned} == {"ELIGIBLE", "REJECTED_HARD_FLOOR", "REJECTED_IDENTITY_GATE"}
    assert whole is not R.ratio_bounds and sent < df.select("c_title", "title").distinct().count()


def test_read_through_asks_once(spark, tmp_path):
    """Each missing key is asked for once, whatever is read of the results and how often."""
    log = str(tmp_path / "asked")

    def fetch(missing):
        def run(batches):
            for b in batches:
                with open(log, "a") as f:
                    f.writelines(f"{k}\n" for k in b["key"])
                yield b.assign(value=[None if k == "gone" else f"new {k}" for k in b["key"]])[["key", "value"]]

        return missing.mapInPandas(run, "key string, value string")

    entries = spark.createDataFrame([("a", "old", 50, 1), ("a", "live", 150, 2), ("b", "expired", 60, 1)], "key string, value string, expires_at long, seq long")
    requests = spark.createDataFrame([(k,) for k in ["a", "b", "c", "c", "c", "gone", "a", "d"]], "key string").repartition(3)
    answers, new = K.read_through(requests, entries, F.lit(100), fetch)
    for _ in range(2):
        assert sorted((r.key, r.value) for r in answers.collect() if r.key != "gone") == [("a", "live")] * 2 + [("b", "new b")] + [("c", "new c")] * 3 + [("d", "new d")]
        assert sorted((r.key, r.expires_at) for r in new.collect()) == [(k, 100 + 30 * 86400) for k in "bcd"]
    assert [r.value for r in answers.where("key = 'gone'").collect()] == [None]
    assert sorted(open(log).read().split()) == ["b", "c", "d", "gone"]
