"""Which candidate record a citation means: union, dedup, scores, rank, margin, confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeproof.config import THRESHOLDS, WEIGHTS, Thresholds, Weights
from citeproof.functions.similarity import title_similarity
from citeproof.functions.text import YEAR, blank_as_null, fenced, found, jaccard, normalize_doi, normalized_title, rounded, strip, title_tokens
from citeproof.storage import checkpointed, written

#: No pair passes with a title score under this one.
LOWEST_GATE = 0.35


def union_candidates(providers: list[DataFrame], per_provider: int = 5) -> DataFrame:
    """All candidates (citation_key, position, ...) of the providers in their order, the first few of each; seq orders them."""
    ranked = []
    for rank, frame in enumerate(providers):
        best = F.row_number().over(Window.partitionBy("citation_key").orderBy("position"))
        ranked.append(frame.withColumns({"provider_rank": F.lit(rank), "_n": best}).where(F.col("_n") <= per_provider).drop("_n"))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return both.withColumn("seq", F.col("provider_rank") * per_provider + F.col("position"))


def dedup_candidates(candidates: DataFrame, key: str = "citation_key") -> DataFrame:
    """The first candidate of each DOI, and of those without one the first of each title, first author and year.

    The two kinds never meet. Titles of fewer than five characters are never merged. One window over a citation's few
    candidates: rows without a DOI or a usable title are alone in their class.
    """
    doi = normalize_doi(F.col("doi"))
    title = normalized_title(F.coalesce("title", F.lit("")))
    author = F.lower(strip(F.coalesce(F.get("authors", F.lit(0)), F.lit(""))))
    by_title = F.when(F.length(title) >= 5, F.concat_ws("\u0001", F.lit("t"), title, author, F.coalesce(F.col("year").cast("string"), F.lit(""))))
    same = F.coalesce(F.concat(F.lit("d"), doi), by_title, F.concat(F.lit("s"), F.col("seq").cast("string")))
    first = F.row_number().over(Window.partitionBy(key, "_same").orderBy("seq"))
    return candidates.withColumns({"doi": F.coalesce(doi, F.col("doi")), "_same": same}).withColumn("_n", first).where("_n = 1").drop("_n", "_same")


def author_score(wanted: Column, given: Column) -> Column:
    """0.7 for the first author's first name token (0.49 if it has three letters or fewer) and 0.3 of the shared tokens."""
    distinct = F.array_distinct(wanted)
    first = F.get(wanted, F.lit(0))
    hit = F.when(F.array_contains(given, first), F.when(F.length(first) > 3, 1.0).otherwise(0.7)).otherwise(0.0)
    shared = F.size(F.array_intersect(distinct, given)) / F.greatest(F.size(distinct), F.lit(1))
    return F.when((F.size(wanted) > 0) & (F.size(given) > 0), F.bround(0.7 * hit + 0.3 * shared, 3)).otherwise(0.0)


def year_score(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return F.when(gap == 0, 1.0).when(gap == 1, 0.5).when(gap.isNotNull(), 0.0)


def venue_score(venue: Column, raw: Column) -> Column:
    """1 if the venue's name stands in the raw citation; null without a venue or with little text."""
    return F.when((venue != "") & (F.length(raw) > 20), F.contains(F.lower(raw), F.lower(venue)).cast("double"))


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the title tokens; null if either title has none."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), jaccard(a, b))


def ratio_bound(a: Column, b: Column) -> Column:
    """An upper bound of the sequence ratio of two texts: twice the characters that both have, as often as both have them,
    over all. 1 for two empty ones."""
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    pair = F.struct(chars(a).alias("a"), chars(b).alias("b"))
    often = lambda xs, c: F.size(F.filter(xs, lambda x: x == c))
    shared = lambda p: F.aggregate(F.array_intersect(p["a"], p["b"]), F.lit(0), lambda n, c: n + F.least(often(p["a"], c), often(p["b"], c)))
    total = lambda p: F.size(p["a"]) + F.size(p["b"])
    return F.get(F.transform(F.array(pair), lambda p: F.when(total(p) > 0, 2 * shared(p) / total(p)).otherwise(1.0)), F.lit(0))


def title_scores(pairs: DataFrame, hybrid: bool = True, limits: Thresholds = THRESHOLDS) -> DataFrame:
    """(c_title, title, title_score, _long) for the different pairs of titles. hybrid: 0.6 of the sequence ratio and 0.4 of
    the shared tokens; else the tokens alone. _long: the title has twelve characters and three tokens, so that a low score
    rejects.

    Titles repeat, and only different pairs that need it go to Python: the ratio of equal titles is 1, and pairs whose
    score stays under every gate, whatever their ratio is, are given its upper bound, which rejects them in the same way.
    """
    clean = lambda c: strip(F.coalesce(c, F.lit("")))
    # Written once: several branches read the different pairs, and what they are made from may be a search.
    different = checkpointed(pairs.select("c_title", "title").distinct())
    tokens = {side: different.select(F.col(side)).distinct().select(F.col(side), clean(F.col(side)).alias(f"_{side}"), title_tokens(clean(F.col(side))).alias(f"_tok_{side}")) for side in ("c_title", "title")}
    both = different
    for side, own in tokens.items():
        own = own.withColumnRenamed(side, "_same")
        both = both.join(own, F.col(side).eqNullSafe(F.col("_same"))).drop("_same")
    both = both.withColumns({"_shared": token_similarity(F.col("_tok_c_title"), F.col("_tok_title")), "_long": (F.length("_c_title") >= 12) & (F.size("_tok_c_title") >= 3), "_a": F.lower("_c_title"), "_b": F.lower("_title")})
    if not hybrid:
        return both.select("c_title", "title", F.coalesce("_shared", F.lit(0.0)).alias("title_score"), "_long")
    known = ratio_bounds(both, limits)
    # The two kinds are told apart before Python, which a condition inside one expression would not spare.
    score = F.when((F.col("_a") == "") | (F.col("_b") == ""), 0.0).otherwise(rounded(0.6 * F.col("_ratio") + 0.4 * F.coalesce("_shared", F.col("_ratio")), 3))
    done = known.where("_ratio is not null").select("c_title", "title", score.alias("title_score"), "_long")
    rest = known.where("_ratio is null").select("c_title", "title", title_similarity("_a", "_b", "_shared").alias("title_score"), "_long")
    return done.unionByName(rest)


def ratio_bounds(both: DataFrame, limits: Thresholds = THRESHOLDS) -> DataFrame:
    """both (_a, _b, _shared, _long) with _ratio: the ratio that is known or bounded well enough, null where Python is needed."""
    bound = fenced(ratio_bound(F.col("_a"), F.col("_b")))
    top = 0.6 * F.col("_bound") + 0.4 * F.coalesce("_shared", F.col("_bound"))
    # Under the hard floor, or under the lowest gate for titles that the floor doesn't hold for; clear of rounding.
    under = top < F.when(F.col("_long"), limits.title_hard_floor).otherwise(LOWEST_GATE) - 0.001
    easy = F.when((F.col("_a") == "") | (F.col("_b") == ""), 0.0).when(F.col("_a") == F.col("_b"), 1.0).when(under, F.col("_bound"))
    return both.withColumn("_bound", bound).withColumn("_ratio", easy).drop("_bound")


def author_tokens(authors: Column) -> Column:
    return title_tokens(F.array_join(authors, " "))


def score_candidates(pairs: DataFrame, hybrid: bool = True, limits: Thresholds = THRESHOLDS, weights: Weights = WEIGHTS) -> DataFrame:
    """pairs with title_score, author_score, year_score, venue_score, status and match_score.

    pairs: c_title, c_authors, c_year, c_raw, title, authors, year, venue; and where they were made before the join,
    c_author_tokens and author_tokens of the two. Without hybrid, titles are compared by their
    tokens alone and scores aren't rounded. Rejected pairs stay, with their status and score 0.
    """
    own = title_scores(pairs, hybrid, limits).withColumnsRenamed({"c_title": "_a", "title": "_b"})
    df = pairs.join(own, F.col("c_title").eqNullSafe(F.col("_a")) & F.col("title").eqNullSafe(F.col("_b"))).drop("_a", "_b")
    year = F.coalesce("c_year", found(F.col("c_raw"), YEAR, 1).try_cast("int"))
    own_tokens, tokens = (F.col(n) if n in df.columns else author_tokens(F.col(c)) for n, c in (("c_author_tokens", "c_authors"), ("author_tokens", "authors")))
    df = df.withColumns({"_ca": own_tokens, "_a": tokens})
    df = df.withColumns({"author_score": author_score(F.col("_ca"), F.col("_a")), "year_score": year_score(year, F.col("year").try_cast("int")), "venue_score": venue_score(F.col("venue"), F.col("c_raw"))})
    t, a, y, v = (F.col(f"{n}_score") for n in ("title", "author", "year", "venue"))
    floor = F.col("_long") & (t < limits.title_hard_floor)
    gate = (t >= 0.70) | ((a >= 0.50) & (t >= 0.40)) | ((a >= 0.50) & (F.coalesce(y, F.lit(0.0)) >= 0.5) & (t >= LOWEST_GATE))
    known = [(t, weights.title, F.lit(True)), (a, weights.author, a > 0), (y, weights.year, y.isNotNull()), (v, weights.venue, v.isNotNull())]
    total = sum((F.when(present, F.lit(w) * s).otherwise(0.0) for s, w, present in known), F.lit(0.0))
    weight = sum((F.when(present, F.lit(w)).otherwise(0.0) for _, w, present in known), F.lit(0.0))
    raw = total / weight
    score = rounded(raw, 3) if hybrid else raw
    status = F.when(floor, "REJECTED_HARD_FLOOR").when(~gate, "REJECTED_IDENTITY_GATE").otherwise("ELIGIBLE")
    df = df.withColumns({"status": status, "_raw": score})
    return df.withColumn("match_score", F.when(F.col("status") == "ELIGIBLE", F.col("_raw")).otherwise(0.0)).drop("_ca", "_a", "_long", "_raw")


def by_kind(citations: DataFrame, candidates: DataFrame, asked: str = "citation_key") -> tuple[DataFrame, DataFrame]:
    """citations (asked, c_title, c_authors, c_year, c_raw, ...) with the number of their kind, and the kinds (kind, asked, c_title,
    c_author_tokens, c_year, c_raw).

    Citations of one kind ask for the same candidates (asked, venue, ...) and agree in title, tokens of authors and year:
    what score_candidates tells of a pair depends on nothing else but on the raw text, which is kept apart where a
    candidate names a venue and read for the year where none is given. So a kind's pairs are scored and ranked once,
    however many citations it has, and authors are cut into tokens once for citations that agree in all of this.
    citations are read twice and candidates once more for the pairs.
    """
    venues = candidates.groupBy(F.col(asked).alias("_asked")).agg(F.max(F.coalesce(F.col("venue") != "", F.lit(False))).alias("_venue"))
    year = F.coalesce("c_year", found(F.col("c_raw"), YEAR, 1).try_cast("int"))
    what = {asked: F.col(asked), "c_title": F.col("c_title"), "c_authors": F.col("c_authors"), "c_year": year, "c_raw": F.when(F.col("_venue"), F.col("c_raw"))}
    told = citations.join(venues, F.col(asked) == F.col("_asked"), "left").withColumn("_is", F.struct(*[c.alias(n) for n, c in what.items()])).drop("_asked", "_venue")
    # Written, so that the numbers stay and the optimizer knows how few there are.
    different = written(told.select("_is").distinct().select(F.monotonically_increasing_id().alias("_n"), "_is.*"))
    shown = [asked, "c_title", "c_author_tokens", "c_year", "c_raw"]
    kind = F.min("_n").over(Window.partitionBy(*shown))
    numbered = written(different.withColumn("c_author_tokens", author_tokens(F.col("c_authors"))).withColumn("kind", kind))
    same = [F.col("_is")[n].eqNullSafe(F.col("_k")[n]) for n in what]
    of_kind = numbered.select("kind", F.struct(*what).alias("_k"))
    return told.join(of_kind, reduce(Column.__and__, same)).drop("_is", "_k"), numbered.where("_n = kind").select("kind", *shown)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _grams(word: Column) -> Column:
    """The different runs of one, two and three characters of a word."""
    chars = F.filter(F.split(word, ""), lambda c: c != "")

    def of(cs: Column, n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(cs) - n), lambda i: F.concat(*[F.get(cs, i + k) for k in range(n)]))
        return F.when(F.size(cs) >= n, runs).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(F.array(chars), lambda cs: F.concat(*[of(cs, n) for n in (1, 2, 3)]))))


def containing(texts: DataFrame, needles: DataFrame, key: str, text: str = "text", needle: str = "needle") -> DataFrame:
    """(key, needles' columns) for the needles that stand in the text of a key, both lower-cased by the caller.

    key tells texts apart. A needle's words but its first and last one stand in such a text as whole words, so the longest
    of them tells which texts to search. Needles of one or two words are looked for by the longest of these, which is a
    part of a word of the text: the words of all texts are searched once each, by the part's rarest run of three
    characters. Only keys are repeated for words; a text is read once more for the needles that it may hold.
    Null texts and needles, and needles without a word, find nothing.
    """
    space = r"(?U)\s+"
    inner = F.filter(F.slice(F.split(needle, space), 2, F.greatest(F.size(F.split(needle, space)) - 2, F.lit(0))), lambda w: w != "")
    longest = lambda ws: F.array_max(F.transform(ws, lambda w: F.struct(F.length(w), w.alias("w"))))["w"]
    keyed = needles.select(F.col(needle)).distinct().select(F.col(needle).alias("_needle"), longest(inner).alias("_word"), longest(_words(F.col(needle))).alias("_part"))
    words = texts.select(F.col(key).alias("_key"), F.explode(F.array_distinct(_words(F.col(text)))).alias("_word"))
    whole = words.join(keyed.where("_word is not null").select("_needle", "_word"), "_word").select("_key", "_needle")
    # Parts of words: the words of all texts are far fewer than their places.
    parts = keyed.where("_word is null and _part is not null").select("_needle", "_part")
    grams = words.select("_word").distinct().select("_word", F.explode(_grams(F.col("_word"))).alias("_gram"))
    of_part = F.filter(_grams(F.col("_part")), lambda g: F.length(g) == F.least(F.lit(3), F.length("_part")))
    wanted = parts.select("_needle", "_part", F.explode(of_part).alias("_gram"))
    seen = grams.join(wanted.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_n"))
    # A part with a run that no word has stands nowhere; the other runs are looked for all the same and find less.
    rarest = wanted.join(seen, "_gram").groupBy("_needle", "_part").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    in_words = grams.join(rarest, "_gram").where(F.contains("_word", F.col("_part"))).select("_word", "_needle")
    some = words.join(in_words, "_word").select("_key", "_needle")
    maybe = whole.unionByName(some).distinct()
    bodies = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    held = maybe.join(bodies, "_key").where(F.contains("_text", F.col("_needle"))).select("_key", "_needle")
    return held.join(needles.withColumn("_same", F.col(needle)), F.col("_needle") == F.col("_same")).select(F.col("_key").alias(key), *needles.columns)


def rank_candidates(scored: DataFrame, key: str = "citation_key", min_score: float = THRESHOLDS.min_score) -> DataFrame:
    """Candidates that reach min_score with rank and margin (to the next one; 1 for the last). Ties keep their order."""
    w = Window.partitionBy(key).orderBy(F.desc("match_score"), "seq")
    fit = scored.where(F.col("match_score") >= min_score)
    return fit.withColumns({"rank": F.row_number().over(w), "margin": F.coalesce(F.col("match_score") - F.lead("match_score").over(w), F.lit(1.0))})


def confidence(score: Column, margin: Column, limits: Thresholds = THRESHOLDS) -> Column:
    high = (score >= limits.high_confidence) & (margin >= limits.high_margin)
    medium = (score >= limits.medium_confidence) & (margin >= limits.medium_margin)
    return F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("UNCERTAIN")


def best_candidates(scored: DataFrame, key: str = "citation_key", min_score: float = THRESHOLDS.min_score) -> DataFrame:
    """The best candidate of each citation with match_margin, match_confidence, is_uncertain, and the two best of the uncertain."""
    ranked = rank_candidates(scored, key, min_score)
    two = F.array_sort(F.collect_list(F.when(F.col("rank") <= 2, F.struct("rank", "title", "doi", F.col("match_score").alias("score"), F.coalesce("source", F.lit("API Database")).alias("source")))))
    top = ranked.groupBy(key).agg(two.alias("_two"), F.min_by(F.struct(*[c for c in ranked.columns if c not in (key, "rank")]), "rank").alias("_best"))
    df = top.select(key, "_best.*", "_two").withColumnRenamed("margin", "_margin")
    df = df.withColumn("match_confidence", confidence(F.col("match_score"), F.col("_margin"))).withColumn("is_uncertain", F.col("match_confidence") == "UNCERTAIN")
    return df.withColumns({"match_margin": F.bround("_margin", 3), "ambiguous_candidates": F.when(F.col("is_uncertain"), F.transform("_two", lambda s: F.struct(s["title"], s["doi"], s["score"], s["source"])))}).drop("_margin", "_two")


def local_matches(citations: DataFrame, papers: DataFrame, limits: Thresholds = THRESHOLDS) -> DataFrame:
    """(citation_key, target_text, filename, confidence) from papers (seq, filename, title, authors, year, abstract, fulltext).

    Only papers that share a title token with the citation are scored: without one the title score stays below every
    gate but for titles without tokens, which the containment of titles in full texts still finds. That fallback takes
    the first paper; citations of at least six characters whose title stands in a paper's text.
    """
    named = citations.select("citation_key", F.coalesce(blank_as_null(F.col("title")), F.col("raw_text")).alias("c_title"), F.coalesce(F.col("raw_text"), F.col("title")).alias("c_raw"), F.col("title").alias("_given"))
    named = named.withColumns({"c_authors": F.array().cast("array<string>"), "c_year": F.lit(None).cast("int")})
    left = named.select("citation_key", F.explode(F.array_distinct(title_tokens(F.col("c_title")))).alias("token"))
    right = papers.select("seq", F.explode(F.array_distinct(title_tokens(F.col("title")))).alias("token"))
    blocks = left.join(right, "token").select("citation_key", "seq").distinct()
    # Texts stay behind until it is known which paper's is wanted.
    null = F.lit(None).cast("string")
    pairs = blocks.join(named, "citation_key").join(papers.select("seq", "title", "authors", "year"), "seq").withColumns({"venue": null, "doi": null, "source": null})
    best = best_candidates(score_candidates(dedup_candidates(pairs)), min_score=limits.local_min_score).select("citation_key", "seq", F.bround("match_score", 2).alias("confidence"))
    rest = named.join(best.select("citation_key"), "citation_key", "left_anti").withColumn("_title", F.lower(strip(F.coalesce("_given", F.lit(""))))).where(F.length("_title") >= 6)
    inside = containing(papers.select("seq", F.lower("fulltext").alias("_body")), rest.select("citation_key", "_title"), "seq", "_body", "_title")
    first = inside.groupBy("citation_key").agg(F.min("seq").alias("seq")).withColumn("confidence", F.lit(0.70))
    found_ = best.withColumn("_otherwise", F.lit("")).unionByName(first.withColumn("_otherwise", null))
    text = F.coalesce(blank_as_null(F.col("abstract")), F.col("fulltext"), F.col("_otherwise"))
    return found_.join(papers.select("seq", "abstract", "fulltext", "filename"), "seq").select("citation_key", strip(text).alias("target_text"), "filename", "confidence")
