"""Claims against texts: best sentence, polarity, and tiers. DataFrame in, DataFrame out; columns are added in stages so that
no array is worked out twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeproof.config import THRESHOLDS, Thresholds
from citeproof.functions.similarity import sentence_scores
from citeproof.functions.text import clauses, contains_any, fenced, jaccard_of_sets, let, literals, overlap, rounded, sentences, stem, stems, trigram_codes, words, words_from
from citeproof.lexicons import CONCEPTS, FALLING, NEGATIONS_EN, NEGATIONS_ZH, RISING


def concepts_named(text: Column) -> Column:
    """For each concept whether the lower-cased text names it, as 0 and 1."""
    return F.struct(*[contains_any(text, c).cast("int").alias(f"c{i}") for i, c in enumerate(CONCEPTS)])


def concept_share(a: Column, b: Column) -> Column:
    """Of the concepts that either text names (concepts_named), the share that both name; null if none is named."""
    named = [(a[f"c{i}"], b[f"c{i}"]) for i in range(len(CONCEPTS))]
    both = sum((F.least(x, y) for x, y in named), F.lit(0))
    any_ = sum((F.greatest(x, y) for x, y in named), F.lit(0))
    return F.when(any_ > 0, both / any_)


def negated(text: Column, targets: Column) -> Column:
    """Whether an English negation has one of the target stems among its next four words (any word if there are no
    targets), or a Chinese one stands anywhere."""
    plain = F.filter(words(text), lambda w: w.rlike("^[a-z]+$"))
    near = F.transform(F.array(plain), lambda ws: F.exists(F.transform(ws, lambda w, i: w.isin(NEGATIONS_EN) & ((F.size(targets) == 0) | F.arrays_overlap(F.transform(F.slice(ws, i + 2, F.lit(4)), stem), targets))), lambda x: x))
    return F.coalesce(near[0], F.lit(False)) | contains_any(text, NEGATIONS_ZH)


def claim_features(df: DataFrame, claim: str) -> DataFrame:
    """df with what lexical_features needs of the claim; made before a claim's row is repeated for each sentence."""
    return df.withColumns({"_cs": stems(F.col(claim)), "_cg": trigram_codes(F.col(claim)), "_ct": F.array_distinct(words_from(F.col(claim), 3))})


FEATURES = ("stem_overlap", "trigram_jaccard", "token_overlap", "concept_share")


def lexical_features(df: DataFrame, claim: str, sentence: str, only: tuple[str, ...] = FEATURES) -> DataFrame:
    """stem_overlap, trigram_jaccard, token_overlap and concept_share, or some of them, of two text columns."""
    df = df if "_cs" in df.columns else claim_features(df, claim)
    columns = [c for c in df.columns if c not in ("_cs", "_cg", "_ct")]
    if "concept_share" in only:
        # In stages of their own, each text lower-cased and searched once: in one expression each use would do both again.
        for text, low, named in ((claim, "_lc", "_nc"), (sentence, "_ls", "_ns")):
            df = df.withColumn(low, fenced(F.lower(text))).withColumn(named, fenced(concepts_named(F.col(low))))
    each = {
        "stem_overlap": overlap(F.col("_cs"), stems(F.col(sentence))),
        "trigram_jaccard": let(trigram_codes(F.col(sentence)), lambda g: jaccard_of_sets(F.col("_cg"), g)),
        "token_overlap": overlap(F.col("_ct"), F.array_distinct(words_from(F.col(sentence), 3))),
        "concept_share": concept_share(F.col("_nc"), F.col("_ns")) if "concept_share" in only else None,
    }
    features = F.struct(*[each[f].alias(f) for f in only])
    return df.withColumn("_f", fenced(features)).select(*columns, "_f.*")


def most_relevant_clause(df: DataFrame, claim: str, sentence: str, out: str = "clause") -> DataFrame:
    """The first of the clauses that shares most stems with the claim; the sentence itself if it has one clause."""
    df = df.withColumns({"_cs": stems(F.col(claim)), "_cl": clauses(F.col(sentence))})
    ranked = F.transform("_cl", lambda c, i: F.struct(F.size(F.array_intersect(stems(c), F.col("_cs"))).alias("n"), (-i).alias("i"), c.alias("c")))
    return df.withColumn(out, F.when(F.size("_cl") > 1, F.array_max(ranked)["c"]).otherwise(F.col(sentence))).drop("_cs", "_cl")


def may_conflict(claim: Column, sentence: Column) -> Column:
    """Whether the two texts, lower-cased, hold any word without which they can't point opposite ways: far cheaper than
    clauses and stems. A clause may part a negation from Chinese letters, so only Latin ones end a word here."""
    negation = r"(?<![a-z])(?:" + "|".join(NEGATIONS_EN) + r")(?![a-z])"
    either = [x.rlike(negation) | contains_any(x, NEGATIONS_ZH) for x in (claim, sentence)]
    return F.coalesce(contains_any(claim, RISING + FALLING), F.lit(False)) | F.coalesce(either[0], F.lit(False)) | F.coalesce(either[1], F.lit(False))


def with_conflict(df: DataFrame, claim: str, sentence: str, out: str) -> DataFrame:
    """df with what polarity_conflict tells, worked out in each row; of texts that can't conflict nothing else is made."""
    own = [c for c in df.columns if c != out]
    may = fenced(may_conflict(F.lower(claim), F.lower(sentence)))
    named = df.withColumn("_may", may).withColumns({"_pc": F.when(F.col("_may"), F.col(claim)), "_ps": F.when(F.col("_may"), F.col(sentence))})
    pairs = most_relevant_clause(named, "_pc", "_ps", "_clause")
    c, s = F.lower("_pc"), F.lower("_clause")
    pairs = pairs.withColumn("_clause", fenced(F.col("_clause"))).withColumn("_shared", fenced(F.array_intersect(stems(c), stems(s))))
    shared = F.col("_shared")
    signs = {"_up_c": contains_any(c, RISING), "_down_c": contains_any(c, FALLING), "_up_s": contains_any(s, RISING), "_down_s": contains_any(s, FALLING), "_zh_c": contains_any(c, NEGATIONS_ZH), "_zh_s": contains_any(s, NEGATIONS_ZH)}
    pairs = pairs.withColumn("_signs", fenced(F.when(F.col("_may"), F.struct(*[v.alias(k) for k, v in signs.items()])))).select("*", "_signs.*")
    turned = (F.col("_up_c") & F.col("_down_s") & ~F.col("_down_c")) | (F.col("_down_c") & F.col("_up_s") & ~F.col("_down_s"))
    skipped = literals(list(" ,.，。!！?？\t\n"))
    chars = lambda x: F.array_except(F.filter(F.split(x, ""), lambda ch: ch != ""), skipped)
    zh = (F.col("_zh_c") != F.col("_zh_s")) & (F.size(F.array_intersect(chars(c), chars(s))) >= 3)
    en = (F.size(shared) > 0) & (negated(F.col("_pc"), shared) != negated(F.col("_clause"), shared))
    told = F.when(F.col("_may"), F.coalesce(turned | zh | en, F.lit(False))).otherwise(F.lit(False))
    return pairs.select(*own, told.alias(out))


def polarity_conflict(df: DataFrame, claim: str, sentence: str, out: str) -> DataFrame:
    """Whether claim and sentence point opposite ways: rising against falling words, a Chinese negation on one side with
    three shared characters, or an English negation of a shared stem on one side."""
    named = df.select(F.col(claim).alias("_c"), F.col(sentence).alias("_s"))
    # Pairs repeat, and what makes them costs far more than bringing the answer back to each.
    told = with_conflict(named.distinct(), "_c", "_s", out)
    return df.join(told, F.col(claim).eqNullSafe(F.col("_c")) & F.col(sentence).eqNullSafe(F.col("_s"))).drop("_c", "_s")


def align(pairs: DataFrame, key: list[str], claim: str = "claim", abstract: str = "abstract", limits: Thresholds = THRESHOLDS) -> DataFrame:
    """pairs with best_sentence, score and alignment_state.

    Every sentence of the abstract is scored on both channels; the best one (the first of equals) is kept, and its scores
    with it. key names the columns that tell pairs apart. Empty or null claims and abstracts are UNVERIFIED.
    """
    whole = pairs.select(*key, F.col(claim).alias("_claim"), F.col(abstract).alias("_abstract"))
    usable = whole.where("_claim <> '' and _abstract <> ''").withColumn("_sentences", sentences(F.col("_abstract")))
    features = claim_features(usable, "_claim")
    one = features.select(*key, "_claim", "_abstract", "_cs", "_cg", "_ct", F.posexplode(F.when(F.size("_sentences") > 0, F.col("_sentences")).otherwise(F.array(F.substring("_abstract", 1, 150)))).alias("_at", "_sentence"), (F.size("_sentences") > 0).alias("_real"))
    scored = lexical_features(one, "_claim", "_sentence").withColumn("_s", sentence_scores(F.lower("_claim"), F.lower("_sentence"), "stem_overlap", "trigram_jaccard", "concept_share", "token_overlap"))
    total = F.when(F.col("_real"), 0.5 * F.col("_s.semantic") + 0.5 * F.col("_s.lexical")).otherwise(F.lit(0.0))
    best = scored.groupBy(*key).agg(F.max_by(F.struct(F.col("_sentence").alias("sentence"), total.alias("total"), F.col("_s.lexical").alias("lexical"), F.col("_s.semantic").alias("semantic")), F.struct(total, -F.col("_at"))).alias("_best"))
    # Sentences of a pair come from one row, so joining on the key brings back the claim without a second copy in the aggregate.
    df = usable.drop("_sentences").join(best, key).withColumn("best_sentence", F.col("_best.sentence"))
    # Of both the sentence and the whole text, where they differ. In the row: claims name numbers and seldom repeat.
    df = with_conflict(df.withColumn("_whole", F.when(F.col("best_sentence") != F.col("_abstract"), F.col("_abstract"))), "_claim", "best_sentence", "_said")
    df = with_conflict(df, "_claim", "_whole", "_held")
    # Fenced, as rounding names its value many times, and one rounded value stands in the other.
    df = df.withColumn("_peak", fenced(rounded(F.col("_best.total"), 2)))
    semantic, lexical, peak = F.col("_best.semantic"), F.col("_best.lexical"), F.col("_peak")
    blended = F.when((semantic >= 0.35) & (lexical < 0.10), F.greatest(semantic, peak)).otherwise(F.greatest(0.5 * semantic + 0.5 * lexical, peak))
    df = df.withColumn("_blended", fenced(blended)).withColumn("_score", fenced(rounded(F.col("_blended"), 2)))
    against = F.col("_said") | F.col("_held")
    score = F.when(against, F.lit(limits.contradiction_score)).otherwise(F.col("_score"))
    state = F.when(against, "CONTRADICTED").when(F.col("_score") >= limits.strong_alignment, "SUPPORTED").when(F.col("_score") >= limits.weak_alignment, "PARTIAL").otherwise("NEUTRAL")
    done = df.select(*key, "best_sentence", score.alias("score"), state.alias("alignment_state"))
    rest = pairs.where(F.coalesce(F.col(claim), F.lit("")).eqNullSafe("") | F.coalesce(F.col(abstract), F.lit("")).eqNullSafe("")).select(*key, F.lit("").alias("best_sentence"), F.lit(0.0).alias("score"), F.lit("UNVERIFIED").alias("alignment_state"))
    return done.unionByName(rest)
