"""Text functions, Column to Column, all inside the JVM. Patterns use Unicode classes, as \\w and \\s of Python do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeproof.lexicons import CLAUSE_WORDS_EN, CLAUSE_WORDS_ZH, STEM_SUFFIXES, SYNONYMS, TITLE_STOP_WORDS

# Patterns that results depend on.
DOI = r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"
YEAR = r"(?U)\b(19\d{2}|20\d{2})\b"
CLAUSE_END = r"(?iU)(?:[;,]|\b(?:" + "|".join(CLAUSE_WORDS_EN) + r")\b|" + "|".join(CLAUSE_WORDS_ZH) + ")"


def literals(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is worked out once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fenced(value: Column) -> Column:
    """The value, as a column that no filter is pushed below and no other projection takes in: else it would be worked
    out anew for each use."""
    return F.when(F.spark_partition_id() >= 0, value)


def blank_as_null(x: Column) -> Column:
    return F.when(x != "", x)


def found(x: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return blank_as_null(F.regexp_extract(x, pattern, group))


def strip(x: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def contains_any(x: Column, words: list[str]) -> Column:
    """Whether any of the words is a substring; false for null. Words that hold another of them add nothing."""
    words = [w for w in words if not any(v != w and v in w for v in words)]
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(x, F.lit(w))
    return F.coalesce(hit, F.lit(False))


def normalize_doi(doi: Column) -> Column:
    """Lower case without resolver address or doi: prefix; null unless it begins with 10."""
    clean = F.lower(strip(doi))
    clean = F.regexp_replace(clean, r"^https?://(?:dx\.)?doi\.org/", "")
    clean = F.regexp_replace(clean, r"^doi:\s*", "")
    return F.when(F.startswith(clean, F.lit("10.")), clean)


def provider_doi(doi: Column) -> Column:
    """The weaker cleaning that provider lookups use: lower case without the resolver's address."""
    return strip(F.replace(F.replace(F.lower(doi), F.lit("https://doi.org/"), F.lit("")), F.lit("http://doi.org/"), F.lit("")))


def extract_doi(x: Column) -> Column:
    """The first DOI of a text without the punctuation that ends a sentence or bracket; null if there is none."""
    return F.rtrim(found(x, DOI), F.lit(".,;:!?)]}>"))


def arxiv_id(x: Column) -> Column:
    return found(x, r"(\d{4}\.\d{4,5})", 1)


def is_arxiv_target(x: Column) -> Column:
    """Any web address, a mention of arxiv.org, or a bare id."""
    return F.startswith(x, F.lit("http://")) | F.startswith(x, F.lit("https://")) | F.contains(x, F.lit("arxiv.org")) | x.rlike(r"^\d{4}\.\d{4,5}(v\d+)?$")


def looks_like_doi(title: Column) -> Column:
    """A title that is used as a DOI: 10. stands somewhere in it."""
    return F.coalesce(F.contains(title, F.lit("10.")), F.lit(False))


def year_of(x: Column) -> Column:
    return F.expr("cast(null as int)") if x is None else found(x, YEAR, 1).try_cast("int")


def strip_math_and_code(x: Column) -> Column:
    """Without fenced and inline code, LaTeX environments, display and inline math, in this order."""
    for pattern in (
        r"```[\s\S]*?```",
        r"`[^`\n]+`",
        r"\\begin\{(?:equation|align|math|eqnarray)\*?\}[\s\S]*?\\end\{(?:equation|align|math|eqnarray)\*?\}",
        r"\$\$[\s\S]*?\$\$",
        r"(?U)\$(?!\s)[^\$\n]+(?<!\s)\$",
    ):
        x = F.regexp_replace(x, pattern, "")
    return x


def core_title(raw: Column) -> Column:
    """The title in a raw citation: before the type tag, after its number and authors, without a long subtitle or a year."""
    head = F.regexp_replace(F.split(raw, r"\[[JMDNRCP]\]", 2)[0], r"(?U)^\[\d+\]\s*", "")
    # Each step is worked out once: written out, they would repeat the ones before them dozens of times.
    later = lambda parts, least: F.length(strip(F.get(parts, F.lit(1)))) > least
    title = let(F.split(head, r"(?U)[.。]\s*", 2), lambda parts: F.when(later(parts, 3), F.get(parts, F.lit(1))).otherwise(parts[0]))
    title = let(title, lambda whole: let(F.split(whole, "[—–:：]", 2), lambda halves: F.when(later(halves, 40), halves[0]).otherwise(whole)))
    return F.when(F.coalesce(raw, F.lit("")) == "", "").otherwise(strip(F.regexp_replace(title, r"(?U)\s*\d{4}\.?\s*$", "")))


def words(x: Column) -> Column:
    """Runs of word characters, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\w+"), F.lit(0))


def words_from(x: Column, least: int) -> Column:
    return F.filter(words(x), lambda w: F.length(w) >= least)


def title_tokens(x: Column) -> Column:
    """Words of two or more letters, Latin or Han, without stop words; in order, with repeats."""
    return F.filter(words(x), lambda w: w.rlike(r"^[a-z\u4e00-\u9fa5]{2,}$") & ~w.isin(TITLE_STOP_WORDS))


def stem(word: Column) -> Column:
    """A word of more than four letters without the first suffix that ends it."""
    return F.when(F.length(word) > 4, F.regexp_replace(word, "(?:" + "|".join(STEM_SUFFIXES) + r")\z", "")).otherwise(word)


def _stemmed(word: str) -> str:
    return next((word[: -len(s)] for s in STEM_SUFFIXES if len(word) > 4 and word.endswith(s)), word)


def stems(x: Column) -> Column:
    """The distinct stems of a text's words of two or more characters, and of their synonyms."""
    other = F.create_map(*[y for k, v in SYNONYMS.items() for y in (F.lit(k), literals([_stemmed(s) for s in v]))])
    # Few words have synonyms: they are told by a hash set before the map is searched.
    known = lambda y: F.when(y.isin(list(SYNONYMS)), F.try_element_at(other, y))
    return let(words_from(x, 2), lambda w: F.array_distinct(F.concat(F.transform(w, stem), F.flatten(F.filter(F.transform(w, known), lambda y: y.isNotNull())))))


def trigrams(x: Column) -> Column:
    """Distinct runs of three characters, punctuation removed; none for shorter texts."""
    clean = strip(F.regexp_replace(F.lower(x), r"(?U)[^\w\s]", ""))
    chars = F.split(clean, "")
    grams = F.transform(F.array(chars), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2))))
    return F.when(F.length(clean) >= 3, F.array_distinct(grams[0])).otherwise(F.array().cast("array<string>"))


def trigram_codes(x: Column) -> Column:
    """The same runs as numbers, the three code points side by side: for counting, they are made and compared faster."""
    clean = strip(F.regexp_replace(F.lower(x), r"(?U)[^\w\s]", ""))
    codes = F.transform(F.split(clean, ""), lambda c: F.ascii(c).cast("bigint"))
    grams = F.transform(F.array(codes), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.get(c, i) * 2**42 + F.get(c, i + 1) * 2**21 + F.get(c, i + 2)))
    return F.when(F.length(clean) >= 3, F.array_distinct(grams[0])).otherwise(F.array().cast("array<bigint>"))


def sentences(x: Column) -> Column:
    """Sentences of four or more characters, in order."""
    return F.filter(F.transform(F.split(x, r"(?U)[。！？；.!?;\n]+\s*"), strip), lambda s: F.length(s) >= 4)


def clauses(x: Column) -> Column:
    """Clauses of three or more characters, in order; the text itself if there is none, nothing of an empty text."""
    parts = F.filter(F.transform(F.split(x, CLAUSE_END), strip), lambda s: F.length(s) >= 3)
    return F.when(F.coalesce(x, F.lit("")) == "", F.array().cast("array<string>")).when(F.size(parts) > 0, parts).otherwise(F.array(x))


def normalized_title(x: Column) -> Column:
    """For telling candidates apart: lower case, no punctuation, single spaces."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(x)), r"(?U)[^\w\s]", ""), r"(?U)\s+", " ")


def rounded(x: Column, places: int) -> Column:
    """A value from 0 to under 2, rounded to the nearest decimal of its exact binary value, as printed decimals are.

    The value is an integer number of 2 ** -62 (but for what is under 2 ** -10), and integers tell which side of a tie it is on.
    """
    one, wide = F.lit(2**62).cast("decimal(38,0)"), "decimal(38,0)"
    scaled = (x * float(2**62)).cast("bigint").cast("decimal(20,0)") * F.lit(10**places).cast("decimal(8,0)")
    rest = (scaled % one).cast(wide)
    below = ((scaled - rest) / one).cast("bigint")
    half = F.lit(2**61).cast(wide)
    up = (rest > half) | ((rest == half) & (below % 2 == 1))
    return (below + up.cast("bigint")) / F.lit(float(10**places))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """The same for arrays without repeats, whose union needn't be made."""
    return let(F.size(F.array_intersect(a, b)), lambda n: n / F.greatest(F.size(a) + F.size(b) - n, F.lit(1)))


def overlap(a: Column, b: Column) -> Column:
    """The share of a's elements that b has."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))


def cache_key(namespace: str, *args: Column) -> Column:
    """SHA-256 of the namespace and the arguments that aren't empty, stripped and lower-cased."""
    return F.sha2(F.concat_ws("|", F.lit(namespace), *[F.when(a != "", F.lower(strip(a))) for a in args]), 256)


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def text_of_positions(index: Column) -> Column:
    """A text from its inverted index, a map of words to their positions."""
    spread = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(spread), lambda s: s["w"]), " ")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(?<=[^/])(\.[^./]*)\z", 1))


def quoted(x: Column) -> Column:
    """Percent-encoded, a space as %20."""
    return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
