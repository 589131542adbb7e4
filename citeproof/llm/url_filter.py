"""URL filters: rules by host and path, and a character language-model ratio where no rule fits.

Two variable-order Markov models, one for accepted and one for rejected URLs, learn from the URLs that a rule decides, but
for those of about a quarter of the hosts, which calibrate the threshold: a model tells little about URLs it has seen.
Every gram seen counts, so the models grow with the corpus: they are looked up by shuffled joins, once for each different
window of characters. Orders are interpolated: p_k(c) = (n(context, c) + A * p_(k-1)(c)) / (n(context) + A). A URL's score
is its mean log-likelihood difference a character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeproof.llm.runtime import cut

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Characters of context, the smoothing weight A, the share of all characters from which a window is common (at most
#: 1 / LEAST_SHARE are, which are broadcast; the others meet their URLs in a shuffle), symbols of the alphabet, bins of a score's unit, and the first hexadecimal digits of a host's MD5 that keep it for calibration.
ORDER, A, LEAST_SHARE, SYMBOLS, BINS, HELD = 4, 2.0, 1 / 20_000, 64, 1000, "0123"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START = "^"


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    at = F.locate("://", url)
    return F.when(at > 0, F.translate(F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0), _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    at = F.locate("://", url)
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits the host or a parent domain and the path's beginning, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _windows(urls: DataFrame) -> DataFrame:
    """urls (key, url, ...) with one row per character: window, the character after its ORDER characters of context.

    A-Z are lower-cased, digits count as one symbol, and so does everything outside printable ASCII.
    """
    folded = F.regexp_replace(F.translate("url", _UPPER + "123456789", _LOWER + "0" * 9), r"[^\x21-\x7E]", "~")
    chars = urls.where("url <> ''").withColumn("_c", F.split(F.concat(F.lit(START * ORDER), folded), ""))
    c = F.col("_c")
    windows = F.transform(F.sequence(F.lit(0), F.size(c) - ORDER - 1), lambda i: F.concat(*[F.get(c, i + k) for k in range(ORDER + 1)]))
    return chars.withColumn("window", F.explode(windows)).drop("_c", "url")


def train(labelled: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """For each order the grams (gram, ga, gr) and contexts (context, ca, cr) with their counts in accepted and rejected URLs.

    labelled: (url, accepted boolean), each row counting once. Every labelled URL and every gram counts.
    """
    ones = [F.sum(F.when(F.col("accepted") == yes, 1).otherwise(0)).alias(n) for yes, n in ((True, "na"), (False, "nr"))]
    counts = cut(_windows(labelled).groupBy("window").agg(*ones))
    grams, contexts = [], []
    for k in range(1, ORDER + 2):
        seen = counts.groupBy(F.substring("window", ORDER + 2 - k, k).alias("gram")).agg(F.sum("na").alias("ga"), F.sum("nr").alias("gr"))
        grams.append(seen)
        contexts.append(counts.groupBy(F.substring("window", ORDER + 2 - k, k - 1).alias("context")).agg(F.sum("na").alias("ca"), F.sum("nr").alias("cr")))
    return grams, contexts


def ratios(windows: DataFrame, grams: list[DataFrame], contexts: list[DataFrame]) -> DataFrame:
    """windows (window, ...) with ratio, the log-likelihood difference of the last character.

    Only what the alphabet bounds is broadcast: grams and contexts of two characters at most.
    """
    rows = windows
    pa = pr = F.lit(1.0 / SYMBOLS)
    small = lambda df, length: F.broadcast(df) if length <= 2 else df
    for k, (gram, context) in enumerate(zip(grams, contexts, strict=True), 1):
        g = gram.select(F.col("gram").alias(f"g{k}"), F.col("ga").alias(f"ga{k}"), F.col("gr").alias(f"gr{k}"))
        c = context.select(F.col("context").alias(f"c{k}"), F.col("ca").alias(f"ca{k}"), F.col("cr").alias(f"cr{k}"))
        rows = rows.withColumns({f"g{k}": F.substring("window", ORDER + 2 - k, k), f"c{k}": F.substring("window", ORDER + 2 - k, k - 1)})
        rows = rows.join(small(g, k), f"g{k}", "left").join(small(c, k - 1), f"c{k}", "left").drop(f"g{k}", f"c{k}")
        seen = lambda n, old: (F.coalesce(n, F.lit(0)) + A * old)
        known = F.col(f"ca{k}").isNotNull()
        rows = rows.withColumns({f"pa{k}": F.when(known, seen(F.col(f"ga{k}"), pa) / (F.col(f"ca{k}") + A)).otherwise(pa), f"pr{k}": F.when(known, seen(F.col(f"gr{k}"), pr) / (F.col(f"cr{k}") + A)).otherwise(pr)})
        rows = rows.drop(f"ga{k}", f"gr{k}", f"ca{k}", f"cr{k}", *[f"{x}{k - 1}" for x in ("pa", "pr") if k > 1])
        pa, pr = F.col(f"pa{k}"), F.col(f"pr{k}")
    return rows.select(*windows.columns, (F.log(pa) - F.log(pr)).alias("ratio"))


def score(urls: DataFrame, grams: list[DataFrame], contexts: list[DataFrame]) -> DataFrame:
    """(key, bin): the mean log-likelihood difference a character of urls (key, url), in whole BINS-ths, rounded down."""
    rows = _windows(urls.select("key", "url"))
    rated = cut(ratios(rows.groupBy("window").agg(F.count("*").alias("n")), grams, contexts))
    total = rated.agg(F.sum("n")).first()[0] or 0
    common = F.broadcast(rated.where(F.col("n") >= total * LEAST_SHARE).select("window", "ratio"))
    rare = rated.where(F.col("n") < total * LEAST_SHARE).select("window", "ratio")
    sums = [F.sum("ratio").alias("ratio"), F.count("*").alias("chars")]
    parts = rows.join(common, "window").groupBy("key").agg(*sums)
    if not rare.isEmpty():
        left = rows.join(common.select("window"), "window", "left_anti").join(rare, "window")
        parts = parts.unionByName(left.groupBy("key").agg(*sums))
    mean = F.sum("ratio") / F.sum("chars")
    return parts.groupBy("key").agg(F.floor(mean * BINS).cast("bigint").alias("bin"))


def held_out(host: Column) -> Column:
    return F.instr(F.lit(HELD), F.substring(F.md5(host), 1, 1)) > 0


def calibrate(bins: DataFrame) -> int:
    """The threshold for bins (bin, na, nr: accepted and rejected URLs with that score), none of which the models learned from.

    It parts the two kinds best (the largest share of accepted at or above it, less that of rejected; of equals the
    lowest), in the middle between the scores on both its sides. Without URLs of both kinds it is 0, where both models are equally likely.
    """
    # A score has bounded size, so the bins are few whatever the corpus.
    upward, everything = Window.orderBy("bin"), Window.partitionBy(F.lit(1))
    from_here = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = lambda n: F.try_divide(F.sum(n).over(from_here), F.sum(n).over(everything))
    each = bins.select("bin", F.lag("bin").over(upward).alias("below"), (share("na") - share("nr")).alias("parts"))
    best = each.where("parts is not null").orderBy(F.desc("parts"), "bin").first()
    if best is None:
        return 0
    return best["bin"] if best["below"] is None else (best["below"] + best["bin"] + 1) // 2


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, and bin (the score; null where a rule decides).

    The longest fitting rule decides. Other URLs are allowed if their score reaches the calibrated threshold. Null and
    empty URLs have no characters and are allowed; so is everything if the rules accept or reject nothing to learn
    from. Repeated rows give repeated results and count each in training and calibration.
    """
    url = F.col("url")
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host_of(url), "path": path_of(url)})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    named = named.withColumns({"rule": rule, "ruled": verdict})
    labelled = named.where("rule is not null").select("url", (F.col("ruled") == "allow").alias("accepted"), held_out(F.col("host")).alias("held"))
    # Rows without a url get a key of their own each, so that they don't meet in one task.
    out = named.withColumn("key", F.when(url.isNull(), F.xxhash64("page_id")).otherwise(F.xxhash64("url")))
    grams, contexts = train(labelled.where("not held").drop("held"))
    first = grams[0].agg(F.sum("ga").alias("a"), F.sum("gr").alias("r")).first()
    if not first["a"] or not first["r"]:
        return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("bigint").alias("bin"))
    ones = [F.sum(F.when(F.col("ruled") == kind, 1).otherwise(0)).alias(n) for kind, n in (("allow", "na"), ("block", "nr"))]
    # A URL has one rule or none: those that calibrate and those to be judged are scored together.
    each = cut(named.where((F.col("url") != "") & (F.col("rule").isNull() | held_out(F.col("host")))).groupBy(F.xxhash64("url").alias("key")).agg(F.first("url").alias("url"), *ones))
    scored = cut(score(each, grams, contexts))
    bins = scored.join(each.where("na + nr > 0").select("key", "na", "nr"), "key").groupBy("bin").agg(F.sum("na").alias("na"), F.sum("nr").alias("nr"))
    threshold = calibrate(bins)
    scored = scored.repartition("key")
    judged = out.join(scored, "key", "left").withColumn("bin", F.when(F.col("rule").isNull() & (url != ""), F.col("bin")))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bin") < threshold, "block").otherwise("allow")).alias("verdict"), "bin")
