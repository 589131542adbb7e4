"""Title search over tables of works: the exact best few by shared title tokens, from posting lists, rarest tokens first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeproof.functions.text import title_tokens
from citeproof.storage import checkpointed, written

_SET = ["catalogue", "tokens"]


def search(queries: DataFrame, works: DataFrame, limit: int = 5) -> DataFrame:
    """(citation_key, position, works' columns): the `limit` works that share most title tokens with each query, best first.

    queries: citation_key, query; works: work_id, title, ... Stands in for a provider's title search. Of works that share
    as many tokens the smaller work_id is better. Null titles and queries, and those without a token, find nothing.
    """
    found = search_catalogues(queries, works.withColumn("catalogue", F.lit(0)), limit)
    return found.drop("catalogue")


def search_catalogues(queries: DataFrame, works: DataFrame, limit: int = 5) -> DataFrame:
    """(catalogue, citation_key, position, works' columns): the same for works (catalogue, work_id, title, ...) of several
    catalogues, each searched by itself.

    Queries become sets of tokens, the rarest of their catalogue first, and equal sets are searched once. What a work
    shares begins with some token of the set, so it is found in that token's posting list, counted over the tokens from
    there on; the best of each such rest of a set are enough, whatever the tokens before it are: works that they have in
    common as well are only better. Rests of frequent tokens are few and common to many queries, so a word that stands in
    most titles costs its list once for each different rest, and not for each query. Rounds take the rests that begin with
    the 1st, 2nd, 3rd to 4th, 5th to 8th ... token, and a set goes no further when the tokens left can't reach its worst.
    """
    queries = checkpointed(queries.select("citation_key", "query"))
    first = F.row_number().over(Window.partitionBy("catalogue", "title").orderBy("work_id"))
    # Works of one title are as good as each other and go by work_id; lists hold titles, told apart by their first work.
    firsts = checkpointed(works.where("title is not null").select("catalogue", "work_id", "title", first.alias("_n")).where(F.col("_n") <= limit))
    titles = firsts.where("_n = 1").select("catalogue", F.col("work_id").alias("first_id"), F.array_distinct(title_tokens(F.col("title"))).alias("own"))
    lists = titles.select("catalogue", "first_id", "own", F.explode("own").alias("token"))
    rarity = lists.groupBy("catalogue", "token").agg(F.count("*").alias("n"))
    asked = queries.select("query").distinct().select("query", F.explode(F.array_distinct(title_tokens(F.col("query")))).alias("token"))
    known = asked.join(rarity, "token").groupBy("query", "catalogue").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("tokens"))
    sets = checkpointed(known)
    active, done, best, at = sets.select(*_SET).distinct(), 0, None, 1
    kept: list[DataFrame] = []
    while True:
        rests = active.select(*_SET, F.explode(F.sequence(F.lit(done + 1), F.least(F.lit(at), F.size("tokens")))).alias("from")).select(*_SET, F.expr("slice(tokens, `from`, size(tokens))").alias("rest"))
        ahead = rests.select("catalogue", "rest").distinct().withColumn("token", F.element_at("rest", 1))
        shared = F.size(F.array_intersect("rest", "own"))
        by_rest = Window.partitionBy("catalogue", "rest").orderBy(F.desc("_shared"), "first_id")
        hits = ahead.join(lists, ["catalogue", "token"]).select("catalogue", "rest", "first_id", "own", shared.alias("_shared"))
        hits = hits.withColumn("_n", F.row_number().over(by_rest)).where(F.col("_n") <= limit).select("catalogue", "rest", "first_id", "own")
        more = rests.join(hits, ["catalogue", "rest"]).select(*_SET, "first_id", F.size(F.array_intersect("tokens", "own")).alias("shared"))
        if best is not None:
            more = more.unionByName(best.where("not over").drop("over"))
        whole = Window.partitionBy(*_SET)
        top = more.distinct().withColumn("_n", F.row_number().over(whole.orderBy(F.desc("shared"), "first_id"))).where(F.col("_n") <= limit)
        # Nothing unseen shares more tokens than are left; where as many, it could still have a smaller work_id.
        full = (F.count("*").over(whole) >= limit) & (F.min("shared").over(whole) > F.size("tokens") - at)
        best = checkpointed(top.withColumn("over", full | (F.size("tokens") <= at)).drop("_n"))
        kept.append(best.where("over").drop("over"))
        active = best.where("not over").select(*_SET).distinct()
        if active.isEmpty():
            break
        done, at = at, 2 * at
    found = reduce(DataFrame.unionByName, kept)
    titled = titles.select("catalogue", "first_id").join(firsts.where("_n = 1").select("catalogue", F.col("work_id").alias("first_id"), "title"), ["catalogue", "first_id"])
    of_set = found.join(titled, ["catalogue", "first_id"]).join(firsts.select("catalogue", "title", "work_id"), ["catalogue", "title"])
    place = F.row_number().over(Window.partitionBy(*_SET).orderBy(F.desc("shared"), "work_id"))
    of_set = of_set.select(*_SET, "work_id", place.alias("position")).where(F.col("position") <= limit)
    by_query = queries.join(sets, "query").select("citation_key", *_SET)
    # Written, so that the optimizer knows their size: else all works may be broadcast to meet a few places.
    placed = written(by_query.join(of_set, _SET).select("catalogue", "citation_key", "position", "work_id"))
    return placed.join(works, ["catalogue", "work_id"])
