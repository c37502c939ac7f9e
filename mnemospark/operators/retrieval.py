"""Retrieval over a table of queries: exact and approximate kNN, lexical and full-text lists."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import terms
from ..sources.staging import broadcast_if_small, stage
from .postings import TESTED, Postings, cover_density, holding, holds_all
from .ranking import top_k
from .vectors import InvertedFile, knn, knn_strata

__all__ = ["InvertedFile", "Postings", "cover_density", "knn", "knn_strata"]

CURATED_FLOOR, CURATED_FRACTION = 0.45, 0.82
STOP = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "is", "it", "for", "with", "that", "this")


def curated(scored: DataFrame, best: DataFrame, floor: float = CURATED_FLOOR, fraction: float = CURATED_FRACTION) -> DataFrame:
    """Curated hits that compete: score at least the floor and a fraction of the query's best raw score."""
    own = scored.groupBy("query_id").agg(F.max("score").alias("own_top"))
    other = best.groupBy("query_id").agg(F.max("score").alias("other_top"))
    top = F.greatest("own_top", "other_top")
    return scored.join(own, "query_id").join(other, "query_id", "left").filter(F.col("score") >= F.greatest(F.lit(floor), F.lit(fraction) * top)).drop("own_top", "other_top")


def tier_weight(machine: str = "machine", source: str = "source", extractor: Column | None = None) -> Column:
    """2.0 hand-authored, 1.5 extracted, 1.0 bulk."""
    extracted = F.coalesce(extractor if extractor is not None else F.lit(False), F.lit(False))
    return F.when(F.col(machine).isNotNull(), 1.0).when((F.col(source) == "AgentProposal") & extracted, 1.5).when(F.col(source).isin("AgentProposal", "User"), 2.0).otherwise(1.0)


def volatility_demotion(volatility: str, age_days: Column) -> Column:
    """Volatile memories halve every 30 days after a week, down to a quarter."""
    return F.when((F.col(volatility) == "volatile") & (age_days > 7), F.greatest(F.lit(0.25), F.pow(F.lit(0.5), (age_days - 7) / 30))).otherwise(1.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers to 6 places; null where one is null or their lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    return F.when(F.size(a) == F.size(b), F.round(dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-24)), 6))


def _asked(queries: DataFrame, wanted: Column, query: str) -> tuple[DataFrame, DataFrame]:
    """(query, one) of every query with terms, and (one, wanted): queries that want the same terms are searched as one."""
    each = stage(queries.select(query, F.array_sort(F.array_distinct(wanted)).alias("wanted")), "asked").filter(F.size("wanted") > 0)
    once = stage(each.groupBy("wanted").agg(F.min(query).alias("one")), "once")
    return each.join(once, "wanted").select(query, "one"), once


def _rows(items: DataFrame, own: Column, key: str, **carried: Column) -> DataFrame:
    """(id, own, ...) of the items that have a key and terms. Texts are split once: a condition on the terms before they are staged would split them again."""
    rows = items.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), own.alias("own"), *[c.alias(n) for n, c in carried.items()])
    return stage(rows, "terms").filter(F.size("own") > 0)


def lexical_index(items: DataFrame, text: str = "text", key: str = "id") -> Postings:
    """The postings that ``lexical`` searches."""
    return Postings.of(items, terms(F.col(text)), key)


def _lexical_hits(once: DataFrame, items: DataFrame | Postings, text: str = "text", key: str = "id") -> DataFrame:
    """(one, id) of the items that hold every term of ``once``."""
    if isinstance(items, Postings):
        found = items.holders(once).select("one", "id")
    else:
        met = holding(_rows(items, F.array_distinct(terms(F.col(text))), key), once)
        more = met.filter("own is not null").join(once, "one").filter(holds_all("wanted", "own"))
        found = met.filter("own is null").select("one", "id").unionByName(more.select("one", "id"))
    return stage(found, "hits")


def lexical(queries: DataFrame, items: DataFrame | Postings, text: str = "text", key: str = "id", query: str = "query_id", query_text: str = "query") -> DataFrame:
    """(query, key) of the items that hold every term of the query; ``items`` are rows or their ``lexical_index``."""
    each, once = _asked(queries, terms(F.col(query_text)), query)
    return each.join(_lexical_hits(once, items, text, key).withColumnRenamed("id", key), "one").select(query, key)


def lexical_by_cosine(queries: DataFrame, items: DataFrame | Postings, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) of each query's lexical hits among ``vectors`` (id, embedding) by cosine, best first; those without a vector last.

    Hits are those of queries that want the same terms, not of each query. A query without a vector takes the first ids of these, so only pairs of two vectors
    are multiplied, and no more than k hits of a query, or of the terms it shares, leave a task.
    """
    each, once = _asked(queries, terms(F.col("query")), "query_id")
    each = stage(each.join(queries.select("query_id", F.col("embedding").alias("asked")), "query_id"), "asked")
    kind = F.lit(None).cast(each.schema["query_id"].dataType)
    plain = once.select("one", kind.alias("q"), F.lit(None).cast(each.schema["asked"].dataType).alias("asked"))
    told = plain.unionByName(each.filter("asked is not null").select("one", F.col("query_id").alias("q"), "asked"))
    told = broadcast_if_small(told, F.coalesce(F.size("asked"), F.lit(0)) * 8 + 64)
    met = broadcast_if_small(_lexical_hits(once, items), 64).join(vectors.select("id", "embedding"), "id").withColumn("has", F.col("embedding").isNotNull())
    scored = met.join(told, "one").filter("q is null or has").select("one", "q", "has", "id", cosine(F.col("asked"), F.col("embedding")).alias("score"))
    order = [F.desc_nulls_last("score"), F.col("id")]
    best = stage(top_k(scored, k, order, ["one", "q", "has"]), "best")
    shared = each.select("query_id", "one", F.col("asked").isNotNull().alias("own")).join(best.filter("q is null"), "one").filter("not (own and has)")
    found = best.filter("q is not null").select(F.col("q").alias("query_id"), "id", "score").unionByName(shared.select("query_id", "id", "score"))
    return top_k(found, k, order, ["query_id"]).withColumnRenamed("rn", "rank")


def analysed(text: Column) -> Column:
    """Index terms in order: lower-cased words without stop words, plural and -ing/-ed endings cut."""
    kept = F.filter(terms(text), lambda w: ~w.isin(*STOP))
    ends = lambda w, *tails: reduce(or_, (F.endswith(w, F.lit(t)) for t in tails))
    cut = lambda w, n: F.substring(w, F.lit(1), F.length(w) - n)
    short = lambda w: F.when(F.length(w) <= 4, w).when(ends(w, "ing"), cut(w, 3)).when(ends(w, "ed", "es"), cut(w, 2)).when(ends(w, "s"), cut(w, 1)).otherwise(w)
    return F.transform(kept, short)


def full_text_index(rows: DataFrame, text: str, key: str = "id") -> Postings:
    """The postings that ``full_text`` searches."""
    return Postings.of(rows, analysed(F.col(text)), key)


def _dense_hits(rows: DataFrame, words: Column, boost: Column, key: str, once: DataFrame) -> DataFrame:
    """(one, id, density, boost) of the rows that hold all terms of a query.

    Where no word of a row repeats, its only span runs from the first to the last term; only rows with repeats, and queries with more terms than
    the scan tests, go through Python.
    """
    split = _rows(rows, words, key, boost=boost)
    held = split.select("id", F.array_distinct("own").alias("own"), F.when(F.size(F.array_distinct("own")) < F.size("own"), F.col("own")).alias("words"), "boost")
    at = [F.when(F.col(f"t{n}").isNotNull(), F.array_position("own", F.col(f"t{n}"))) for n in range(TESTED)]
    plain = F.col("words").isNull() & (F.col("n_terms") <= TESTED)
    met = holding(held, once, F.when(plain, F.col("n_terms") / (F.greatest(*at) - F.least(*at) + 1)).alias("density"), F.when(~plain, F.coalesce("words", "own")).alias("words"), F.col("boost"))
    rest = met.filter("words is not null").join(once, "one").filter(holds_all("wanted", "words"))
    places = F.transform("wanted", lambda t: F.filter(F.transform("words", lambda w, i: F.when(w == t, i)), lambda p: p.isNotNull()))
    rest = stage(rest.select("one", "id", places.alias("places"), "boost"), "places")
    rest = stage(rest.select("one", "id", cover_density("places").alias("density"), "boost"), "spans")
    return met.filter("words is null").select("one", "id", "density", "boost").unionByName(rest)


def full_text(queries: DataFrame, rows: DataFrame, text: str, k: int, boost: Column | None = None, key: str = "id", query: str = "query_id", query_text: str = "query", index: Postings | None = None) -> DataFrame:
    """Rows that hold all index terms of a query, by cover density (times ``boost``), k per query; ``index`` is that of ``rows`` or of more rows."""
    each, once = _asked(queries, analysed(F.col(query_text)), query)
    if index is None:
        hits = _dense_hits(rows, analysed(F.col(text)), F.lit(1.0) if boost is None else boost, key, once).withColumnRenamed("id", key)
    else:
        hits = index.holders(once).select("one", F.col("id").alias(key), cover_density("places").alias("density"))
        hits = hits.join(rows.select(F.col(key).cast("string").alias(key), (boost if boost is not None else F.lit(1.0)).alias("boost")), key)
    scored = hits.select("one", key, F.round(F.col("density") * F.col("boost"), 6).alias("score"))
    best = stage(top_k(scored, k, [F.desc("score"), F.col(key)], ["one"]).withColumnRenamed("rn", "rank"), "best")
    return each.join(best, "one").select(query, key, "score", "rank")


def fact_boost() -> Column:
    """Decay x confidence x (1 + ln(1 + uses))."""
    return F.col("decay_weight") * F.col("confidence") * (F.lit(1.0) + F.log1p(F.col("use_count").cast("double")))


def miss_kind(df: DataFrame, threshold: float = 0.45) -> DataFrame:
    """(query_id, miss): zero_hit, low_score (best raw hit is knowledge below the threshold) or null."""
    return df.select("query_id", F.when(F.col("hits") == 0, "zero_hit").when((F.col("top_kind") == "knowledge") & (F.col("top_raw") < threshold), "low_score").alias("miss"))


@F.pandas_udf(T.StringType())
def snippet(text: pd.Series, query: pd.Series) -> pd.Series:
    """At most 320 characters around the most anchor words, cut at white space nearby, with ellipses."""

    def one(t: str, q: str) -> str:
        size, slack = 320, 24
        if len(t) <= size:
            return t
        anchors = [a.lower() for a in re.split(r"[^\w-]+", q or "") if len(a) >= 3]
        low = t.lower()
        spots = sorted({m.start() for a in set(anchors) for m in re.finditer(re.escape(a), low)})
        start, most, first, last = 0, 0, 0, 0
        for h in spots:  # windows move to the right, and so do the first hit inside and the first beyond
            s = min(max(0, h - 80), len(t) - size)
            while first < len(spots) and spots[first] < s:
                first += 1
            while last < len(spots) and spots[last] < s + size:
                last += 1
            if last - first > most:
                start, most = s, last - first
        end = min(len(t), start + size)
        if start > 0:
            near = re.search(r"\s", t[start : start + slack])
            start += near.end() if near else 0
        if end < len(t):
            near = [m.start() for m in re.finditer(r"\s", t[max(0, end - slack) : end])]
            end = max(0, end - slack) + near[-1] if near else end
        return ("…" if start > 0 else "") + t[start:end] + ("…" if end < len(t) else "")

    return pd.Series([one(a, b) if a is not None else None for a, b in zip(text, query, strict=True)])


def pair_score(query: Column | str, text: Column | str) -> Column:
    """Offline pair scorer: share of the query's distinct terms that the text holds; a model's UDF of this shape can replace it."""
    want = F.array_distinct(terms(F.col(query) if isinstance(query, str) else query))
    have = terms(F.col(text) if isinstance(text, str) else text)
    return F.size(F.array_intersect(want, have)) / F.greatest(F.size(want), F.lit(1))


def rerank(hits: DataFrame, window: int = 50) -> DataFrame:
    """The first ``window`` ranks of each query in order of ``pair`` (ties by rank); the rest keep theirs.

    A query one of whose pairs in the window has no score keeps its order: a scorer that failed moves nothing.
    """
    inside = F.col("rank") <= window
    whole = F.min(F.when(inside, F.col("pair").isNotNull())).over(Window.partitionBy("query_id"))
    marked = hits.withColumn("moves", inside & whole)
    order = [F.when(inside, 0).otherwise(1), F.when(F.col("moves"), -F.col("pair")), F.col("rank")]
    return marked.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).drop("moves")
