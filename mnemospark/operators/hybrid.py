"""Hybrid search over memories, facts and events for a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import broadcast_if_small, stage
from . import ranking as rk
from . import retrieval as rt

#: Order of the lists where fused scores tie.
LISTS = ("vector", "curated", "lexical", "facts", "events")
WINDOW = 50


def representatives(knowledge: DataFrame, *columns: str) -> DataFrame:
    """One live row of each content hash: id, the named columns, and ``copies``, the number of the others.

    Equal texts would fill a list with one answer. The smallest id stands for its copies, one with a vector
    where ``embedding`` is asked for. Rows without a hash stand for themselves.
    """
    row = F.struct("id", *columns)
    order = F.struct(F.col("embedding").isNull(), "id") if "embedding" in columns else F.col("id")
    one = knowledge.filter("deleted_at is null").groupBy(F.coalesce("content_hash", "id").alias("content")).agg(F.min_by(row, order).alias("r"), F.count(F.lit(1)).alias("n"))
    return one.select("r.*", (F.col("n") - 1).alias("copies"))


def candidate_lists(queries: DataFrame, knowledge: DataFrame, facts: DataFrame, events: DataFrame, k: int, wanted: Column | None = None, facts_wanted: Column | None = None, events_wanted: Column | None = None, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lists, representatives): each query's five ranked lists as (query_id, list, kind, id, rank, raw).

    ``queries``: query_id, query and an optional embedding. ``knowledge``: id, text, content_hash, machine, source,
    volatility, age_days, embedding, deleted_at, and what ``wanted`` uses. ``facts`` are live, with payload and what
    ``fact_boost`` uses; ``events`` have id and payload. The three conditions (as ``predicates`` makes them) hold below
    every list, so rows that a search doesn't want take no places, stand for no copies and are scored by nothing. ``texts``
    are ``knowledge`` without its vectors: where these were joined to it, the texts are searched without being moved to them.
    """
    chosen, facts, events = (df if when is None else df.filter(when) for df, when in ((knowledge, wanted), (facts, facts_wanted), (events, events_wanted)))
    reps = stage(representatives(chosen, "machine", "source", "volatility", "age_days", "embedding"), "representatives")
    queries = stage(queries, "queries")
    both = stage(rt.knn_strata(queries, reps, k, {"all": None, "hand": (F.col("source") == "AgentProposal") & F.col("machine").isNull()}), "dense")
    dense = both.filter("stratum = 'all'").drop("stratum")
    hand = rt.curated(both.filter("stratum = 'hand'").drop("stratum"), dense)
    searched = chosen if texts is None else texts if wanted is None else texts.filter(wanted)
    lexical = rt.lexical_by_cosine(queries, searched.filter("deleted_at is null").select("id", "text"), reps, k)
    found = (dense, hand, lexical, rt.full_text(queries, facts, "payload", k, rt.fact_boost()), rt.full_text(queries, events, "payload", k))
    kinds = ("knowledge", "knowledge", "knowledge", "fact", "event")
    out = None
    for name, kind, df in zip(LISTS, kinds, found, strict=True):
        part = df.select("query_id", F.lit(name).alias("list"), F.lit(kind).alias("kind"), "id", "rank", F.col("score").alias("raw"))
        out = part if out is None else out.unionByName(part)
    # at most 5 k rows a query: what follows never touches the corpus again but for the texts of these rows
    return stage(out, "lists"), reps


def vector_list(queries: DataFrame, knowledge: DataFrame, k: int) -> DataFrame:
    """The list ``vector`` of ``candidate_lists`` alone: no text is searched for it."""
    reps = stage(representatives(knowledge, "embedding"), "representatives")
    near = rt.knn(queries, reps, k)
    return stage(near.select("query_id", F.lit("vector").alias("list"), F.lit("knowledge").alias("kind"), "id", "rank", F.col("score").alias("raw")), "lists")


def reranked(lists: DataFrame, queries: DataFrame, knowledge: DataFrame, window: int = WINDOW, scorer=None) -> DataFrame:
    """The vector list's first ``window`` ranks in the order of the pair scorer (``models.pair_scorer``, or the offline one); every list's order stays otherwise."""
    dense = lists.filter("list = 'vector'")
    wanted = broadcast_if_small(dense.select("id").distinct(), 64)
    texts = knowledge.select("id", "text").join(wanted, "id", "left_semi")
    pairs = dense.join(texts, "id").join(queries.select("query_id", "query"), "query_id").withColumn("pair", F.round((scorer or rt.pair_score)("query", "text"), 9))
    moved = rt.rerank(pairs, window).select("query_id", "list", "kind", "id", F.col("new_rank").alias("rank"), "raw")
    return lists.filter("list <> 'vector'").unionByName(moved)


def fused(lists: DataFrame, reps: DataFrame, extractor: Column | None = None) -> DataFrame:
    """(query_id, kind, id, fused, raw, first): reciprocal ranks weighted by provenance and age.

    A row's provenance counts where its raw score competes with the query's best; facts and events weigh 1.
    """
    weighed = reps.select("id", rt.tier_weight(extractor=extractor).alias("tier"), rt.volatility_demotion("volatility", F.col("age_days")).alias("fresh"))
    best = lists.filter("kind = 'knowledge'").groupBy("query_id").agg(F.max("raw").alias("best"))
    rows = lists.join(weighed, "id", "left").join(best, "query_id", "left")
    competes = F.coalesce(F.col("raw") >= F.greatest(F.lit(rt.CURATED_FLOOR), rt.CURATED_FRACTION * F.col("best")), F.lit(False))
    weight = F.when(F.col("kind") == "knowledge", F.when(competes, F.col("tier")).otherwise(1.0) * F.col("fresh")).otherwise(1.0)
    place = F.array_position(F.array(*map(F.lit, LISTS)), F.col("list"))
    each = rows.select("query_id", "kind", "id", "raw", place.alias("place"), (weight / (rk.RRF_K + F.col("rank"))).alias("part"))
    return each.groupBy("query_id", "kind", "id").agg(F.round(F.sum("part"), 9).alias("fused"), F.max("raw").alias("raw"), F.min("place").alias("first"))


def search(queries: DataFrame, knowledge: DataFrame, facts: DataFrame, events: DataFrame, k: int = 10, wanted: Column | None = None, extractor: Column | None = None, facts_wanted: Column | None = None, events_wanted: Column | None = None, scorer=None, texts: DataFrame | None = None) -> DataFrame:
    """(query_id, kind, id, rank, fused, raw, copies): the k best of each query over all lists, of the rows that the conditions want."""
    lists, reps = candidate_lists(queries, knowledge, facts, events, 2 * k, wanted, facts_wanted, events_wanted, texts)
    found = fused(reranked(lists, queries, knowledge if texts is None else texts, scorer=scorer), reps, extractor)
    best = rk.top_k(found, k, [F.desc("fused"), F.col("first"), F.col("id")], ["query_id"]).withColumnRenamed("rn", "rank")
    return best.join(reps.select("id", "copies"), "id", "left").select("query_id", "kind", "id", "rank", "fused", "raw", F.coalesce("copies", F.lit(0)).alias("copies"))


def source_lists(queries: DataFrame, knowledge: DataFrame, facts: DataFrame, events: DataFrame, k: int = 10, wanted: Column | None = None, facts_wanted: Column | None = None, events_wanted: Column | None = None) -> DataFrame:
    """(query_id, list, kind, id, rank, norm, weight): what each source offers a context bundle, k rows a source.

    Three times k rows are fetched, one per content, and their scores divided by the query's best before the list is cut.
    The list ``vector`` weighs provenance (without authors) where a score competes with the best, and age. The list ``text``
    has one budget for facts and events: facts come first, events take what is left; each kind has its own best score.
    Inputs and conditions are those of ``candidate_lists``.
    """
    chosen, facts, events = (df if when is None else df.filter(when) for df, when in ((knowledge, wanted), (facts, facts_wanted), (events, events_wanted)))
    reps = stage(representatives(chosen, "machine", "source", "volatility", "age_days", "embedding").filter("embedding is not null"), "representatives")
    queries = stage(queries, "queries")
    near = rk.normalise(rt.knn(queries, reps, 3 * k), "max", ("query_id",))
    best = F.max("score").over(Window.partitionBy("query_id"))
    near = near.withColumn("boosted", F.col("score") >= F.greatest(F.lit(rt.CURATED_FLOOR), rt.CURATED_FRACTION * best)).filter(F.col("rank") <= k)
    weight = F.when(F.col("boosted"), rt.tier_weight()).otherwise(1.0) * rt.volatility_demotion("volatility", F.col("age_days"))
    vector = near.join(reps.drop("embedding"), "id").select("query_id", F.lit("vector").alias("list"), F.lit("knowledge").alias("kind"), "id", "rank", "norm", weight.alias("weight"))
    found = (("fact", facts, rt.fact_boost()), ("event", events, None))
    text = None
    for kind, rows, boost in found:
        hits = rk.normalise(rt.full_text(queries, rows, "payload", 3 * k, boost), "max", ("query_id",)).withColumn("kind", F.lit(kind))
        text = hits if text is None else text.unionByName(hits)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("kind") != "fact", "rank"))
    text = text.withColumn("place", place).filter(F.col("place") <= k).select("query_id", F.lit("text").alias("list"), "kind", "id", F.col("place").alias("rank"), "norm", F.lit(1.0).alias("weight"))
    return vector.unionByName(text)
