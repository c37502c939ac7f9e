"""What a search answers with: compact hits, whole hits, and what either costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .retrieval import snippet

PREVIEW = 200
#: What each kind's compact hit says about itself; other kinds leave it null.
METADATA = {"knowledge": ("repo", "file", "host", "tags"), "fact": ("fact_type",), "event": ("category",)}
COMPACT = ("query_id", "id", "rank", "kind", "author", "score", "raw", "age_seconds", *(name for names in METADATA.values() for name in names), "copies", "snippet")


def with_snippets(hits: DataFrame, as_of: Column) -> DataFrame:
    """``hits`` (query, text, kind, created_at, copies and the metadata of all kinds) with ``snippet`` and ``age_seconds``, and with nulls where a hit's kind has no such field or no copy was collapsed."""
    own = {name: F.when(F.col("kind") == kind, F.col(name)) for kind, names in METADATA.items() for name in names}
    age = F.greatest(F.unix_seconds(as_of) - F.unix_seconds("created_at"), F.lit(0))
    return hits.withColumns({**own, "copies": F.nullif("copies", F.lit(0)), "age_seconds": age, "snippet": snippet("text", "query")})


def compact(hits: DataFrame) -> DataFrame:
    """One row per hit of ``with_snippets``, without its text; ``truncated`` says of the whole page whether a snippet was cut.

    A page has at most k rows, so its window is small.
    """
    cut = F.bool_or(F.contains("snippet", F.lit("…"))).over(Window.partitionBy("query_id"))
    return hits.select(*COMPACT, F.coalesce(cut, F.lit(False)).alias("truncated"))


def whole(hits: DataFrame) -> DataFrame:
    """One row per hit with its text and the text's first 200 characters."""
    return hits.select(*COMPACT[:-1], "text", F.substring("text", 1, PREVIEW).alias("preview"))


def costs(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, full_tokens, compact_tokens, answered, carried) of each query of ``answers`` (query_id, keys).

    A query is answered if a hit's text holds all its keys as terms; its answer is carried if such a hit's snippet does, too.
    Where it is not, one whole record is charged to the compact form: that of the first hit that answers.
    """
    holds = lambda c: F.size(F.array_except("keys", tx.terms(F.col(c)))) == 0
    rows = hits.join(answers.select("query_id", "keys"), "query_id")
    each = rows.select("query_id", "rank", tx.json_cost(*COMPACT[1:-1], "text").alias("full"), tx.json_cost(*COMPACT[1:]).alias("short"), holds("text").alias("answers"), holds("snippet").alias("shows"))
    fetched = F.min_by(F.when(F.col("answers"), F.col("full")), F.when(F.col("answers"), F.col("rank")))
    per = each.groupBy("query_id").agg(F.sum("full").alias("full"), F.sum("short").alias("short"), fetched.alias("fetch"), F.bool_or("answers").alias("found"), F.bool_or(F.col("answers") & F.col("shows")).alias("shown"))
    all_ = answers.select("query_id").join(per, "query_id", "left")
    answered, carried, none = F.coalesce("found", F.lit(False)), F.coalesce("shown", F.lit(False)), F.lit(0).cast("bigint")
    fetch = F.when(answered & ~carried, F.col("fetch")).otherwise(none)
    return all_.select("query_id", F.coalesce("full", none).alias("full_tokens"), (F.coalesce("short", none) + fetch).alias("compact_tokens"), answered.alias("answered"), carried.alias("carried"))


def cost_summary(per_query: DataFrame) -> DataFrame:
    """One row: queries, answered ones, records charged, tokens per answered query in both forms (whole numbers) and how many times the compact form is smaller.

    The tokens of all queries are shared by the answered ones; without any the last three are null.
    """
    n = F.count_if("answered")
    whole_per, short_per = F.floor(F.try_divide(F.sum("full_tokens"), n)), F.floor(F.try_divide(F.sum("compact_tokens"), n))
    ratio = F.round(whole_per / F.greatest(short_per, F.lit(1)), 2)
    return per_query.agg(F.count(F.lit(1)).alias("queries"), n.alias("answered"), F.count_if(F.col("answered") & ~F.col("carried")).alias("fetches"), whole_per.alias("full_per_answer"), short_per.alias("compact_per_answer"), ratio.alias("ratio"))
