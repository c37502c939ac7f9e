"""Rollups over authors, events and search logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .predicates import keyset_after


def author_rollup(authors: DataFrame, facts: DataFrame, events: DataFrame, knowledge: DataFrame, since: str | None = None, named: str | None = None) -> DataFrame:
    """Live facts, events, live knowledge and authored soft deletes of each author, zero-filled.

    Only of authors last seen at ``since`` or later, and of those called ``named``, where these are given. Rows come in no order:
    ``author_page`` gives them newest first.
    """
    if since is not None:
        authors = authors.filter(F.col("last_seen_at") >= F.lit(since).cast("timestamp"))
    if named is not None:
        authors = authors.filter(F.col("agent_name") == named)

    def per(df: DataFrame, author: str, name: str) -> DataFrame:
        return df.groupBy(F.col(author).alias("id")).agg(F.count(F.lit(1)).alias(name))

    out = authors
    for df, author, name in (
        (facts.filter("deleted_at is null"), "author_id", "fact_count"),
        (events, "author_id", "event_count"),
        (knowledge.filter("deleted_at is null"), "author_id", "knowledge_count"),
        (facts.filter("deleted_at is not null and deleted_by is not null"), "deleted_by", "soft_deletes"),
    ):
        out = out.join(per(df, author, name), "id", "left")
    return out.fillna(0, ["fact_count", "event_count", "knowledge_count", "soft_deletes"])


def author_page(authors: DataFrame, facts: DataFrame, events: DataFrame, knowledge: DataFrame, limit: int = 100, cursor: tuple | None = None, since: str | None = None, named: str | None = None) -> DataFrame:
    """``author_rollup`` of one page, last seen first (ties: largest id first), after ``cursor`` (last_seen_at, id of the page before)."""
    rows = author_rollup(authors, facts, events, knowledge, since, named)
    return keyset_after(rows, "last_seen_at", "id", cursor, limit)


def author_inventory(authors: DataFrame, facts: DataFrame, events: DataFrame, knowledge: DataFrame, contains: str | None = None) -> DataFrame:
    """Rows owned in any state, whether the author may be removed, and whether its name is shared."""
    owned = facts.select("author_id").unionByName(events.select("author_id")).unionByName(knowledge.select("author_id")).groupBy("author_id").agg(F.count(F.lit(1)).alias("owned"))
    named = authors.filter(F.contains(F.lower("agent_name"), F.lit(contains.lower()))) if contains else authors
    shared = authors.groupBy("agent_name").agg((F.count(F.lit(1)) > 1).alias("duplicate_name"))
    out = named.join(owned.withColumnRenamed("author_id", "id"), "id", "left").join(shared, "agent_name")
    owned_rows = F.coalesce("owned", F.lit(0)).cast("bigint")
    return out.select("id", "agent_name", owned_rows.alias("owned"), ((owned_rows == 0) & ~F.col("id").isin("system", "lost-author")).alias("removable"), "duplicate_name")


def pending_dissents(facts: DataFrame, dissents: DataFrame) -> DataFrame:
    n = dissents.filter("status = 'pending'").groupBy("fact_id").agg(F.count(F.lit(1)).alias("n"))
    return facts.select("id").join(n.withColumnRenamed("fact_id", "id"), "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("dissent_count"))


def payload_text(payload: str, *keys: str) -> Column:
    """The first of the JSON object's members of these names that is a string; null where none is, or where there is no object."""
    parsed = F.try_parse_json(payload)
    own = [F.try_variant_get(parsed, f"$['{k}']", "variant") for k in keys]
    return F.coalesce(*[F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")) for v in own])


def labelled(events: DataFrame, payload: str = "payload") -> DataFrame:
    """``events`` with host and sub-category as the payload names them: host, else machine, else (unknown); sub_category, else service, else type, else nothing."""
    host, sub = payload_text(payload, "host", "machine"), payload_text(payload, "sub_category", "service", "type")
    return events.withColumns({"host": F.coalesce(host, F.lit("(unknown)")), "sub": F.coalesce(sub, F.lit(""))})


def _cells(events: DataFrame) -> DataFrame:
    return events.withColumn("day", F.to_date("created_at")).withColumn("host", F.coalesce("host", F.lit("(unknown)")))


def daily_clusters(events: DataFrame, sub: str = "service") -> DataFrame:
    """Events per host, category and UTC day: total, first and last time, three commonest sub-categories.

    Two levels of grouping, so a busy host is combined map-side.
    """
    cell = ["host", "category", "day"]
    subs = _cells(events).groupBy(*cell, F.col(sub).alias("sub")).agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    ranked = subs.withColumn("rn", F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("n"), "sub")))
    entry = F.when(F.col("rn") <= 3, F.struct("rn", "n", "sub"))
    whole = ranked.groupBy(*cell).agg(F.sum("n").alias("total"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sort_array(F.collect_list(entry)).alias("t"))
    return whole.withColumn("top", F.array_join(F.transform("t", lambda x: F.concat(x["n"].cast("string"), F.lit("× "), x["sub"])), ", ")).drop("t")


def cluster_members(events: DataFrame) -> DataFrame:
    """(host, category, day, id): the source events of each cluster as rows, since a busy cell has no bound."""
    return _cells(events).select("host", "category", "day", "id")


def headlines(clusters: DataFrame, least: int = 1) -> DataFrame:
    time = lambda c: F.date_format(c, "HH:mm")
    text = F.concat("host", F.lit("/"), "category", F.lit(" "), time("first_at"), F.lit("–"), time("last_at"), F.lit(" — "), F.col("total").cast("string"), F.lit(" events: "), "top")
    return clusters.filter(F.col("total") >= least).select("host", "category", "day", text.alias("headline"))


def excerpts(knowledge: DataFrame, length: int = 600) -> DataFrame:
    """Longest chunk (last one on ties) of each repository and folder, cut to ``length``."""
    folder = F.regexp_extract("file", "^(.*)/[^/]*$", 1)
    return knowledge.groupBy("repo", folder.alias("folder")).agg(F.max_by("text", F.struct(F.octet_length("text"), "seq")).alias("text")).select("repo", "folder", F.substring("text", 1, length).alias("excerpt"))


def score_histogram(scores: DataFrame, lo: float, hi: float, n: int) -> DataFrame:
    bucket = F.width_bucket("score", F.lit(lo), F.lit(hi), F.lit(n))
    return scores.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))


def latency_profile(df: DataFrame, column: str, keys: list[str], accuracy: int = 100_000) -> DataFrame:
    """p50, p95, p99, extremes and mean; percentiles are values of the column, from a sketch of bounded size (rank error 1 / accuracy)."""
    q = lambda c, p: F.percentile_approx(c, p, accuracy)
    return df.groupBy(*keys).agg(*[F.round(q(column, p), 6).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)], F.min(column).alias("lo"), F.max(column).alias("hi"), F.round(F.avg(column), 6).alias("mean"))


def activity_rates(events: DataFrame, minutes: int, keys: list[str]) -> DataFrame:
    """Rows per minute in tumbling windows."""
    w = F.window("created_at", f"{minutes} minutes")
    return events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, F.round(F.col("n") / minutes, 6).alias("per_minute"))
