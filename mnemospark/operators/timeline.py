"""Unified projection and merged timelines of facts, events and knowledge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unified(facts: DataFrame, events: DataFrame, knowledge: DataFrame) -> DataFrame:
    """One envelope: kind, id, author, times, tags, state and who deleted the row."""
    none = F.array().cast("array<string>")
    f = facts.select(F.lit("fact").alias("kind"), "id", "author_id", "created_at", none.alias("tags"), "deleted_at", "deleted_by")
    e = events.select(F.lit("event").alias("kind"), "id", "author_id", "created_at", none.alias("tags"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(None).cast("string").alias("deleted_by"))
    k = knowledge.select(F.lit("knowledge").alias("kind"), "id", "author_id", "created_at", "tags", "deleted_at", "deleted_by")
    return f.unionByName(e).unionByName(k).withColumn("state", F.when(F.col("deleted_at").isNull(), "live").otherwise("deleted"))


def timeline(envelope: DataFrame, since: str | None = None, until: str | None = None, authors: list[str] | None = None, kinds: list[str] | None = None, state: str = "all", limit: int | None = None) -> DataFrame:
    """Newest first by (created_at, id) in [since, until)."""
    df = envelope
    if since:
        df = df.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until:
        df = df.filter(F.col("created_at") < F.lit(until).cast("timestamp"))
    if authors:
        df = df.filter(F.col("author_id").isin(authors))
    if kinds:
        df = df.filter(F.col("kind").isin(kinds))
    if state != "all":
        df = df.filter(F.col("state") == state)
    df = df.orderBy(F.desc("created_at"), F.desc("id"))
    return df.limit(limit) if limit else df


def deleted(envelope: DataFrame, authors: DataFrame, since: str, by: str | None = None) -> DataFrame:
    """Deleted rows since a time (inclusive) with the deleter's name."""
    df = envelope.filter((F.col("state") == "deleted") & (F.col("deleted_at") >= F.lit(since).cast("timestamp")))
    if by:
        df = df.filter(F.col("deleted_by") == by)
    return df.join(authors.select(F.col("id").alias("deleted_by"), F.col("agent_name").alias("deleter")), "deleted_by", "left").select("kind", "id", "deleted_at", "deleted_by", F.coalesce("deleter", F.lit("unknown")).alias("deleter"))
