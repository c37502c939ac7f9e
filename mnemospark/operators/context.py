"""Token-budgeted context bundles per query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOOR = 0.10
SECTIONS = ("fact", "knowledge", "event")


def across_sections(items: DataFrame) -> DataFrame:
    """Knowledge that shares (repo, file) with a kept fact goes, then events that share with kept knowledge."""
    keys = ["query_id", "repo", "file"]
    fact, known, event = (items.filter(F.col("section") == s) for s in SECTIONS)
    known = known.join(fact.select(*keys), keys, "left_anti").select(*items.columns)
    event = event.join(known.select(*keys), keys, "left_anti").select(*items.columns)
    return fact.unionByName(known).unionByName(event)


def with_summaries(items: DataFrame, summaries: DataFrame, budget: int) -> DataFrame:
    """Queries whose events cost more than half the budget get their days' summaries (host, category, day, id, cost) in their place.

    A summary takes the best score of the events that it stands for; events without a summary stay. ``kind`` tells
    the two apart: raw or summary.
    """
    events = items.filter("section = 'event'")
    heavy = events.groupBy("query_id").agg(F.sum("cost").alias("c")).filter(F.col("c") > budget / 2).select("query_id")
    cell = ["host", "category", "day"]
    known = summaries.select(*cell, F.col("id").alias("summary_id"), F.col("cost").alias("summary_cost"))
    swapped = events.join(heavy, "query_id").join(known, cell)
    gone = swapped.select("query_id", "id")
    rest = items.join(gone, ["query_id", "id"], "left_anti").select(*items.columns)
    made = swapped.groupBy("query_id", *cell, "summary_id", "summary_cost").agg(F.max("score").alias("score"))
    none = F.lit(None).cast("string")
    new = made.select("query_id", F.lit("event").alias("section"), F.col("summary_id").alias("id"), "score", none.alias("repo"), none.alias("file"), *cell, F.col("summary_cost").alias("cost"))
    return rest.withColumn("kind", F.lit("raw")).unionByName(new.withColumn("kind", F.lit("summary")))


def section_stats(items: DataFrame, kept: DataFrame) -> DataFrame:
    """(query_id, section, candidates, count, tokens_spent, source, status) of all three sections of each query that has an item.

    ``items`` as ``with_summaries`` gives them, ``kept`` those of them that the budget left. ``source`` is summary where
    summaries stand for events; ``status`` is empty for a section that no search found anything for, cut where nothing of it fits,
    else ok.
    """
    keys = ["query_id", "section"]
    had = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidates"), F.bool_or(F.col("kind") == "summary").alias("by_day"))
    left = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.sum("cost").alias("tokens_spent"))
    every = items.select("query_id").distinct().withColumn("section", F.explode(F.array(*map(F.lit, SECTIONS))))
    both = every.join(had, keys, "left").join(left, keys, "left").fillna(0, ["candidates", "count", "tokens_spent"])
    status = F.when(F.col("candidates") == 0, "empty").when(F.col("count") == 0, "cut").otherwise("ok")
    return both.select(*keys, "candidates", "count", F.col("tokens_spent").cast("bigint").alias("tokens_spent"), F.when(F.col("by_day"), "summary").otherwise("raw").alias("source"), status.alias("status"))


def allocate(items: DataFrame, budget: int) -> DataFrame:
    """(query_id, id, truncated) of the items kept: a floor per section first, then best score that fits.

    ``items``: query_id, section, id, score, cost, at most a few hundred rows per query (the lists are
    cut to top-k before), folded in score order inside the query's row. If nothing fits, the best item
    is kept alone. A budget of 0 keeps nothing.
    """
    order = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    entry = F.struct(order.alias("o"), (-F.col("score")).alias("s"), F.col("id").alias("id"), F.col("cost").cast("bigint").alias("cost"))
    rows = items.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("all"))
    floor = int(FLOOR * budget)
    start = F.struct(F.lit(0).cast("bigint").alias("spent"), F.array(*[F.lit(0).cast("bigint")] * 3).alias("own"), F.array().cast("array<string>").alias("kept"))

    def reserve(a, x):
        mine = F.element_at(a["own"], x["o"].cast("int"))
        fits = (mine < floor) & (a["spent"] + x["cost"] <= budget)
        own = F.transform(a["own"], lambda v, i: F.when(i + 1 == x["o"], v + x["cost"]).otherwise(v))
        return F.when(fits, F.struct((a["spent"] + x["cost"]).alias("spent"), own.alias("own"), F.concat(a["kept"], F.array(x["id"])).alias("kept"))).otherwise(a)

    def fill(a, x):
        fits = ~F.array_contains(a["kept"], x["id"]) & (a["spent"] + x["cost"] <= budget)
        return F.when(fits, F.struct((a["spent"] + x["cost"]).alias("spent"), a["own"].alias("own"), F.concat(a["kept"], F.array(x["id"])).alias("kept"))).otherwise(a)

    first = rows.withColumn("acc", F.aggregate("all", start, reserve))
    pool = F.array_sort(F.transform("all", lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["id"].alias("id"), x["cost"].alias("cost"))))
    filled = first.withColumn("kept", F.aggregate(pool, F.col("acc"), fill)["kept"]).withColumn("best", F.get(pool, F.lit(0))["id"])
    kept = F.when((F.size("kept") == 0) & F.lit(budget > 0), F.array("best")).otherwise(F.col("kept"))
    return filled.withColumn("out", kept).select("query_id", F.explode("out").alias("id"), (F.size("out") < F.size("all")).alias("truncated"))
