"""Structured Streaming jobs and their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.validation import violations
from ..sources.files import append
from ..sources.staging import stage, unstage
from .upserts import add_by_key, upsert_by_key

EDGES = "host string, service string, event string, version string, at_us bigint, seq bigint"


def state_edges(rows: DataFrame) -> DataFrame:
    """Edges per (host, service) of observations (host, service, active, version, at, seq), in batch."""
    w = Window.partitionBy("host", "service").orderBy("at", "seq")
    seen = F.last("version", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    was = F.lag("active").over(w)
    event = F.when(F.col("version").isNotNull() & seen.isNotNull() & (F.col("version") != seen), "version_changed").when(F.col("active") & ~F.coalesce(was, F.lit(False)), "up").when(~F.col("active") & F.coalesce(was, F.lit(True)), "down")
    return rows.withColumn("event", event).filter(F.col("event").isNotNull()).select("host", "service", "event", "version", "at", "seq")


class EdgeDetector(StatefulProcessor):
    """Last state and version of each (host, service), and the observations that still wait for the watermark.

    Rows may come in any order within the watermark's delay. They are held until it has passed them; a timer at the earliest
    one then puts those that are complete in order, whatever Arrow batches and micro-batches brought them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "active boolean, version string")
        self.held = handle.getListState("held", "active boolean, version string, at_us bigint, seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(None if pd.isna(r.active) else bool(r.active), None if pd.isna(r.version) else r.version, int(r.at_us), int(r.seq)) for pdf in rows for r in pdf.itertuples()]
        if new:
            self.held.appendList(new)
            self.handle.registerTimer(max(min(r[2] for r in new) // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        yield pd.DataFrame({})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.held.get()) if self.held.exists() else []
        ready, rest = sorted((tuple(r) for r in rows if r[2] <= done), key=lambda r: (r[2], r[3])), [tuple(r) for r in rows if r[2] > done]
        self.held.clear()
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(min(r[2] for r in rest) // 1000 + 1)
        active, version = self.state.get() if self.state.exists() else (None, None)
        out = []
        for is_active, own, at_us, seq in ready:
            if own is not None and version is not None and own != version:
                out.append((*key, "version_changed", own, at_us, seq))
            elif is_active and not active:
                out.append((*key, "up", own, at_us, seq))
            elif is_active is False and active is not False:
                out.append((*key, "down", own, at_us, seq))
            active, version = is_active, own if own is not None else version
        if ready:
            self.state.update((active, version))
        yield pd.DataFrame(out, columns=["host", "service", "event", "version", "at_us", "seq"])

    def close(self) -> None:
        pass


def stream_edges(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The edges of ``state_edges`` for a stream whose rows may be ``late``; later ones are dropped."""
    marked = rows.withWatermark("at", late).withColumn("at_us", F.unix_micros("at")).groupBy("host", "service")
    found = marked.transformWithStateInPandas(EdgeDetector(), EDGES, "Append", "EventTime")
    return found.select("host", "service", "event", "version", F.timestamp_micros("at_us").alias("at"), "seq")


def ingest_events(rows: DataFrame, good: str, bad: str, checkpoint: str, kind: str = "Service"):
    """Validated events to one table, those that break a rule to another with their payload; a micro-batch that runs again replaces what it wrote.

    Each row is judged by itself, also where ids are null or repeated.
    """

    def sink(batch: DataFrame, number: int) -> None:
        marked = stage(batch.withColumn("row", F.monotonically_increasing_id()), "ingest")
        broken = stage(violations(marked.select(F.col("row").alias("id"), F.lit(kind).alias("type"), "payload")).withColumnRenamed("id", "row"), "broken")
        append(marked.join(broken.select("row").distinct(), "row", "left_anti").drop("row"), good, number)
        append(broken.join(marked.select("row", "id", "payload"), "row").select("id", "payload", "field", "rule"), bad, number)
        unstage(marked, broken)

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def daily_counts(rows: DataFrame, late: str = "7 days") -> DataFrame:
    """Events per host, category and day, open to rows up to ``late`` behind."""
    return rows.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day").alias("w"), "host", "category").agg(F.count(F.lit(1)).alias("total")).select(F.to_date("w.start").alias("day"), "host", "category", "total")


def rolling_counts(summaries: DataFrame, rows: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """``summaries`` (day, host, category, total) with the last ``days`` days counted anew, so that late rows are in; older days stay."""
    since = F.date_sub(F.to_date(as_of), days)
    old = summaries.filter(F.col("day") < since)
    new = rows.withColumn("day", F.to_date("created_at")).filter((F.col("day") >= since) & (F.col("created_at") <= as_of))
    return old.unionByName(new.groupBy("day", "host", "category").agg(F.count(F.lit(1)).alias("total")))


def flushes(reads: DataFrame, seconds: int) -> DataFrame:
    """(id, flush): the end of the interval in which an id was read."""
    return reads.select("id", F.window("at", f"{seconds} seconds")["end"].alias("flush"))


def stream_daily_counts(rows: DataFrame, path: str, checkpoint: str, late: str = "7 days"):
    """Keeps a table of ``daily_counts`` below ``path``, one partition a day: each micro-batch rewrites the days whose counts it changed.

    Counts made again are valid again (``invalidated`` is false), as ``lifecycle.merge_summaries`` has it.
    """

    def sink(batch: DataFrame, number: int) -> None:
        upsert_by_key(batch.withColumn("invalidated", F.lit(False)), path, ["host", "category"], "day", number)

    return daily_counts(rows, late).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def stream_usage(reads: DataFrame, path: str, checkpoint: str, seconds: int = 60, late: str = "10 minutes"):
    """Keeps a table (id, uses, last) below ``path``: one use for each flush in which an id was read (id, at), counted once the flush is complete."""
    flushed = reads.withWatermark("at", late).groupBy(F.window("at", f"{seconds} seconds").alias("w"), "id").agg(F.count(F.lit(1)).alias("reads")).select("id", F.col("w.end").alias("flush"))

    def sink(batch: DataFrame, number: int) -> None:
        add_by_key(batch.groupBy("id").agg(F.count(F.lit(1)).alias("uses"), F.max("flush").alias("last")), path, "id", "uses", "last", number)

    return flushed.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def counted_uses(facts: DataFrame, uses: DataFrame) -> DataFrame:
    """``lifecycle.bump_usage`` from the table that ``stream_usage`` keeps."""
    u = uses.select("id", "uses", "last")
    return facts.join(u, "id", "left").select("id", (F.col("use_count") + F.coalesce("uses", F.lit(0))).cast("bigint").alias("use_count"), F.coalesce("last", "last_used_at").alias("last_used_at"))
