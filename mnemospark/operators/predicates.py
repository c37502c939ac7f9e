"""Predicates and validation columns used by scans and retrieval."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live(state: str = "live", column: str = "deleted_at") -> Column:
    """Rows that are live, deleted, or all."""
    return {"live": F.col(column).isNull(), "deleted": F.col(column).isNotNull(), "all": F.lit(True)}[state]


def within(ts: str, since=None, until=None, closed: bool = True) -> Column:
    """since <= ts <= until with open ends; ``closed=False`` makes both bounds strict."""
    c = F.lit(True)
    if since is not None:
        c &= (F.col(ts) >= F.lit(since).cast("timestamp")) if closed else (F.col(ts) > F.lit(since).cast("timestamp"))
    if until is not None:
        c &= (F.col(ts) <= F.lit(until).cast("timestamp")) if closed else (F.col(ts) < F.lit(until).cast("timestamp"))
    return c


def all_tags(wanted: list[str], column: str = "tags") -> Column:
    """Every wanted tag is present."""
    return F.size(F.array_except(F.array(*map(F.lit, wanted)).cast("array<string>"), F.col(column))) == 0


def contains_json(column: str, match: dict | list | str) -> Column:
    """``column @> match``: objects as subsets, arrays as sets of what they contain; values are equal in type and value."""

    def member(value):
        return lambda v: holds(v, value)

    def holds(v: Column, value) -> Column:
        kind = F.schema_of_variant(v)
        if isinstance(value, dict):
            own = kind.startswith("OBJECT")
            for k, x in value.items():
                own &= holds(F.try_variant_get(v, f"$['{k}']", "variant"), x)
        elif isinstance(value, list):
            items = F.try_variant_get(v, "$", "array<variant>")
            own = kind.startswith("ARRAY")
            for x in value:
                own &= F.exists(items, member(x))
        elif value is None:
            own = kind == "VOID"
        elif isinstance(value, bool):
            own = (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == value)
        elif isinstance(value, str):
            own = (kind == "STRING") & (F.try_variant_get(v, "$", "string") == value)
        else:
            own = kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)") & (F.try_variant_get(v, "$", "double") == float(value))
        return F.coalesce(own, F.lit(False))

    return holds(F.try_parse_json(column), json.loads(match) if isinstance(match, str) else match)


def payload_equals(key: str, value: str, column: str = "payload") -> Column:
    return F.get_json_object(column, f"$.{key}") == value


def retrieval_filter(kind: str, type_: str | None = None, source: str | None = None, since=None, until=None, tags: list[str] | None = None, **keys: str) -> Column:
    """Filters of a search on one kind of rows (fact, event or knowledge); a ``type_`` leaves facts alone.

    ``keys`` (host, repo, file) and tags are columns of knowledge and members of the payload of facts and events.
    """
    if type_ is not None and kind != "fact":
        return F.lit(False)
    c = within("created_at", since, until)
    if type_ is not None:
        c &= F.col("type") == type_
    if source is not None and kind != "event":
        c &= F.col("source") == source
    for key, value in keys.items():
        c &= F.coalesce((F.col("machine" if key == "host" else key) == value) if kind == "knowledge" else payload_equals(key, value), F.lit(False))
    if tags:
        own = F.col("tags") if kind == "knowledge" else F.from_json(F.get_json_object("payload", "$.tags"), "array<string>")
        c &= F.coalesce(F.size(F.array_except(F.array(*map(F.lit, tags)), own)) == 0, F.lit(False))
    return c


def window_status(since: str, until: str, max_days: int = 30) -> Column:
    """ok, inverted or too_wide for each request row."""
    return F.when(F.col(until) < F.col(since), "inverted").when(F.unix_timestamp(until) - F.unix_timestamp(since) > max_days * 86400, "too_wide").otherwise("ok")


def query_status(text: str, top_k: str, max_bytes: int = 1024, max_k: int = 50) -> Column:
    """ok, empty, too_long or bad_top_k for each query row; a text of white space of any kind is empty, as is null."""
    blank = ~F.col(text).rlike(r"[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
    return F.when(F.coalesce(blank, F.lit(True)), "empty").when(F.octet_length(text) > max_bytes, "too_long").when(~F.col(top_k).between(1, max_k), "bad_top_k").otherwise("ok")


def may_curate(caller: str, owner: str, manages: str) -> Column:
    """The caller owns the row or manages; rows without owner need a manager."""
    return F.col(manages) | F.coalesce(F.col(caller) == F.col(owner), F.lit(False))


def next_cursor(page: DataFrame, ts: str, key: str, limit: int, newest_first: bool = True) -> DataFrame:
    """(ts, key) of the last row of a full page, for the next one; no row where the page is the last."""
    end = (F.min if newest_first else F.max)(F.struct(F.col(ts).alias("t"), F.col(key).alias("k")))
    return page.agg(end.alias("c"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limit).select(F.col("c.t").alias(ts), F.col("c.k").alias(key))


def keyset_after(df: DataFrame, ts: str, key: str, after: tuple | None, limit: int, newest_first: bool = True) -> DataFrame:
    """The next page strictly after (ts, key), or the first page."""
    if after is None:
        return df.orderBy(F.desc(ts), F.desc(key)).limit(limit) if newest_first else df.orderBy(ts, key).limit(limit)
    here, mark = F.struct(F.col(ts).alias("t"), F.col(key).alias("k")), F.struct(F.lit(after[0]).cast("timestamp").alias("t"), F.lit(after[1]).alias("k"))
    if newest_first:
        return df.filter(here < mark).orderBy(F.desc(ts), F.desc(key)).limit(limit)
    return df.filter(here > mark).orderBy(ts, key).limit(limit)
