"""Rank, merge and collapse operators on long-form candidate lists keyed by query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def top_k(df: DataFrame, k: int, by: list, keys: list[str]) -> DataFrame:
    """The first k rows of each key; ``rn`` counts from 1."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col("rn") <= k)


def collapse(df: DataFrame, keys: list[str], hash_col: str, order: list[str]) -> DataFrame:
    """The row of each content hash that is first by the ``order`` columns, with ``copies``, the number of the others; null hashes never collapse.

    Groups are combined before the shuffle, so a hash with very many rows costs no more than others.
    """
    hashed = df.filter(F.col(hash_col).isNotNull())
    one = hashed.groupBy(*keys, hash_col).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r"), (F.count(F.lit(1)) - 1).alias("copies"))
    alone = df.filter(F.col(hash_col).isNull()).withColumn("copies", F.lit(0).cast("bigint"))
    return one.select("r.*", "copies").unionByName(alone)


def copies_of(df: DataFrame, keys: list[str], hash_col: str, order: list[str], key: str = "id") -> DataFrame:
    """Every collapsed row with ``of``, the key of the row that stands for it; as many rows as there are copies."""
    best = collapse(df, keys, hash_col, order).filter("copies > 0").select(*keys, hash_col, F.col(key).alias("of"))
    return df.join(best, [*keys, hash_col]).filter(F.col(key) != F.col("of"))


def renumber(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``source_rank``: 0-based and without gaps per key."""
    return df.withColumn("source_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def append_list(page: DataFrame, extra: DataFrame, query: str = "query_id", key: str = "id", rank: str = "rank") -> DataFrame:
    """``extra`` after ``page``, without what the page already holds; both keep their order."""
    last = page.groupBy(query).agg(F.max(rank).alias("__last"))
    fresh = extra.join(page.select(query, key), [query, key], "left_anti").join(last, query, "left")
    shift = F.coalesce(F.col("__last"), F.lit(0))
    number = F.row_number().over(Window.partitionBy(query).orderBy(rank, key))
    return page.select(query, key, rank).unionByName(fresh.select(query, key, (shift + number).cast(page.schema[rank].dataType).alias(rank)))


def rrf(lists: DataFrame, k: int = RRF_K, query: str = "query_id", key: str = "id") -> DataFrame:
    """Sum of weight / (k + rank) over the lists an id appears in, ranks from 1."""
    return lists.groupBy(query, key).agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("fused"))


def normalise(lists: DataFrame, how: str = "minmax", keys: tuple[str, ...] = ("query_id", "list"), score: str = "score") -> DataFrame:
    """``norm``: min-max (1 when the span is 0), z-score (0 when the deviation is 0) or max-clamped."""
    w = Window.partitionBy(*keys)
    s, lo, hi = F.col(score), F.min(score).over(w), F.max(score).over(w)
    mean, sd = F.avg(score).over(w), F.stddev_pop(score).over(w)
    norm = {
        "minmax": F.when(hi - lo < 1e-9, 1.0).otherwise((s - lo) / F.nullif(hi - lo, F.lit(0.0))),
        "zscore": F.when(sd < 1e-9, 0.0).otherwise((s - mean) / F.nullif(sd, F.lit(0.0))),
        "max": F.when(hi <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s / F.nullif(hi, F.lit(0.0))))),
    }[how]
    return lists.withColumn("norm", norm)


def weighted_fusion(lists: DataFrame, source_weights: dict[str, float], how: str = "minmax") -> DataFrame:
    """Sum of source weight x normalised score x row weight; unknown sources weigh 0."""
    w = F.lit(0.0)
    for name, value in source_weights.items():
        w = F.when(F.col("list") == name, F.lit(value)).otherwise(w)
    return normalise(lists, how).groupBy("query_id", "id").agg(F.sum(F.col("norm") * w * F.col("weight")).alias("fused"))


def latest_per_key(df: DataFrame, key: str, ts: str) -> DataFrame:
    """The row seen last of each natural key; ties by the greatest row."""
    rest = [c for c in df.columns if c not in (key, ts)]
    return df.groupBy(key).agg(F.max(F.struct(ts, *rest)).alias("r")).select(key, "r.*")
