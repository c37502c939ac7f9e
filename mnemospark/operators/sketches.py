"""Profiles that merge: daily sketches of values and of distinct contents, kept as rows and merged over any range of days.

A day's row has exact counts, smallest, largest and sum, a KLL sketch of the values (quantiles by rank) and a HyperLogLog sketch of the keys. Days
are summarised once; a profile of a week or of a year reads one row a group and day, never the events again. At the default sizes a
quantile's rank is off by about 1.3 % (99 % of the time), a distinct count by about 1.6 % (one standard deviation).

Defined results: null values are in ``n`` only, null keys are no keys; a range without rows gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sketch sizes: KLL's k, and the binary logarithm of HyperLogLog's registers.
KLL_K, HLL_BITS = 200, 12
QUANTILES = (0.5, 0.95, 0.99)


def daily(rows: DataFrame, ts: str, value: str, key: str, by: list[str]) -> DataFrame:
    """(by, day, n, values_n, lo, hi, total, values, keys): one row a group and day."""
    v = F.col(value).cast("double")
    return rows.groupBy(*by, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("values_n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.sum(v).alias("total"), F.kll_sketch_agg_double(v, F.lit(KLL_K)).alias("values"), F.hll_sketch_agg(F.col(key), F.lit(HLL_BITS)).alias("keys"))


def merged(days: DataFrame, by: list[str]) -> DataFrame:
    """The same columns without ``day``: all given days as one."""
    return days.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "values_n")], F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"), F.kll_merge_agg_double("values", F.lit(KLL_K)).alias("values"), F.hll_union_agg("keys").alias("keys"))


def profile(sketched: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, p50, p95, p99, lo, hi, mean, uniques) of ``daily`` or ``merged`` rows."""
    at = [F.when(F.col("values_n") > 0, F.kll_sketch_get_quantile_double("values", F.lit(q))).alias(f"p{round(100 * q)}") for q in QUANTILES]
    return sketched.select(*by, "n", *at, "lo", "hi", (F.col("total") / F.nullif("values_n", F.lit(0))).alias("mean"), F.hll_sketch_estimate("keys").alias("uniques"))
