"""Sketches of days against exact rows."""

import datetime
import random

from pyspark.sql import functions as F

from mnemospark.operators import sketches


def test_days_merge_to_the_whole(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), datetime.datetime(2024, 1, 1 + rng.randrange(9)), None if rng.random() < 0.02 else rng.lognormvariate(0, 1), f"k{rng.randrange(3000)}" if rng.random() < 0.98 else None) for _ in range(20000)]
    df = spark.createDataFrame(rows, "g string, at timestamp, v double, k string")
    days = sketches.daily(df, "at", "v", "k", ["g"])
    got = {r.g: r for r in sketches.profile(sketches.merged(days, ["g"]), ["g"]).collect()}
    once = df.withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    whole = {r.g: r for r in sketches.profile(sketches.daily(once, "at", "v", "k", ["g"]), ["g"]).collect()}
    for g in "ab":
        own = sorted(v for x, _, v, _ in rows if x == g and v is not None)
        assert got[g].n == sum(x == g for x, *_ in rows) and (got[g].lo, got[g].hi) == (own[0], own[-1])
        assert abs(got[g].mean - sum(own) / len(own)) < 1e-9
        for q in (0.5, 0.95, 0.99):
            rank = sum(v <= got[g][f"p{round(100 * q)}"] for v in own) / len(own)
            assert abs(rank - q) <= 0.02
        exact = len({k for x, _, _, k in rows if x == g and k is not None})
        assert abs(got[g].uniques - exact) <= 0.06 * exact
        # HyperLogLog's union is the sketch of all rows, whatever the days
        assert got[g].uniques == whole[g].uniques
    some = {r.g: r.n for r in sketches.merged(days.filter("day >= date'2024-01-05'"), ["g"]).collect()}
    assert some == {g: sum(x == g and at >= datetime.datetime(2024, 1, 5) for x, at, _, _ in rows) for g in "ab"}


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", datetime.datetime(2024, 1, 1), None, None)], "g string, at timestamp, v double, k string")
    (row,) = sketches.profile(sketches.daily(df, "at", "v", "k", ["g"]), ["g"]).collect()
    assert (row.n, row.p50, row.mean, row.uniques) == (1, None, None, 0)
    assert sketches.merged(sketches.daily(df.limit(0), "at", "v", "k", ["g"]), ["g"]).collect() == []
