"""Model seams: loading, checks, and what a failing scorer leaves alone."""

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import text as tx
from mnemospark.operators import hybrid, models, retrieval


def loader(name):
    """A loader that workers get by value."""
    embedders = {"lengths": lambda texts: [[float(len(t)), 1.0] for t in texts], "short": lambda texts: [[1.0] for _ in texts], "fewer": lambda texts: [[1.0, 2.0]] * (len(texts) - 1), "infinite": lambda texts: [[1.0, float("inf")] for _ in texts]}

    def moody(query, texts):
        if query == "fails":
            raise RuntimeError("no model")
        if query == "fewer":
            return [1.0] * (len(texts) - 1)
        return [float("nan")] * len(texts) if query == "nan" else [-float(t) for t in texts]

    return lambda: moody if name == "moody" else models.hashed_terms(64) if name == "hashed" else embedders[name]


def test_embedder(spark):
    df = spark.createDataFrame([("ab",), (None,), ("  ",), ("abcd",)], "t string")
    got = [r.v for r in df.select(models.embedder(loader("lengths"), 2, prefix="q: ")("t").alias("v")).collect()]
    assert got == [[5.0, 1.0], None, None, [7.0, 1.0]]
    for bad, why in (("short", "of 1 numbers, not 2"), ("fewer", "vectors for"), ("infinite", "not finite")):
        with pytest.raises(Exception, match=why):
            df.select(models.embedder(loader(bad), 2)("t")).collect()


def test_embedded_texts_are_found(spark):
    items = spark.createDataFrame([("a", "red apple"), ("b", "green pear"), ("c", None)], "id string, text string")
    queries = spark.createDataFrame([(1, "a red apple"), (2, "pear")], "query_id long, text string")
    embed = models.embedder(loader("hashed"), 64)
    got = retrieval.knn(queries.withColumn("embedding", embed("text")), items.withColumn("embedding", embed("text")), 1).collect()
    assert {(r.query_id, r.id) for r in got} == {(1, "a"), (2, "b")}


def test_a_failing_scorer_moves_nothing(spark):
    rows = [(q, f"{q}{n}", n, str(n * n % 7)) for q in ("works", "fails", "fewer", "nan") for n in range(1, 7)]
    hits = spark.createDataFrame(rows, "query_id string, id string, rank int, text string").repartition(3)
    got = retrieval.rerank(hits.withColumn("pair", models.pair_scorer(loader("moody"))("query_id", "text")), window=4).collect()
    moved = {(r.query_id, r["rank"]): r.new_rank for r in got}
    assert all(moved[q, n] == n for q in ("fails", "fewer", "nan") for n in range(1, 7))
    first = sorted(range(1, 5), key=lambda n: (n * n % 7, n))
    assert [n for n in sorted(range(1, 7), key=lambda n: moved["works", n])] == [*first, 5, 6]


def test_one_failed_pair_keeps_the_whole_order(spark):
    hits = spark.createDataFrame([("q", "a", 1, 0.1), ("q", "b", 2, None), ("q", "c", 3, 0.9), ("p", "a", 1, 0.1), ("p", "c", 2, 0.9), ("o", "x", 1, None)], "query_id string, id string, rank int, pair double")
    assert {(r.query_id, r.id): r.new_rank for r in retrieval.rerank(hits).collect()} == {("q", "a"): 1, ("q", "b"): 2, ("q", "c"): 3, ("p", "c"): 1, ("p", "a"): 2, ("o", "x"): 1}


def test_search_with_a_failing_scorer(spark):
    k = "id string, text string, content_hash string, machine string, source string, volatility string, age_days int, embedding array<float>, deleted_at timestamp"
    knowledge = spark.createDataFrame([(f"k{n}", str(n), f"h{n}", "m", "Task", None, 1, [1.0, n / 10], None) for n in range(6)], k)
    queries = spark.createDataFrame([("a", "fails", [1.0, 0.0]), ("b", "works", [1.0, 0.0])], "query_id string, query string, embedding array<float>")
    none = spark.createDataFrame([], "id string, payload string, decay_weight double, confidence double, use_count int")
    found = hybrid.search(queries, knowledge, none, none, 6, scorer=models.pair_scorer(loader("moody"))).collect()
    order = {q: [r.id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])] for q in ("a", "b")}
    assert order["a"] == order["b"] == [f"k{n}" for n in range(6)]


def test_small_rules(spark):
    df = spark.createDataFrame([('{"b":1,"a":2}',), ("no json",), (None,)], "p string")
    assert [r.c for r in df.select(tx.canonical_json("p").alias("c")).collect()] == ['{"a":2,"b":1}', None, None]
    df = spark.createDataFrame([("x", ["a"]), (" \n", ["a"]), ("x", None), ("x", [""]), ("x", ["a"] * 33), (None, []), ("x", [None])], "t string, g array<string>")
    assert [r.ok for r in df.select(tx.acceptable(F.col("t"), F.col("g")).alias("ok")).collect()] == [True, False, True, False, False, False, False]
