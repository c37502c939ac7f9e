"""Vectors, postings and filters against plain loops."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemospark.functions import text as tx
from mnemospark.operators import hybrid, postings, retrieval, vectors
from mnemospark.operators.postings import Postings
from mnemospark.plans import search
from mnemospark.sources import staging

SF = "/root/testdata/sf0.001"


def loop_knn(queries, items, k, want=lambda key: True):
    out = set()
    for q, a in queries:
        if not a:
            continue
        best = []
        for key, b in items:
            if b and len(a) == len(b) and want(key):
                n = max(np.linalg.norm(a), 1e-12) * max(np.linalg.norm(b), 1e-12)
                best.append((-round(float(np.dot(a, b) / n), 6), key))
        out |= {(q, key, rank + 1) for rank, (_, key) in enumerate(sorted(best)[:k])}
    return out


@pytest.fixture(scope="module")
def mixed():
    """Vectors of three lengths, nulls, empty and zero ones, and one vector that a third of the items share."""
    rng = random.Random(4)
    vec = lambda n: [rng.randrange(-9, 10) / 4 for _ in range(n)]
    items = [(f"i{n:03}", [1.0, 2.0, 3.0, 4.0] if n % 3 == 0 else vec(rng.choice((4, 4, 4, 3, 7)))) for n in range(300)] + [("none", None), ("empty", []), ("zero", [0.0] * 4)]
    queries = [(n, vec(rng.choice((4, 3, 7, 5)))) for n in range(40)] + [(100, [1.0, 2.0, 3.0, 4.0]), (101, None), (102, []), (103, [0.0] * 4)]
    return queries, items


def frames(spark, mixed):
    return spark.createDataFrame(mixed[0], "query_id long, embedding array<double>"), spark.createDataFrame(mixed[1], "id string, embedding array<double>")


@pytest.mark.parametrize("tiny", [False, True])
def test_block_product_matches_a_loop(spark, mixed, monkeypatch, tiny):
    if tiny:  # many blocks of queries and items
        for name, most in (("QUERY_BYTES", 400), ("ITEM_BYTES", 900), ("STEP_QUERIES", 3), ("STEP_ITEMS", 5)):
            monkeypatch.setattr(vectors, name, most)
    q, i = frames(spark, mixed)
    got = retrieval.knn_strata(q, i, 5, {"all": None, "odd": F.substring("id", 4, 1).isin("1", "3")}).collect()
    assert {(r.query_id, r.id, r["rank"]) for r in got if r.stratum == "all"} == loop_knn(*mixed, 5)
    assert {(r.query_id, r.id, r["rank"]) for r in got if r.stratum == "odd"} == loop_knn(*mixed, 5, lambda key: key[3:4] in ("1", "3"))


def test_query_blocks_count_as_tasks(spark, monkeypatch):
    """Items are cut no finer than the tasks that the blocks of queries leave to be made, so no side is moved more often than it must be."""
    monkeypatch.setattr(vectors, "QUERY_BYTES", 16_000)
    monkeypatch.setattr(vectors, "PAIRS_TASK", 4_000_000, raising=False)
    v = lambda n: F.array(*[F.hash(F.lit(d), "id") % 97 / 97 for d in range(n)])
    q = staging.stage(spark.range(2000).select(F.col("id").alias("q"), F.lit(2).alias("grp"), v(2).alias("v")), "q")
    i = staging.stage(spark.range(4000).select(F.col("id").cast("string").alias("key"), F.lit(2).alias("grp"), v(2).alias("v"), F.lit(1).alias("marks")), "i")
    assert vectors.block_product(q, i, 3).count() == 2000 * 3


def test_best_of_many_equal_items():
    """Equal vectors tie by rank, across steps and against a full sort."""
    rng = np.random.default_rng(5)
    unit = lambda n: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(rng.normal(size=(n, 8)))
    mine, theirs, rank = unit(300), unit(20_000), rng.permutation(20_000)
    theirs[::3] = mine[7]
    row, item, score = vectors._best(mine, theirs, rank, None, 5)
    for q in (0, 7, 299):
        sims = np.round(theirs @ mine[q], 6)
        want = np.lexsort((rank, -sims))[:5]
        assert item[row == q].tolist() == want.tolist() and score[row == q].tolist() == sims[want].tolist()
    row, item, _ = vectors._best(mine, theirs, rank, rank[:300], 5)
    assert len(row) == 1500 and not (rank[item] == rank[row]).any()


def test_knn_of_nothing_keeps_the_query_type(spark, mixed):
    _, i = frames(spark, mixed)
    for kind in ("long", "string"):
        none = spark.createDataFrame([], f"query_id {kind}, embedding array<double>")
        found = retrieval.knn(none, i, 5)
        assert found.schema["query_id"].dataType == none.schema["query_id"].dataType and found.collect() == []
    asked = spark.createDataFrame([("q", None)], "query_id string, embedding array<double>")
    assert retrieval.knn(asked, i, 5).collect() == []
    assert retrieval.knn(frames(spark, mixed)[0], i.limit(0), 5).collect() == []


def test_knn_plan_does_not_grow(spark, mixed, monkeypatch):
    plans = []
    for most in (400, 1 << 24):
        monkeypatch.setattr(vectors, "QUERY_BYTES", most)
        plan = retrieval.knn(*frames(spark, mixed), 5)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
        plans.append(plan.count("Exchange"))
    assert plans[0] == plans[1]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_inverted_file_recall(spark, sf):
    """Every item is indexed; at least nine in ten of the exact neighbours are found."""
    sf = f"/root/testdata/{sf}"
    index = retrieval.InvertedFile(search.live_vectors(spark, sf))
    assert index.items.count() == search.live_vectors(spark, sf).count()
    assert index.probes < len(index.centroids)
    exact = {(r.query_id, r.id) for r in search.dense_knn(spark, sf).collect()}
    near = {(r.query_id, r.id) for r in index.search(search.vector_queries(spark, sf), 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_inverted_file_in_clusters_and_odd_vectors(spark, mixed):
    """Vectors in clusters need few cells; other lengths, nulls and an empty table are met as in exact search."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8))
    items = [(f"v{n}", (centres[n % 20] + 0.05 * rng.normal(size=8)).tolist()) for n in range(900)] + [(f"w{n}", [1.0 * n, 1.0]) for n in range(30)] + [("none", None)]
    queries = [(n, (centres[n % 20] + 0.05 * rng.normal(size=8)).tolist()) for n in range(40)] + [(99, [3.0, 1.0])]
    q, i = spark.createDataFrame(queries, "query_id long, embedding array<double>"), spark.createDataFrame(items, "id string, embedding array<double>")
    index = retrieval.InvertedFile(i)
    got = {(r.query_id, r.id, r["rank"]) for r in index.search(q, 5).collect()}
    want = loop_knn(queries, items, 5)
    assert index.probes <= len(index.centroids) // 4
    assert len(got & want) >= 0.9 * len(want)
    assert {g for g in got if g[0] == 99} == {w for w in want if w[0] == 99}
    assert retrieval.InvertedFile(i.limit(0)).search(q, 5).collect() == []


WORDS = ("red", "green", "blue", "tiny", "rare", "the", "running")


def loop_hits(queries, rows, analyse):
    return {(q, key) for q, t in queries for key, text in rows if analyse(t) and set(analyse(t)) <= set(analyse(text or ""))}


def test_postings_hold_every_term(spark):
    rng = random.Random(8)
    rows = [(f"r{n}", " ".join(rng.choices(WORDS, weights=(9, 9, 5, 2, 1, 9, 3), k=rng.randrange(0, 12)))) for n in range(200)] + [("null", None), ("empty", ""), (None, "red green")]
    queries = [(n, " ".join(rng.sample(WORDS, rng.randrange(1, 5)))) for n in range(40)] + [(90, "absent red"), (91, ""), (92, None), (93, "red red RED")]
    q, i = spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(rows, "id string, text string")
    words = lambda t: (t or "").lower().split()
    got = [(r.query_id, r.id) for r in retrieval.lexical(q, i).collect()]
    assert Counter(got) == Counter(loop_hits(queries, [r for r in rows if r[0]], words))
    index = Postings.of(i, tx.terms(F.col("text")))
    want = {(w, key, tuple(n for n, x in enumerate(words(text)) if x == w)) for key, text in rows if key for w in words(text)}
    assert {(r.term, r.id, tuple(r.positions)) for r in index.read().collect()} == want


def test_postings_grow_by_parts(spark):
    """A part replaces the ids it holds, a part written again replaces itself, and older views stay as they were."""
    make = lambda rows: spark.createDataFrame(rows, "id string, text string")
    first = Postings.of(make([("a", "red green"), ("b", "red"), ("c", "blue")]), tx.terms(F.col("text")))
    second = first.add(make([("a", "blue blue"), ("d", "red"), ("c", "")]), tx.terms(F.col("text")))
    again = first.add(make([("a", "blue blue"), ("d", "red"), ("c", "")]), tx.terms(F.col("text")))
    third = second.add(make([("a", "red")]), tx.terms(F.col("text")))
    held = lambda index: {(r.term, r.id) for r in index.read().collect()}
    assert held(second) == held(again) == {("blue", "a"), ("red", "b"), ("red", "d")}
    assert held(third) == {("red", "a"), ("red", "b"), ("red", "d")}
    assert held(first) == {("red", "a"), ("green", "a"), ("red", "b"), ("blue", "c")}
    q = spark.createDataFrame([(1, "red")], "query_id long, query string")
    assert {r.id for r in retrieval.lexical(q, third).collect()} == {"a", "b", "d"}


def test_text_search_of_common_words_stays_linear(spark, monkeypatch):
    """Texts of common words meet most others by their rarest term; what is staged stays in proportion to the texts, and hits are those of a loop."""
    rng = random.Random(8)
    vocabulary = [f"w{n}" for n in range(40)]
    rows = [(f"d{n:03}", " ".join(rng.choices(vocabulary, k=rng.choice((2, 9, 14, 30))))) for n in range(400)] + [(f"e{n}", f"w1 w{n} w2 w1") for n in range(3, 9)]
    rows += [(f"c{n:02}", rows[n][1]) for n in range(0, 40, 2)]
    queries = [(n, text) for n, (_, text) in enumerate(rows) if n % 4 == 0]
    wide = " ".join(vocabulary[:12])
    rows += [("wide", wide), ("twice", wide + " " + wide)]
    queries.append((999, wide))
    staged = Counter()
    for module in (postings, retrieval):
        monkeypatch.setattr(module, "stage", lambda df, name, *a, f=staging.stage: (out := f(df, name, *a), staged.update({name: out.count()}))[0])
    q, i = spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(rows, "id string, text string")
    want = loop_hits(queries, rows, lambda t: t.lower().split())
    assert Counter((r.query_id, r.id) for r in retrieval.lexical(q, i).collect()) == Counter(want)
    assert staged["met"] <= len(set(want)) + len(rows)
    best = {(r.query_id, r.id, r.score) for r in retrieval.full_text(q, i, "text", 1000).collect()}
    texts = dict(rows)
    ask = dict(queries)

    def density(query, text):
        words, terms = text.split(), sorted(set(query.split()))
        return round(postings.spans([np.array([n for n, w in enumerate(words) if w == t]) for t in terms]), 6)

    assert best == {(n, key, density(ask[n], texts[key])) for n, key in want}
    index = retrieval.lexical_index(i)
    staged.clear()
    assert Counter((r.query_id, r.id) for r in retrieval.lexical(q, index).collect()) == Counter(want)
    assert staged["alive"]


def test_postings_are_turned_in_slices(monkeypatch):
    """Batches of any size are turned a bounded number of terms at a time, and a longer text alone."""
    monkeypatch.setattr(postings, "TURNED", 5)
    rows = [("a", ["x", "y"]), ("b", list("xyzxyzxyz")), ("c", ["x"]), ("d", ["y", "x", "y"]), ("e", ["z"])]
    batch = pa.RecordBatch.from_pylist([{"id": k, "own": w} for k, w in rows])
    parts = list(postings._turned(iter([batch, batch.slice(1, 3)])))
    assert max(len(set(p["id"].to_pylist())) for p in parts) < 5 and len(parts) > 4
    got = Counter((r["term"], r["id"], tuple(r["positions"])) for p in parts for r in p.to_pylist())
    one = lambda some: Counter((w, k, tuple(n for n, x in enumerate(words) if x == w)) for k, words in some for w in set(words))
    assert got == one(rows) + one(rows[1:4])


def test_full_text_ranks_by_density_and_boost(spark):
    rows = [("a", "red blue", 1.0), ("b", "red x x blue", 1.0), ("c", "red x x blue", 9.0), ("d", "red", 99.0), ("e", "blues reds", 1.0)]
    i = spark.createDataFrame(rows, "id string, text string, boost double")
    q = spark.createDataFrame([(1, "the red blue"), (2, "the"), (3, "red")], "query_id long, query string")
    got = {(r.query_id, r.id, r.score, r["rank"]) for r in retrieval.full_text(q, i, "text", 3, F.col("boost")).collect() if r.query_id < 3}
    assert got == {(1, "c", 4.5, 1), (1, "a", 1.0, 2), (1, "b", 0.5, 3)}
    index = retrieval.full_text_index(i, "text")
    some = retrieval.full_text(q, i.filter("id <> 'c'"), "text", 3, index=index).collect()
    assert {(r.id, r["rank"]) for r in some if r.query_id == 1} == {("a", 1), ("b", 2)}


def test_hybrid_search_without_vectors_and_with_mixed_ones(spark):
    """No query with a vector, no item with one, and items of other lengths: text still finds."""
    k = "id string, text string, content_hash string, machine string, source string, volatility string, age_days int, embedding array<float>, deleted_at timestamp"
    knowledge = [("k1", "red apple", "h1", None, "AgentProposal", None, 1, [1.0, 0.0], None), ("k2", "red pear", "h2", "m", "Task", None, 1, [1.0], None), ("k3", "red plum", "h3", "m", "Task", None, 1, None, None)]
    facts = spark.createDataFrame([("f1", '{"x":"red"}', 1.0, 1.0, 0)], "id string, payload string, decay_weight double, confidence double, use_count int")
    events = spark.createDataFrame([], "id string, payload string")
    for vector, dense in ((None, set()), ([1.0, 0.5], {"k1"}), ([2.0], {"k2"}), ([1.0, 2.0, 3.0], set())):
        q = spark.createDataFrame([("q", "red", vector)], "query_id string, query string, embedding array<float>")
        rows = spark.createDataFrame(knowledge, k)
        lists, _ = hybrid.candidate_lists(q, rows, facts, events, 10)
        assert {r.id for r in lists.filter("list = 'vector'").collect()} == dense
        assert {r.id for r in hybrid.search(q, rows, facts, events, 10).collect()} == {"k1", "k2", "k3", "f1"}


def test_rerank_searches_no_text(spark, monkeypatch):
    """Only the vector list is re-ranked, so the other lists are not made."""

    def not_asked(*args, **kwargs):
        raise AssertionError("a text search")

    for name in ("full_text", "lexical_by_cosine"):
        monkeypatch.setattr(retrieval, name, not_asked)
    rows = search.rerank(spark, SF).collect()
    assert rows and len({(r.query_id, r.new_rank) for r in rows}) == len(rows)


def moved(spark) -> int:
    """Bytes that the session has shuffled so far."""
    each = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))


def test_lexical_by_cosine_moves_no_vectors_with_hits(spark, monkeypatch):
    """Many queries of the same terms hit all rows: their pairs are quadratic, what is moved must not be."""
    monkeypatch.setattr(retrieval, "broadcast_if_small", lambda df, *_: df)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rng = random.Random(8)
    vec = lambda n=8: [float(rng.randrange(-9, 10)) for _ in range(n)]
    some = lambda n: vec() if n % 3 else None
    queries = [(f"q{n:03}", "red fox" if n % 10 else f"word{n}", some(n)) for n in range(120)] + [("other", "red", vec(5)), ("none", "", vec())]
    items = [(f"i{n:03}", f"a red fox word{n}", some(n + 1)) for n in range(400)] + [("gone", "red fox", vec())]
    want = set()
    for query, text, a in queries:
        best = []
        for i, own, b in items[:-1]:
            if text and set(text.split()) <= set(own.split()):
                both = a and b and len(a) == len(b)
                score = round(float(np.dot(a, b)) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-24), 6) if both else None
                best.append((score is None, -(score or 0), i))
        want |= {(query, i, rank + 1) for rank, (_, _, i) in enumerate(sorted(best)[:7])}
    q = staging.stage(spark.createDataFrame(queries, "query_id string, query string, embedding array<double>"), "queries")
    i = staging.stage(spark.createDataFrame(items, "id string, text string, embedding array<double>"), "items")
    before = moved(spark)
    try:
        got = retrieval.lexical_by_cosine(q, i, i.filter("id <> 'gone'"), 7).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert {(r.query_id, r.id, r["rank"]) for r in got} == want and len(got) == len(want)
    assert moved(spark) - before < 400_000


def test_cover_density_holds_one_row_at_a_time():
    """A batch of many rows and terms takes little memory besides its Arrow arrays."""
    rng = random.Random(3)
    rows = [[sorted(rng.sample(range(90), rng.randrange(1, 4))) for _ in range(20)] for _ in range(3000)]
    batch = pa.array([[], *rows], pa.list_(pa.list_(pa.int32())))[1:]
    tracemalloc.start()
    try:
        got = postings.cover_density.func(batch)
        assert tracemalloc.get_traced_memory()[1] < 1 << 20
    finally:
        tracemalloc.stop()
    assert got.to_pylist() == [postings.spans([np.array(t) for t in row]) for row in rows]
