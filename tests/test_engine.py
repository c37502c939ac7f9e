"""Engine queries against DuckDB on the smallest tables, and rules that SQL cannot state."""

import datetime
import math
import os
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemospark.functions import text as tx
from mnemospark.operators import context, lifecycle, predicates, ranking, retrieval
from mnemospark.plans import registry, search
from mnemospark.sources import files

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if isinstance(v, (datetime.date, list)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, duck, name):
    df, want = registry.queries()[name](spark, SF), duck.sql(SQL[name])
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    registry.queries()[name](spark, SF).collect()


def test_budget_floor_then_best_that_fits(spark):
    rows = [(1, "fact", "f1", 0.1, 5), (1, "knowledge", "k1", 0.9, 60), (1, "knowledge", "k2", 0.8, 50), (1, "event", "e1", 0.2, 30), (2, "event", "big", 0.5, 900)]
    df = spark.createDataFrame(rows, "query_id int, section string, id string, score double, cost long")
    kept = {(r.query_id, r.id) for r in context.allocate(df, 100).collect()}
    assert kept == {(1, "f1"), (1, "k1"), (1, "e1"), (2, "big")}
    assert context.allocate(df, 0).count() == 0


def test_proposals_resolve_in_order(spark):
    k = spark.createDataFrame([(f"k{i}", "AgentProposal", None) for i in range(5)], "id string, source string, deleted_at timestamp")
    p = spark.createDataFrame([(1, "k0", ["k1"]), (2, "k1", ["k2"]), (3, "k2", ["k3"]), (4, "k9", ["k4"])], "seq long, keeper_id string, retire_ids array<string>")
    assert {r.seq: r.outcome for r in lifecycle.resolve_proposals(p, k).collect()} == {1: "accepted", 2: "stale", 3: "accepted", 4: "stale"}


def test_json_containment(spark):
    """Like Postgres' @>: types count, objects inside arrays are subsets."""
    df = spark.createDataFrame([('{"a":{"b":1,"c":[1,2,"x",{"k":1,"m":[3]}],"n":null,"t":true},"d":"9"}',)], "p string")
    ask = lambda m: df.filter(predicates.contains_json("p", m)).count()
    yes = ({"a": {"b": 1}}, {"a": {"c": ["x"]}}, {"d": "9", "a": {}}, {"a": {"c": [{"k": 1}]}}, {"a": {"c": [{"m": [3]}, 2]}}, {"a": {"n": None}}, {"a": {"t": True}}, {"a": {"b": 1.0}}, {"a": {"c": []}})
    no = ({"a": {"b": 2}}, {"z": 1}, {"d": 9}, {"a": {"b": "1"}}, {"a": {"c": [{"k": 2}]}}, {"z": None}, {"a": {"t": 1}}, {"a": {"c": {}}}, {"a": {"c": [{"q": []}]}})
    assert [ask(m) for m in yes] == [1] * len(yes) and [ask(m) for m in no] == [0] * len(no)


def test_corpus_scan(spark, tmp_path):
    for path, text in (("a/x.md", "hello"), ("node_modules/y.md", "no"), ("b/Cargo.lock", "no"), ("b/Makefile", "yes"), ("c.bin", "no"), ("d/x.json", "no"), (".tox/a.py", "no"), ("e/App.VUE", "vue")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    assert sorted(r.text for r in files.scan_corpus(spark, str(tmp_path)).collect()) == ["hello", "vue", "yes"]


def test_normalised_is_idempotent(spark):
    df = spark.createDataFrame([("a \r\n\n\n\nb\t\n\n",), ("é x",), ("",)], "t string").select(tx.normalised(F.col("t")).alias("t"))
    once = [r.t for r in df.collect()]
    assert once[:2] == ["a\n\nb", "é x"] and once == [r.t for r in df.select(tx.normalised(F.col("t")).alias("t")).collect()]


def test_snippet_window(spark):
    text = "start " + "filler " * 100 + "needle in hay " + "tail " * 100
    got = spark.createDataFrame([(text, "needle hay")], "t string, q string").select(retrieval.snippet("t", "q").alias("s")).first().s
    assert "needle" in got and len(got) <= 322 and got[0] == "…" == got[-1]


def test_rrf_grows_with_weight(spark):
    df = spark.createDataFrame([(1, "a", 1, 1.0), (1, "b", 1, 2.0)], "query_id int, id string, rank int, weight double")
    got = {r.id: r.fused for r in ranking.rrf(df).collect()}
    assert got["b"] == 2 * got["a"] == pytest.approx(2 / 61)


def test_batches_written_again_replace_themselves(spark, tmp_path):
    rows = spark.createDataFrame([("1",), ("2",)], "id string")
    for batch in (0, 1, 0):
        files.append(rows, str(tmp_path / "log"), batch)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_cover_density_and_snippets_match_loops(spark):
    rng = random.Random(2)

    def density(words, wanted):
        spans, best = 0.0, -1
        for end in range(len(words)):  # shortest span that ends here and starts after the last counted start
            if words[end] in wanted:
                start = next((s for s in range(end, -1, -1) if set(wanted) <= set(words[s : end + 1])), None)
                if start is not None and start > best:
                    spans, best = spans + len(set(wanted)) / (end - start + 1), start
        return spans

    rows = [([rng.choice("abcde") for _ in range(rng.randrange(1, 30))], rng.sample("abc", rng.randrange(1, 4))) for _ in range(60)]
    held = [[[i for i, x in enumerate(w) if x == term] for term in q] for w, q in rows]
    placed = [(p, w, q) for p, (w, q) in zip(held, rows, strict=True) if all(p)]
    got = spark.createDataFrame([(p,) for p, _, _ in placed], "p array<array<int>>").select(retrieval.cover_density("p").alias("d")).collect()
    assert [r.d for r in got] == [pytest.approx(density(w, q)) for _, w, q in placed]
    texts = [" ".join(rng.choice(("needle", "hay", "stack", "x" * 9, "straw")) for _ in range(rng.randrange(5, 300))) for _ in range(20)]

    def window(t, anchors=("needle", "stack")):
        if len(t) <= 320:
            return t
        spots = sorted({m.start() for a in anchors for m in re.finditer(a, t)})
        starts = [min(max(0, h - 80), len(t) - 320) for h in spots]
        return max(sum(s <= p < s + 320 for p in spots) for s in starts) if spots else 0

    for r in spark.createDataFrame([(t, "needle stack") for t in texts], "t string, q string").select("t", retrieval.snippet("t", "q").alias("s")).collect():
        want = window(r.t)
        if len(r.t) <= 320:
            assert r.s == r.t
        else:
            body = r.s.strip("…")
            held = sum(len(re.findall(a, body)) for a in ("needle", "stack"))
            assert body in r.t and len(body) <= 320 and want - 6 <= held <= want + 1


def loop_budget(items, budget):
    order = {s: i for i, s in enumerate(context.SECTIONS)}
    kept, spent, own, floor = [], 0, Counter(), int(context.FLOOR * budget)
    for _, s, i, _, cost in sorted(items, key=lambda x: (order[x[1]], -x[3], x[2])):
        if own[s] < floor and spent + cost <= budget:
            kept, spent = [*kept, i], spent + cost
            own[s] += cost
    for _, s, i, _, cost in sorted(items, key=lambda x: (-x[3], order[x[1]], x[2])):
        if i not in kept and spent + cost <= budget:
            kept, spent = [*kept, i], spent + cost
    if not kept and budget:
        kept = [min(items, key=lambda x: (-x[3], order[x[1]], x[2]))[2]]
    return kept


def test_budget_matches_a_loop(spark):
    rng = random.Random(5)
    rows = [(q, rng.choice(context.SECTIONS), f"i{n}", rng.randrange(20) / 20, rng.randrange(1, 90)) for q in range(12) for n in range(rng.randrange(1, 25))]
    df = spark.createDataFrame(rows, "query_id int, section string, id string, score double, cost long")
    for budget in (5, 60, 300):
        got = {}
        for r in context.allocate(df, budget).collect():
            got.setdefault(r.query_id, set()).add(r.id)
        assert got == {q: set(loop_budget([r for r in rows if r[0] == q], budget)) for q in range(12)}


def test_summaries_stand_for_heavy_events(spark):
    items = [(1, "event", f"e{i}", 0.5 + i / 10, None, None, "h", "c", datetime.date(2024, 1, 1 + i % 2), 40) for i in range(4)] + [(1, "fact", "f", 0.1, None, None, None, None, None, 10), (2, "event", "e9", 0.3, None, None, "h", "c", datetime.date(2024, 1, 1), 40)]
    df = spark.createDataFrame(items, "query_id int, section string, id string, score double, repo string, file string, host string, category string, day date, cost long")
    days = spark.createDataFrame([("h", "c", datetime.date(2024, 1, 1), "s1", 7)], "host string, category string, day date, id string, cost long")
    got = {(r.query_id, r.id): (r.score, r.cost) for r in context.with_summaries(df, days, 200).collect()}
    assert got == {(1, "s1"): (0.7, 7), (1, "e1"): (0.6, 40), (1, "e3"): (0.8, 40), (1, "f"): (0.1, 10), (2, "e9"): (0.3, 40)}


def test_knn_without_itself_and_odd_vectors(spark):
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]), ("d", [1.0]), ("e", None)], "id string, embedding array<double>")
    got = retrieval.knn(items.filter("id in ('a', 'e')").withColumnRenamed("id", "query_id"), items, 2, exclude_self=True).collect()
    assert sorted((r.rank, r.id) for r in got) == [(1, "b"), (2, "c")]
