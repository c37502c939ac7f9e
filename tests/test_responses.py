"""Projections of hits, their costs, section stats and source lists against loops over small tables."""

import datetime
import json

from pyspark.sql import functions as F

from mnemospark.functions import text as tx
from mnemospark.operators import context, hybrid, predicates
from mnemospark.operators import responses as rs

AT = datetime.datetime(2024, 2, 1)
FIELDS = "query_id int, id string, rank int, kind string, author string, score double, raw double, copies long, text string, query string, created_at timestamp, repo string, file string, host string, tags array<string>, fact_type string, category string"
LONG = "lead " * 60 + "needle " + "tail " * 60


def page(spark):
    rows = [
        (1, "k1", 1, "knowledge", "a", 0.5, 0.9, 2, "needle and thread", "needle", AT, "r", "r/f", "h", ["x"], "Odd", "Odd"),
        (1, "k2", 2, "knowledge", None, 0.4, None, 0, LONG + "answer", "needle", AT, None, None, None, None, None, None),
        (2, "f1", 1, "fact", "a", 0.5, None, 0, '{"needle":1}', "needle", AT, "r", "r/f", "h", ["x"], "UserFact", None),
        (2, "e1", 2, "event", "a", 0.4, None, 0, "", "needle", datetime.datetime(2025, 1, 1), None, None, None, None, None, "error"),
        (3, "k3", 1, "knowledge", "a", 0.5, 0.9, 0, None, None, None, None, None, None, None, None, None),
    ]
    return rs.with_snippets(spark.createDataFrame(rows, FIELDS), F.lit("2024-03-01").cast("timestamp"))


def test_compact_hits_name_only_what_their_kind_has(spark):
    got = {r.id: r for r in rs.compact(page(spark)).collect()}
    assert [got["k1"][c] for c in ("repo", "file", "host", "tags", "fact_type", "category", "copies", "age_seconds")] == ["r", "r/f", "h", ["x"], None, None, 2, 29 * 86400]
    assert [got["f1"][c] for c in ("repo", "file", "host", "tags", "fact_type", "category", "copies")] == [None, None, None, None, "UserFact", None, None]
    assert got["e1"].category == "error" and got["e1"].age_seconds == 0 and got["k3"].snippet is None
    assert {i: r.truncated for i, r in got.items()} == {"k1": True, "k2": True, "f1": False, "e1": False, "k3": False}
    whole = {r.id: r for r in rs.whole(page(spark)).collect()}
    assert whole["k2"].preview == LONG[:200] and whole["k2"].text == LONG + "answer" and "snippet" not in whole["k2"].__fields__


def size(row, *names):
    own = {n: row[n] for n in names if row[n] is not None}
    return -(-len(json.dumps(own, separators=(",", ":"), ensure_ascii=False)) // 4)


def test_costs_match_a_loop(spark):
    answers = [(1, ["answer"]), (2, ["needle"]), (3, ["gone"]), (4, ["nothing"]), (5, None)]
    hits = page(spark)
    want = {}
    rows = [r.asDict() for r in hits.collect()]
    for q, keys in answers:
        mine = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        full, short = [size(r, *rs.COMPACT[1:-1], "text") for r in mine], [size(r, *rs.COMPACT[1:]) for r in mine]
        fit = lambda t, keys=keys: t is not None and keys is not None and set(keys) <= set("".join(c if c.isalnum() else " " for c in t).split())
        good = [i for i, r in enumerate(mine) if fit(r["text"])]
        shown = any(fit(mine[i]["snippet"]) for i in good)
        fetch = full[good[0]] if good and not shown else 0
        want[q] = (sum(full), sum(short) + fetch, bool(good), shown)
    table = spark.createDataFrame(answers, "query_id int, keys array<string>")
    per = rs.costs(hits, table)
    got = {r.query_id: (r.full_tokens, r.compact_tokens, r.answered, r.carried) for r in per.collect()}
    assert got == want and want[1][2:] == (True, False) and want[2][2:] == (True, True)
    total = rs.cost_summary(per).first()
    full, short = sum(w[0] for w in want.values()) // 2, sum(w[1] for w in want.values()) // 2
    assert tuple(total) == (5, 2, 1, full, short, round(full / short, 2))
    assert tuple(rs.cost_summary(per.filter("not answered")).first())[1:] == (0, 0, None, None, None)


ITEM = "query_id int, section string, id string, score double, repo string, file string, host string, category string, day date, cost long"


def test_section_stats_match_a_loop(spark):
    day = datetime.date(2024, 1, 1)
    items = [
        (1, "fact", "f1", 0.9, "r", "a", None, None, None, 30), (1, "knowledge", "k1", 0.8, "r", "a", None, None, None, 10), (1, "knowledge", "k2", 0.7, "r", "b", None, None, None, 20),
        (1, "event", "e1", 0.6, None, None, "h", "c", day, 90), (1, "event", "e2", 0.5, None, None, "h", "c", day, 90), (2, "event", "e3", 0.5, None, None, "h", "c", day, 20),
        (3, "fact", "f2", 0.9, None, None, None, None, None, 90), (3, "knowledge", "k4", 0.1, None, None, None, None, None, 80),
    ]
    days = spark.createDataFrame([("h", "c", day, "s1", 7)], "host string, category string, day date, id string, cost long")
    found = context.with_summaries(context.across_sections(spark.createDataFrame(items, ITEM)), days, 100)
    kept = found.join(context.allocate(found, 100), ["query_id", "id"])
    got = {(r.query_id, r.section): (r.candidates, r["count"], r.tokens_spent, r.source, r.status) for r in context.section_stats(found, kept).collect()}
    none = (0, 0, 0, "raw", "empty")
    assert got == {
        (1, "fact"): (1, 1, 30, "raw", "ok"), (1, "knowledge"): (1, 1, 20, "raw", "ok"), (1, "event"): (1, 1, 7, "summary", "ok"),
        (2, "fact"): none, (2, "knowledge"): none, (2, "event"): (1, 1, 20, "raw", "ok"),
        (3, "fact"): (1, 1, 90, "raw", "ok"), (3, "knowledge"): (1, 0, 0, "raw", "cut"), (3, "event"): none,
    }


def test_facts_come_first_in_one_budget(spark):
    queries = spark.createDataFrame([("q", "red fox", [1.0, 0.0]), ("n", "blue", None)], "query_id string, query string, embedding array<double>")
    know = spark.createDataFrame([(f"k{i}", f"text {i}", f"h{i % 3}", None if i < 3 else "m", "User", "volatile" if i == 1 else None, 37, [1.0, i / 10], None) for i in range(6)], "id string, text string, content_hash string, machine string, source string, volatility string, age_days int, embedding array<double>, deleted_at timestamp")
    facts = spark.createDataFrame([(f"f{i}", "red fox " * (i + 1), 1.0, 1.0, 0) for i in range(2)], "id string, payload string, decay_weight double, confidence double, use_count int")
    events = spark.createDataFrame([(f"e{i}", "a red fox") for i in range(9)], "id string, payload string")
    got = hybrid.source_lists(queries, know, facts, events, 3, events_wanted=F.col("id") != "e0").collect()
    text = sorted((r.rank, r.kind, r.id) for r in got if r.list == "text")
    assert [k for _, k, _ in text] == ["fact", "fact", "event"] and text[2][2] == "e1" and {r.weight for r in got if r.list == "text"} == {1.0}
    assert {r.norm for r in got if r.list == "text" and r.rank in (1, 3)} == {1.0}
    near = {r.id: (r.rank, r.weight) for r in got if r.list == "vector"}
    assert near == {"k0": (1, 2.0), "k1": (2, 1.0), "k2": (3, 2.0)} and not any(r.query_id == "n" for r in got)


def test_first_page_and_the_next(spark):
    rows = spark.createDataFrame([(f"i{n}", datetime.datetime(2024, 1, 1 + n // 2)) for n in range(6)], "id string, at timestamp")
    first = predicates.keyset_after(rows, "at", "id", None, 3).collect()
    after = predicates.keyset_after(rows, "at", "id", ("2024-01-02", "i3"), 9).collect()
    assert [r.id for r in first] == ["i5", "i4", "i3"] and [r.id for r in after] == ["i2", "i1", "i0"]
    assert [r.id for r in predicates.keyset_after(rows, "at", "id", None, 2, newest_first=False).collect()] == ["i0", "i1"]


def test_terms_of_a_null_text_hold_no_key(spark):
    assert spark.createDataFrame([(None,)], "t string").select(F.size(F.array_except(F.array(F.lit("a")), tx.terms(F.col("t")))).alias("n")).first().n in (None, -1)
