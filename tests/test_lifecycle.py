"""State jobs against loops that work the requests off one by one."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import graph, lifecycle, transitions

SOURCES = list(lifecycle.TRUST)
STATE = "id string, type string, payload_hash string, source string, version int, deleted_at timestamp"
REQUESTS = "seq long, fact_id string, type string, payload_hash string, source string, expected int"


def loop_upserts(state, requests):
    facts = {i: [t, h, s, v] for i, t, h, s, v, _ in state}
    gone = {i for i, *_, at in state if at is not None}
    out = {}
    for seq, i, t, h, s, expected in sorted(requests):
        same = min((k for k, f in facts.items() if f[:2] == [t, h] and k not in gone), default=None)
        if same is not None:
            out[seq] = ("touch" if expected in (None, facts[same][3]) else "conflict", None, False)
        elif i not in facts:
            facts[i] = [t, h, s, 1]
            out[seq] = ("insert", 1, False)
        elif lifecycle.TRUST[s] < lifecycle.TRUST[facts[i][2]]:
            out[seq] = ("dissent", None, False)
        elif expected not in (None, facts[i][3]):
            out[seq] = ("conflict", None, False)
        else:
            facts[i] = [t, h, s, facts[i][3] + 1]
            out[seq] = ("amend", facts[i][3], i in gone)
            gone.discard(i)
    return out, {i: f for i, f in facts.items() if i not in gone}


def upserts(spark, state, requests):
    s, r = spark.createDataFrame(state, STATE), spark.createDataFrame(requests, REQUESTS)
    outcomes = lifecycle.upsert_facts(s, r).cache()
    return s, r, outcomes


def test_upserts_of_one_id_in_order(spark):
    state = [("f", "T", "h0", "Task", 1, None)]
    requests = [(1, "f", "T", "h1", "Task", 1), (2, "f", "T", "h2", "Task", 1), (3, "f", "T", "h3", "Task", 2), (4, "f", "T", "h3", "AgentProposal", None), (5, "n", "T", "h4", "User", None), (6, "n", "T", "h5", "User", None), (7, "n", "T", "h6", "Task", None), (8, "m", "T", "h0", "Task", None)]
    _, _, out = upserts(spark, state, requests)
    got = {r.seq: (r.outcome, r.version) for r in out.collect()}
    assert got == {1: ("amend", 2), 2: ("conflict", None), 3: ("amend", 3), 4: ("touch", None), 5: ("insert", 1), 6: ("amend", 2), 7: ("dissent", None), 8: ("insert", 1)}


@pytest.mark.parametrize("seed", range(3))
def test_upserts_match_a_loop(spark, seed):
    import datetime

    rng = random.Random(seed)
    gone = datetime.datetime(2024, 1, 1)
    state = [(f"f{i}", "T", f"h{rng.randrange(25)}", rng.choice(SOURCES), rng.randrange(1, 3), gone if i % 7 == 0 else None) for i in range(30)]
    requests = [(n, f"f{rng.randrange(40)}", "T", f"h{rng.randrange(40 if n % 2 else 400)}", rng.choice(SOURCES), rng.choice((None, None, 1, 2, 3))) for n in range(250)]
    s, r, out = upserts(spark, state, requests)
    want, facts = loop_upserts(state, requests)
    assert {x.seq: (x.outcome, x.version, x.revives_deleted) for x in out.collect()} == want
    after = {x.id: [x.type, x.payload_hash, x.source, x.version] for x in lifecycle.next_facts(s, r, out).collect() if x.deleted_at is None}
    assert after == facts
    filed = Counter((i, h) for n, i, _, h, _, _ in requests if want[n][0] == "dissent")
    assert {(x.fact_id, x.payload_hash): x.submission_count for x in lifecycle.dissents_of(r, out).collect()} == filed


def loop_proposals(proposals, alive):
    alive, out = set(alive), {}
    for seq, keeper, retired in sorted(proposals):
        ok = {keeper, *retired} <= alive
        out[seq] = "accepted" if ok else "stale"
        if ok:
            alive -= set(retired) - {keeper}
    return out


def resolved(spark, proposals, rows):
    k = spark.createDataFrame(rows, "id string, source string, deleted_at timestamp")
    p = spark.createDataFrame(proposals, "seq long, keeper_id string, retire_ids array<string>")
    return {r.seq: r.outcome for r in lifecycle.resolve_proposals(p, k).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_proposals_match_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(f"k{i}", "AgentProposal" if i % 9 else "Task", None) for i in range(60)]
    proposals = [(n, f"k{rng.randrange(60)}", [f"k{rng.randrange(60)}" for _ in range(rng.randrange(1, 3))]) for n in range(70)]
    assert resolved(spark, proposals, rows) == loop_proposals(proposals, [i for i, s, _ in rows if s == "AgentProposal"])


def test_long_chain_and_hot_row(spark):
    """A chain of 300 links is decided by doubling, and 300 proposals that name one row without pairs."""
    rows = [(f"k{i}", "AgentProposal", None) for i in range(700)]
    proposals = [(i, f"k{i}", [f"k{i + 1}"]) for i in range(300)] + [(1000 + i, f"k{400 + i}", ["k399"]) for i in range(300)] + [(2000, "k399", ["k398"])]
    assert resolved(spark, proposals, rows) == loop_proposals(proposals, [i for i, _, _ in rows])


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.id: r.comp for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(51), 0) | dict.fromkeys((100, 200, 300), 100)


def test_a_deleted_fact_is_known(spark):
    """Its trust and version count; an amendment makes it live again."""
    gone = datetime.datetime(2024, 1, 1)
    state = [("f", "T", "h0", "User", 5, gone), ("g", "T", "h1", "Task", 3, gone)]
    requests = [(1, "f", "T", "h2", "AgentProposal", 5), (2, "g", "T", "h3", "Task", 4), (3, "g", "T", "h3", "Task", 3), (4, "g", "T", "h4", "Task", 4), (5, "n", "T", "h0", "Task", None)]
    s, r, out = upserts(spark, state, requests)
    assert {x.seq: (x.outcome, x.version, x.revives_deleted) for x in out.collect()} == {1: ("dissent", None, False), 2: ("conflict", None, False), 3: ("amend", 4, True), 4: ("amend", 5, False), 5: ("insert", 1, False)}
    assert {(x.id, x.version, x.deleted_at is None) for x in lifecycle.next_facts(s, r, out).collect()} == {("f", 5, False), ("g", 5, True), ("n", 1, True)}


AT = datetime.datetime(2024, 3, 1)


def fold(state, requests, step, key):
    """All requests one after the other, each on the row that its key has by then."""
    rows, out = {r[key]: dict(r) for r in state}, {}
    for r in sorted(requests, key=lambda r: r["seq"]):
        row, outcome, version = step(rows.get(r[key]), r)
        rows.pop(r[key], None)
        if row is not None:
            rows[r[key]] = row
        out[r["seq"]] = (outcome, version)
    return rows, out


def test_deletions_in_order(spark):
    s = spark.createDataFrame([("a", None, None), ("b", AT, "c"), ("c", None, None), ("d", None, None)], "id string, deleted_at timestamp, superseded_by string")
    asked = [(1, "a", "delete"), (2, "a", "delete"), (3, "a", "restore"), (4, "b", "restore"), (5, "c", "delete"), (6, "c", "hard"), (7, "c", "restore"), (8, "ev", "hard"), (9, "x", "delete"), (10, None, "delete")]
    r, events = spark.createDataFrame(asked, "seq long, id string, action string"), spark.createDataFrame([("ev",)], "id string")
    after, out = lifecycle.delete_restore(s, r, events, F.lit(AT))
    assert {x.seq: x.outcome for x in out.collect()} == {1: "deleted", 2: "noop", 3: "restored", 4: "restored", 5: "deleted", 6: "removed", 7: "missing", 8: "refused", 9: "missing", 10: "missing"}
    assert {(x.id, x.deleted_at, x.superseded_by) for x in after.collect()} == {("a", None, None), ("b", None, None), ("d", None, None)}


def test_dissents_in_order(spark):
    f = spark.createDataFrame([("f", "p0", "Task", 1, None), ("g", "q0", "Task", 7, None), ("h", "r0", "Task", 1, AT)], "id string, payload string, source string, version int, deleted_at timestamp")
    d = spark.createDataFrame([("d1", "f", "p1", "pending"), ("d2", "f", "p2", "pending"), ("d3", "g", "q1", "discarded"), ("d4", "h", "r1", "pending"), ("d5", "none", "s1", "pending")], "id string, fact_id string, payload string, status string")
    asked = [(1, "d1", "promote", 1), (2, "d2", "promote", 1), (3, "d1", "promote", 2), (4, "d2", "promote", 2), (5, "d2", "discard", None), (6, "d3", "promote", 7), (7, "d4", "promote", 1), (8, "d4", "discard", None), (9, "d5", "discard", None), (10, "d5", "discard", None), (11, "zz", "discard", None)]
    out, facts, after = lifecycle.resolve_dissents(d, f, spark.createDataFrame(asked, "seq long, dissent_id string, action string, expected int"))
    assert {x.seq: (x.outcome, x.version) for x in out.collect()} == {1: ("promoted", 2), 2: ("conflict", None), 3: ("not_pending", None), 4: ("promoted", 3), 5: ("not_pending", None), 6: ("not_pending", None), 7: ("missing", None), 8: ("discarded", None), 9: ("discarded", None), 10: ("not_pending", None), 11: ("missing", None)}
    assert {(x.id, x.payload, x.source, x.version) for x in facts.collect()} == {("f", "p2", "User", 3), ("g", "q0", "Task", 7), ("h", "r0", "Task", 1)}
    assert {x.id: x.status for x in after.collect()} == {"d1": "promoted", "d2": "promoted", "d3": "discarded", "d4": "discarded", "d5": "discarded"}


@pytest.mark.parametrize("seed", range(2))
def test_transitions_match_a_loop(spark, seed):
    """Deletions and updates, many a key and a hot one, against all requests one after the other."""
    rng = random.Random(seed)
    state = [{"id": f"k{i}", "deleted_at": rng.choice((None, None, AT)), "superseded_by": None, "source": rng.choice(("AgentProposal", "Task")), "text": "t", "content_hash": "h", "tags": ["a"], "volatility": None} for i in range(30)]
    names = "id string, deleted_at timestamp, superseded_by string, source string, text string, content_hash string, tags array<string>, volatility string"
    s = spark.createDataFrame([tuple(r.values()) for r in state], names)
    key = lambda: rng.choice(("k0", f"k{rng.randrange(40)}"))
    deletions = [{"seq": n, "id": key(), "action": rng.choice(("delete", "restore", "restore", "hard") if n > 250 else ("delete", "restore")), "event": False, "at": AT} for n in range(300)]
    updates = [{"seq": n, "id": key(), "text": rng.choice((None, f"x{n}", "  ")), "content_hash": f"h{n}", "tags": rng.choice((None, [f"t{n}"], [])), "volatility": rng.choice((None, "stable"))} for n in range(300)]
    for requests, schema, step in ((deletions, "seq long, id string, action string, event boolean, at timestamp", transitions.deletion), (updates, "seq long, id string, text string, content_hash string, tags array<string>, volatility string", transitions.update)):
        r = spark.createDataFrame([tuple(x.values()) for x in requests], schema).repartition(4)
        after, out = transitions.apply_in_order(s, r, step)
        rows, want = fold(state, requests, step, "id")
        assert {x.seq: (x.outcome, x.version) for x in out.collect()} == want
        assert {x.id: x.asDict() for x in after.collect()} == rows


def test_supersessions_follow_chains(spark):
    k = spark.createDataFrame([("a", "t", "h", "AgentProposal", ["x"], "volatile", "a9", AT, None), ("b", "t", "h", "Task", [], None, "a9", AT, None), ("c", "t", "h", "AgentProposal", [], None, "a9", AT, AT)], "id string, text string, content_hash string, source string, tags array<string>, volatility string, author_id string, created_at timestamp, deleted_at timestamp")
    asked = [(1, "a2", "a3", "early"), (2, "a", "a2", "two"), (3, "a", "a9", "late"), (4, "a2", "a4", "four"), (5, "a4", "a5", "five"), (6, "b", "b2", "no"), (7, "c", "c2", "no"), (8, "z", "z2", "no"), (9, "a5", "a6", " "), (10, "a4", "a7", "late")]
    r = spark.createDataFrame([(*x, "me") for x in asked], "seq long, id string, new_id string, text string, author_id string")
    after, out = lifecycle.supersede(k, r, F.lit(AT))
    assert {x.seq: x.outcome for x in out.collect()} == {1: "missing", 2: "superseded", 3: "missing", 4: "superseded", 5: "superseded", 6: "not_agent_authored", 7: "missing", 8: "missing", 9: "invalid", 10: "missing"}
    got = {x.id: (x.text, x.supersedes, x.superseded_by, x.deleted_at is None, x.tags, x.author_id) for x in after.collect()}
    assert got == {"a": ("t", None, "a2", False, ["x"], "a9"), "a2": ("two", "a", "a4", False, ["x"], "me"), "a4": ("four", "a2", "a5", False, ["x"], "me"), "a5": ("five", "a4", None, True, ["x"], "me"), "b": ("t", None, None, True, [], "a9"), "c": ("t", None, None, False, [], "a9")}


def test_transition_stream_equals_batch(spark, tmp_path):
    """Requests in shuffled files and small Arrow batches: the stream gives the outcomes of the batch."""
    rng = random.Random(6)
    s = spark.createDataFrame([(f"k{i}", AT if i % 3 == 0 else None, None) for i in range(12)], "id string, deleted_at timestamp, superseded_by string")
    asked = [(n, f"k{rng.randrange(15)}", rng.choice(("delete", "restore", "restore", "hard") if n > 120 else ("delete", "restore")), False, AT) for n in range(150)]
    schema = "seq long, id string, action string, event boolean, at timestamp"
    _, want = transitions.apply_in_order(s, spark.createDataFrame(asked, schema), transitions.deletion)
    mixed = asked[:]
    rng.shuffle(mixed)
    spark.createDataFrame(mixed, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        stream = transitions.stream_transitions(s, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), transitions.deletion)
        q = stream.writeStream.format("memory").queryName("deletions").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert {(r.seq, r.id, r.outcome) for r in spark.sql("select * from deletions").collect()} == {(r.seq, r.id, r.outcome) for r in want.collect()}


@pytest.mark.parametrize("seed", range(1))
def test_proposals_with_merged_texts(spark, seed):
    """A merged text retires the keeper too, and stands as a row of its own."""
    k = spark.createDataFrame([(f"k{i}", "t", "h", "AgentProposal", [str(i)], None, "a", AT, None) for i in range(8)], "id string, text string, content_hash string, source string, tags array<string>, volatility string, author_id string, created_at timestamp, deleted_at timestamp")
    p = spark.createDataFrame([(1, "k0", ["k1"], "both"), (2, "k0", ["k2"], None), (3, "k3", ["k4"], None), (4, "k3", ["k5"], None)], "seq long, keeper_id string, retire_ids array<string>, text string")
    out = lifecycle.resolve_proposals(p, k)
    assert {r.seq: r.outcome for r in out.collect()} == {1: "accepted", 2: "stale", 3: "accepted", 4: "accepted"}
    after = {r.id: (r.superseded_by, r.deleted_at is None, r.tags) for r in lifecycle.after_proposals(k, p, out, F.lit(AT)).collect()}
    assert after == {"k0": ("merged-1", False, ["0"]), "k1": ("merged-1", False, ["1"]), "k2": (None, True, ["2"]), "k3": (None, True, ["3"]), "k4": ("k3", False, ["4"]), "k5": ("k3", False, ["5"]), "k6": (None, True, ["6"]), "k7": (None, True, ["7"]), "merged-1": (None, True, ["0"])}


def test_a_tasks_share_of_requests_is_bounded(spark, monkeypatch):
    """More requests are dealt in more parts, which are not coalesced however well they compress; outcomes stay."""
    monkeypatch.setattr(transitions, "ROWS", 10)
    kept = []
    monkeypatch.setattr(transitions, "stage", lambda df, name, f=transitions.stage: kept.append(f(df, name)) or kept[-1])
    state = spark.createDataFrame([(f"f{n}", None) for n in range(100)], "id string, deleted_at timestamp")
    asked = spark.createDataFrame([(n * 2 + k, f"f{n}", ("delete", "restore")[k]) for n in range(100) for k in range(2)], "seq long, id string, action string")
    _, outcomes = lifecycle.delete_restore(state, asked, spark.createDataFrame([], "id string"), F.lit("2024-03-01").cast("timestamp"))
    assert {(r.seq, r.outcome) for r in outcomes.collect()} == {(n, ("deleted", "restored")[n % 2]) for n in range(200)}
    shares = [r["count"] for r in kept[0].filter("outcome is not null").groupBy(F.input_file_name()).count().collect()]
    assert len(shares) > 8 and max(shares) <= 60
