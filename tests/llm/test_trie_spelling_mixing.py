"""Operators 11 to 13 against plain-Python versions, with edge cases."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import mixing, spelling, trie

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, depth string"


@pytest.fixture(scope="module")
def conversations():
    """Shared starts, copies, nulls, ties, repeated rows, turnless conversations and one long conversation with a copy."""
    rng, rows = random.Random(7), []
    for c in range(120):
        for t in range(rng.randrange(0, 6)):
            turn = rng.choice((t, t, t, None))
            rows.append((c, turn, rng.choice(("user", "assistant", None)), rng.choice(("a b", "a", "", None, "x y z", f"own {c}"))))
    rows += [(500, t, "user", f"w {t // 3}") for t in range(90)] + [(501, t, "user", f"w {t // 3}") for t in range(88)]
    rows += [(c, 0, "user", "same") for c in range(700, 760)] + [(700, 0, "user", "same")] * 3
    rows += [(None, 1, "user", "nobody"), (-45, 1, "user", "below zero"), (-40, 1, "user", "its base")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "shards"), [(32, None), (32, 9), (1, 1), (2, 25), (5, 12)])
def test_trie_equals_brute_force(spark, conversations, block, shards):
    rows = [r for r in conversations if r[0] is None or r[0] >= 0]
    turns, convs = trie.rebuilt(spark.createDataFrame([(*r, "clash") for r in rows], TURNS).repartition(5))
    got = [tuple(r) for r in trie.trie(turns, convs, shards=shards, block=block).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute.trie(rows)


def test_trie_negative_and_missing_ids(spark, conversations):
    turns, convs = trie.rebuilt(spark.createDataFrame([(*r, "clash") for r in conversations], TURNS))
    root = [r for r in trie.trie(turns, convs, shards=4).collect() if r.depth == 0]
    assert [(r.conv_id, r.n_convs) for r in root] == [(-45, len({r[0] for r in conversations} - {None}))]


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert trie.trie(*trie.rebuilt(none)).collect() == []


def test_trie_ids_in_pieces(spark, monkeypatch):
    """More ending conversations at one node than a piece of ids holds, over several shards."""
    monkeypatch.setattr(trie, "PIECE", 100)
    rows = [(20 * c, 0, "user", "same") for c in range(300)]
    got = [tuple(r) for r in trie.trie(*trie.rebuilt(spark.createDataFrame([(*r, "") for r in rows], TURNS)), shards=6).collect()]
    assert set(got) == brute.trie(rows)


def test_trie_on_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r)[:8] for r in trie.op11_trie(spark, SF).collect()} == brute.trie(rows)


DOCS = "doc_id long, text string, word string, n string"


def spelled(spark, docs, crowd=spelling.CROWD):
    frame = spark.createDataFrame([(*d, None, "n") for d in docs], DOCS)
    words = spelling.counted(frame).filter("n >= 2")
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.grouped(words).collect()}


def test_spelling_equals_brute_force(spark):
    rng, docs = random.Random(3), []
    stems = ["abcdefgh", "abcdefghi", "aaaaaaa", "aaaaaaaa", "Ünïcode", "straßenbahn", "ÉCOLEécole", "x" * 40]
    for d in range(300):
        words = []
        for _ in range(rng.randrange(0, 60)):
            w = rng.choice(stems)
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = rng.choice((w[:at] + w[at + 1 :], w[:at] + "q" + w[at:], w[:at] + "z" + w[at + 1 :]))
            words.append(w)
        docs.append((rng.choice((d, d, None)), rng.choice((" ", "-", " ", "Ă")).join(words)))
    docs += [(9000, None), (9001, ""), (9002, "short"), (9003, "abcdefgh " * 3000), (9003, "abcdefgh " * 3000)]
    assert spelled(spark, docs) == brute.spelling(brute.words(docs))


def test_crowded_chunks_lose_nothing(spark):
    """All words share their first half, or their second; chunks are refined, down to one open letter."""
    rng = random.Random(5)
    words = {"prefix" + "".join(rng.choices("abc", k=5)) for _ in range(150)} | {"".join(rng.choices("abc", k=5)) + "suffix" for _ in range(150)} | {"prefixx" + c for c in "abcdefgh"}
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    want = {(a, b) for a in words for b in words if a < b and brute.near(a, b)}
    for crowd in (1, 4, 64):
        got = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(frame, crowd).collect()]
        assert len(got) == len(set(got))
        assert set(got) == want


def test_spelling_long_text_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 50)
    monkeypatch.setattr(spelling, "HELD", 3)
    text = " ".join(f"langeswort{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600))
    docs = [(1, text), (2, text), (3, "y" * 5000), (4, "y" * 5000)]
    assert spelled(spark, docs) == brute.spelling(brute.words(docs))
    assert spelled(spark, []) == set()


MIXED = "doc_id long, source string, n long, size string, place string"


def mixed(spark, docs, **how):
    rows = mixing.mix(spark.createDataFrame([(*d, "s", "p") for d in docs], MIXED).repartition(3), F.col("n"), **how).collect()
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_mix_meets_targets(spark, seed):
    rng = random.Random(seed)
    docs = [(i, rng.choice(("hot", "hot", "hot", "a", "b", None, "ä", "Z", "tiny")) if i % 97 else "few", rng.choice((0, 1, 7, 50, 400, 9000 if i % 50 == 0 else 3))) for i in range(900)]
    docs += [docs[0]] * 3 + [(None, "empty", 0)]
    rows = mixed(spark, docs)
    sizes = {}
    for _, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    want = brute.targets(sizes)
    assert len(rows) == len(docs)
    taken, per_shard, per_source = {}, {}, {}
    for r in rows:
        assert (r.source_size, r.size) == (sizes[r.source], r.n if hasattr(r, "n") else r.size)
        assert r.target == pytest.approx(want[r.source])
        words = [0] * r.size
        for s in r.slices:
            assert 0 <= s.from_word < s.to_word <= r.size
            for w in range(s.from_word, s.to_word):
                words[w] += 1
            per_shard[s.shard] = per_shard.get(s.shard, 0) + s.to_word - s.from_word
            per_source.setdefault(r.source, {}).setdefault(s.shard, 0)
            per_source[r.source][s.shard] += s.to_word - s.from_word
        assert all(w <= 2 for w in words)
        taken[r.source] = taken.get(r.source, 0) + sum(words)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK
    assert max(per_shard.values()) - min(per_shard.values()) <= 2 * mixing.BLOCK * len(sizes)
    again = mixed(spark, docs[::-1])
    key = lambda r: (r.doc_id is None, r.doc_id, r.source or "", r.size, [tuple(s) for s in r.slices])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_quotas_are_sainte_lague(spark):
    rng = random.Random(11)
    sizes = [rng.choice((0, 3, 40, 700, 5000)) + rng.randrange(9) for _ in range(40)]
    want = brute.targets({f"s{i:02}": n for i, n in enumerate(sizes)})
    rows = [(i, n, float(want[f"s{i:02}"])) for i, n in enumerate(sizes)]
    got = {r.place: r.ends for r in mixing.quotas(spark.createDataFrame(rows, "place long, source_size long, target double"), shards=5, block=16).collect()}
    votes, most = [r[2] for r in rows], [2 * -(-r[1] // 16) for r in rows]
    seats = int(sum(votes) / 16 + 0.5)
    for shard in range(5):
        assert [got[i][shard] for i in range(len(rows))] == brute.sainte_lague(votes, seats * (shard + 1) // 5, most)


def test_mix_of_nothing(spark):
    assert mixed(spark, []) == []
    assert [r.slices for r in mixed(spark, [(1, "a", 0), (2, None, 0)])] == [[], []]


def test_mix_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    rows = {r.doc_id: r for r in mixing.op13_mixing(spark, SF).collect()}
    assert {d.doc_id: len(brute.WORD.findall(d.text or "")) for d in docs} == {i: r["size"] for i, r in rows.items()}
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows.values())
    for source in {d.source for d in docs}:
        own = [r for r in rows.values() if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * mixing.BLOCK
