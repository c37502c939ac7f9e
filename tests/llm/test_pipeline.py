"""The corpus pipeline on rows that the given tables don't have."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mnemospark.llm import common, hyperdim

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, __pii string, base_spans int, key double"


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def through(spark, rows, schema=SCHEMA):
    cur, seen = common.stage(spark.createDataFrame(rows, schema), "docs"), {}
    for name, step in corpus_pipeline.STAGES:
        cur = common.stage(step(spark, cur, SF), name)
        seen[name] = cur
    return seen


def test_rows_decide_not_ids(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    clash = ("r", "p", 3, 0.5)
    rows = [
        (None, prose(1), "en", "s", 1, *clash),
        (None, prose(1), "en", "s", 1, *clash),  # a copy of a row without id
        (None, "x " + item, "en", "s", 1, *clash),  # holds a benchmark item
        (7, prose(2), "en", "s", 1, *clash),
        (7, prose(3), "fr", "s", 1, *clash),  # one id, another text: stays
        (7, prose(3), "fr", "s", 1, *clash),
        (6, prose(2) + " end", None, "s", 1, *clash),  # near copy of a larger id
        (8, None, None, None, None, None, None, None, None),
        (9, "12 34 !", "en", "s", 1, *clash),
        (10, "", "en", "s", 1, *clash),
        (11, prose(4) + " mail me@example.org " + "1.2.3.4", "en", "s", 1, *clash),
        (12, prose(5, 30000), "en", "s", 1, *clash),
    ]
    seen = through(spark, rows)
    key = lambda r: (r.doc_id, r.text)
    kept = sorted(map(key, seen["near_duplicates"].collect()), key=repr)
    assert kept == sorted([(None, prose(1)), (None, "x " + item), (7, prose(3)), (6, prose(2) + " end"), (11, rows[10][1]), (12, rows[11][1])], key=repr)
    clean = {r.doc_id: r for r in seen["personal_data"].collect()}
    assert set(clean) == {None, 6, 7, 11, 12} and seen["benchmark"].count() == 5
    assert "[EMAIL]" in clean[11].text and "[IP]" in clean[11].text and clean[11].n_chars == len(clean[11].text)
    assert all(seen[n].columns == [c.split()[0] for c in SCHEMA.split(", ")] for n in list(seen)[:-1])
    assert clean[7].row == "r" and clean[7]["__pii"] == "p" and clean[7].key == 0.5
    assert {r.doc_id for r in seen["packing"].collect()} == set(clean)


def test_no_labels_and_empty_table(spark):
    rows = [(i, prose(i), None, "s", 1, None, None, None, None) for i in range(3)] + [(4, "123", None, "s", 1, None, None, None, None)]
    assert {r.doc_id for r in through(spark, rows)["packing"].collect()} == {0, 1, 2}
    assert through(spark, [])["packing"].count() == 0


def test_language_matches_brute_force(spark):
    """Bundles and cosines against sums over single trigrams; one text is long enough to be cut into pieces."""
    chars = hyperdim.PIECE_CHARS
    rng = random.Random(3)
    texts = [(i, prose(i, rng.randrange(1, 40)) + rng.choice(("", " Ünï, 12", "🙂")), rng.choice("ab")) for i in range(30)] + [(90, None, "a"), (91, "12", "b"), (92, prose(92, 30000), "a")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, lang string").coalesce(2)
    space = hyperdim.Space(hyperdim.DIMENSIONS, hyperdim.SEED)

    def bundle(text):
        grams = Counter()
        for at in range(0, len(text), chars):
            run = " " + "".join(c if c.isalpha() else " " for c in text[at : at + chars].lower()) + " "
            run = " " + " ".join(run.split()) + " " if run.split() else ""
            grams.update(zip(run, run[1:], run[2:]))  # noqa: B905
        total = np.zeros(hyperdim.DIMENSIONS)
        for (a, b, c), n in grams.items():
            total += n * np.roll(space.letter(ord(a)), 2).astype(int) * np.roll(space.letter(ord(b)), 1) * space.letter(ord(c))
        return total, sum(grams.values())

    made = {i: bundle(t or "") for i, t, _ in texts}
    lang = {i: g for i, _, g in texts}
    protos = {g: sum(v / n for i, (v, n) in made.items() if n and lang[i] == g) for g in "ab"}
    unit = {g: v / np.linalg.norm(v) for g, v in protos.items()}
    space_side = lambda v, g: float(v @ unit[g] / np.linalg.norm(v))
    for r in hyperdim.identify(df, hyperdim.prototypes(df, "text", "lang")).collect():
        v, n = made[r.doc_id]
        if not n:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        best = max("ab", key=lambda g: space_side(v, g))
        assert r.score == pytest.approx(max(0.0, space_side(v, best)), abs=1e-4)
        assert r.lang_pred == best or abs(space_side(v, "a") - space_side(v, "b")) < 1e-4
    fold = df.select("doc_id", hyperdim.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in fold)
