"""The training-data operators against brute force, round trips and edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import chat, common, decontam, hyperdim, lmscore, neardup, packing, pii, quality, sharding, tokenfile, tokens

P = pytest.importorskip("public_tokenizers")
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key int, id int, score double, __c int, __pii string, __text string, h string, row string, shard int"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_rows():
    rng = random.Random(5)
    base = prose(rng, 80)
    near = base.replace(base.split()[40], "changed", 1)
    texts = [None, "", "  \n\t ", "one", base, base, near, prose(rng, 30000), "Ünï cödé 🙂 " * 30, prose(rng, 60), "12 34 56"]
    rows = [(i, t, "en" if i % 2 else None, "s", 1, 7, 8, 0.5, 1, "p", "t", "h", "r", 3) for i, t in enumerate(texts)]
    return rows + [rows[4], (None, "no id here at all", *[None] * 12)]


@pytest.fixture(scope="module")
def docs(spark):
    return common.stage(spark.createDataFrame(edge_rows(), SCHEMA), "docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def run_all(docs, spark):
    items = spark.createDataFrame([(1, prose(random.Random(9), 30)), (2, None), (3, "")], "item_id bigint, text string")
    protos = hyperdim.prototypes(docs.filter("lang is not null"), "text", "lang")
    path = common.shared_folder(spark) + "/ids"
    tokenfile.write_ids(docs, path, WORD)
    return {
        "shard": sharded(docs, 4)[0].count(),
        "quality": quality.judge(docs).count(),
        "pack": packing.pack(packing.pieces(docs, BYTE)).select("doc_id").distinct().count(),
        "near": neardup.near_duplicates(docs).count(),
        "ids": tokenfile.read_ids(spark, path).count(),
        "pii": pii.find(docs, model=pii.fit(docs)).count(),
        "decontam": decontam.contaminated(docs, items).count(),
        "lang": hyperdim.identify(docs, protos).count(),
        "chat": chat.perspectives(docs.select(F.monotonically_increasing_id().alias("doc_id"), "key", F.lit("ann").alias("role"), "text"), "doc_id", "key").count(),
        "lm": lmscore.word_score(docs.withColumn("is_target", F.lit(True))).count(),
    }


def test_edge_rows_keep_every_row(docs, spark):
    n = docs.count()
    found = run_all(docs, spark)
    assert found.pop("decontam") == 0
    assert found.pop("pack") == n - 1  # one id is repeated; the null id counts as a value
    assert set(found.values()) == {n}


def test_empty_table(empty, spark):
    assert set(run_all(empty, spark).values()) == {0}


def sharded(df, shards, bucket_bytes=20_000):
    path = common.shared_folder(df.sparkSession) + "/shards"
    sharding.write_shards(df, path, "doc_id", F.octet_length(F.coalesce("text", F.lit(""))) + 16, shards, bucket_bytes=bucket_bytes)
    return sharding.read_shards(df.sparkSession, path, df.schema, "doc_id", shards), path


def test_sharding_law_slots_and_whole_records(spark):
    rows = [(i, f"text {i} " * (i % 9)) for i in range(3000)] + [(1, None), (None, "é🙂"), (None, "")] + [(5, "same row")] * 2000
    df = common.stage(spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"Shard": F.lit(7), "bucket": F.lit(1), "record": F.lit("x")}), "docs")
    out, path = sharded(df, 7)
    assert [c for c in out.columns if c.lower() == "shard"] == ["shard"] and {"bucket", "record"} <= set(out.columns)
    few = out.collect()
    assert Counter((r.doc_id, r.text) for r in few) == Counter(rows)
    slots, home = defaultdict(list), defaultdict(set)
    for r in few:
        slots[r.shard].append(r.slot)
        home[r.doc_id].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 7 and all(len(s) == 1 for s in home.values())
    more = {r.doc_id: r.shard for r in sharded(df, 8)[0].collect()}
    assert all(r.grown_shard == more[r.doc_id] and r.grown_shard in (r.shard, 7) for r in few) and set(more.values()) == set(range(8))
    order = [r.doc_id for r in sorted((r for r in few if r.shard == few[0].shard), key=lambda r: r.slot) if r.text != "same row"]
    assert order != sorted(order, key=lambda d: (d is None, d))
    equal = spark.read.parquet(path).filter("record.text = 'same row'").groupBy("bucket").count().collect()
    assert len(equal) > 1 and max(r["count"] for r in equal) < 1900  # equal rows are dealt to several buckets
    assert sharded(df.limit(0), 7)[0].count() == 0


def test_slots_depend_on_the_records_alone(spark, tmp_path):
    """One file, three files and shuffled files give the same slots; a hot key and a hot record are split."""
    rng = random.Random(2)
    rows = [(i, f"text {i} " * (i % 9)) for i in range(1500)] + [(77, f"hot key {i}") for i in range(900)] + [(5, "same row")] * 900 + [(i, "twice") for i in range(40)] * 2
    found = []
    for n in (1, 3, 5):
        frame = spark.createDataFrame(rows, "doc_id bigint, text string")
        (frame.coalesce(1) if n == 1 else frame.repartition(n)).write.parquet(str(tmp_path / f"in{n}"))
        rng.shuffle(rows)
        out, path = sharded(spark.read.parquet(str(tmp_path / f"in{n}")), 6)
        found.append(sorted((r.shard, r.slot, r.doc_id, r.text) for r in out.collect()))
        sizes = [r["count"] for r in spark.read.parquet(path).groupBy("shard", "bucket").count().collect()]
        assert max(sizes) <= 2 * sharding.BUCKET_ROWS
    assert found[0] == found[1] == found[2]


def test_shuffle_is_fisher_yates(spark):
    sizes = [0, 1, 2, 3, 50, 300]
    df = spark.createDataFrame([(n,) for n in sizes], "n int")
    df = df.withColumn("v", F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>")))
    draws = F.when(F.col("n") > 1, F.transform(F.sequence(F.col("n") - 1, F.lit(1), F.lit(-1)), lambda i: F.pmod(F.xxhash64(F.lit(3), F.col("n"), i), i + 1))).otherwise(F.array().cast("array<bigint>"))
    for r in df.select("n", draws.alias("d"), sharding.shuffled(F.col("v"), F.lit(3), F.col("n")).alias("got")).collect():
        want = list(range(r.n))
        for i, j in zip(range(r.n - 1, 0, -1), r.d, strict=True):
            want[i], want[j] = want[j], want[i]
        assert r.got == want


def test_sharding_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sharding.op1_sharding(spark, sf).collect()
    assert len(rows) == len(texts) and all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    assert all(0 <= r.shard < 40 and r.grown_shard in (r.shard, 40) and r.law == "key" for r in rows)


def brute_repeats(words, k=5):
    seen = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return len({j for i in range(len(words) - k + 1) if seen[tuple(words[i : i + k])] > 1 for j in range(i, i + k)})


def test_repeated_words(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 4, 5, 6, 9, 40, 200)] + ["x " * 30, prose(rng, 200) + " tail " + prose(random.Random(1), 50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for r in quality.judge(df).collect():
        words = texts[r.doc_id].split()
        assert (r.n_words, r.n_repeat_words) == (len(words), brute_repeats(words))


def test_cascade_stops_at_the_first_rejection(spark):
    df = spark.createDataFrame([(1, prose(random.Random(1), 50)), (2, "one two"), (3, None)], "doc_id bigint, text string")
    rules = {"all": "n_words > 10", "fatal": "raise_error('shown to the next rule') is null"}
    rows = quality.judge(df, rules=rules, order=["all", "fatal"]).collect()
    assert {r.doc_id: (r.base_failed, r.rule, r.kept) for r in rows} == {1: (False, "all", False), 2: (True, None, False), 3: (True, None, False)}
    with pytest.raises(Exception, match="shown to the next rule"):
        quality.judge(df, rules=rules, order=["fatal", "all"]).collect()


def test_cascade_puts_cheap_rejections_first(spark):
    docs = spark.createDataFrame([(i, prose(random.Random(i), 300)) for i in range(400)], "doc_id bigint, text string")
    rules = {"costly": "length(regexp_replace(text, '(w[0-9]+ )+?(w[0-9]+)', '')) < 0", "most": "n_words > 1", "some": "doc_id % 4 = 0"}
    assert quality.cascade_order(docs, rules=rules) == ["most", "some", "costly"]


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, prose(rng, rng.choice((3, 20, 200, 700, 3000)), 5000)) for i in range(120)] + [(500, None)], "doc_id bigint, text string")
    rows = packing.pack(packing.pieces(df, BYTE)).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, text in df.collect():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        parts = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.start for r in parts] == list(np.cumsum([0, *[r.length for r in parts]])[:-1]) and sum(r.length for r in parts) == len(ids)
        assert all(r.length == 2048 for r in parts[1:]) and [r.piece for r in parts] == list(range(len(parts)))
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in parts)
    for s in by_seq.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == list(np.cumsum([0, *[r.length for r in s]])[:-1]) and sum(r.length for r in s) <= 2048
    total = sum(r.length for r in rows)
    assert len(by_seq) <= -(-total // 2048) + 1


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_everything(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice((2048, rng.randrange(1, 2049), rng.randrange(1, 60))) for _ in range(800))
    fill, seen = Counter(), Counter()
    for length, lo, hi, copies, first, offset in packing.plan(dict(counts)):
        for r in range(lo, hi):
            fill[first + (r - lo) // copies] += length
        seen[length] += hi - lo
    assert seen == counts and max(fill.values()) <= 2048
    assert len(fill) <= -(-sum(n * c for n, c in counts.items()) // 2048) + 2


def brute_components(texts, k, part=80, whole=100):
    sets = {}
    for i, t in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and whole * both >= part * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    texts, n = {}, 0
    for _ in range(12):
        base = prose(rng, rng.randrange(20, 120), 3000).split()
        for _ in range(rng.choice((1, 2, 3, 40))):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(9999)}"
            texts[n], n = " ".join(words), n + 1
    texts |= {n: None, n + 1: "", n + 2: "one two", n + 3: "One TWO"}
    df = common.stage(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), "docs")
    want = brute_components(texts, 4)
    for small in (16, 2):  # pair by pair, and in blocks
        monkeypatch.setattr(neardup, "SMALL", small)
        monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 512 if small == 16 else 8)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, k=4).collect()}
        assert got == want


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for bits in (0, 1, 3, 9, 15, 17, 32):
        for n in (1, 2, 59, 240, 1000):
            ids = rng.integers(0, 1 << bits, n, dtype=np.uint64)
            words, offsets = tokenfile.encode(ids)
            assert (tokenfile.decode(words, n) == ids).all()
            at = len(offsets) - 1  # a part of the block on its own
            assert (tokenfile.decode(words[at * tokenfile.OFFSET_WORDS :], n - int(offsets[at])) == ids[offsets[at] :]).all()


@pytest.mark.parametrize("kind", [np.uint16, np.uint32, np.uint64])
def test_each_word_takes_as_many_ids_as_fit(kind):
    rng = np.random.default_rng(2)
    for n in (1, 7, 8, 9, 239, 240, 241, 2000):
        ids = (rng.integers(0, 1 << 16, n) >> rng.integers(0, 40, n)).astype(kind)
        ids[::7] |= ids[::7] << kind(min(8 * ids.itemsize, 60) - 16)
        words, offsets = tokenfile.encode(ids)
        at, starts = 0, []
        for w in words.tolist():
            s = next(s for s, (count, bits) in enumerate(tokenfile.SELECTORS) if all(int(i) < 1 << bits for i in ids[at : at + count]))
            assert w >> 60 == s
            starts.append(at)
            at += tokenfile.SELECTORS[s][0]
        assert at >= n and offsets.tolist() == starts[:: tokenfile.OFFSET_WORDS]
        assert kind == np.uint64 or (tokenfile.decode(words, n) == ids).all()


def test_block_decodes_by_offsets():
    rng = np.random.default_rng(1)
    for n in (1, 240, 70_000):
        ids = (rng.integers(0, 49_000, n) >> rng.integers(0, 16, n)).astype(np.uint32)
        words, offsets = tokenfile.encode(ids)
        assert (tokenfile.decode_block(words, offsets, n) == ids).all() and (n < 70_000 or len(offsets) > tokenfile.STRIP)


def test_token_file(docs, spark):
    from tokenizers import Tokenizer

    tok, path, start = Tokenizer.from_file(WORD), common.shared_folder(spark) + "/ids", 0
    tokenfile.write_ids(docs, path, WORD)
    got = sorted(tokenfile.read_ids(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    want = Counter((r.doc_id, (*tok.encode(r.text or "", add_special_tokens=False).ids, 2)) for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    for r in got:
        assert (r.start, r.n_tokens) == (start, len(r.ids)) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += len(r.ids)


@pytest.mark.parametrize("path,keep", [(BYTE, True), (WORD, False)])
def test_chunks_encode_as_whole_texts(path, keep):
    rng = random.Random(8)
    alphabet = ["a", "The", "naïve", "İ", "'s", "don't", " ", "  ", "\n", "\n\n", "\t", " ", " ", "\x1c", "é", "é", "42", "3.5", "!!", "🙂", "<|endoftext|>", "Σ", "ς", "٣", "x_y"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(400)]
    coder = tokens.ChunkEncoder(path, keep)
    for t, ids in zip(texts, coder.many(texts), strict=True):
        assert ids.tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("path,keep", [(BYTE, True), (WORD, False)])
def test_new_chunks_are_encoded_in_lines(path, keep):
    """Few calls for many new chunks, with and without plain letters, and the ids of whole texts."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzßàéîõüÿ"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))
    texts = [" ".join(rng.choice((w, w.capitalize(), w.upper(), w + "ª")) for w in (word() for _ in range(200))) for _ in range(30)] + ["ﬁne Ωmega naïve", " a'll b's.c, d", "\u00a0x y\u2003z"]
    coder = tokens.ChunkEncoder(path, keep)
    whole = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    steps, calls, real = str(coder.tokenizer.pre_tokenizer) + str(coder.tokenizer.normalizer), [], coder.tokenizer

    class Counted:
        def __getattr__(self, name):
            return getattr(real, name)

        def __setattr__(self, name, value):
            calls.append(name)
            setattr(real, name, value)

        def encode_batch_fast(self, lines, **how):
            calls.extend(lines)
            return real.encode_batch_fast(lines, **how)

    coder.tokenizer = Counted()
    assert [ids.tolist() for ids in coder.many(texts)] == whole
    assert len(calls) < 300 and (keep or "normalizer" in calls)
    assert str(real.pre_tokenizer) + str(real.normalizer) == steps


def test_different_words_are_looked_up_once():
    """Repeated words stay in Arrow; ids, ends and the end id are those of whole texts, also as the memo starts over."""
    import pyarrow as pa

    rng = random.Random(10)
    alphabet = ["a", "The", "naïve", "NAÏVE", "İ", "'s", "don't", "word,", "word...", "(x)", " ", " ", "  ", "\n", "\t", "\r\x0b\x0c", "\u00a0", "\u2003", "\x85", "\x1c", "e\u0301", "H\u0331", "\u0301", "é", "42", "🙂", "<|endoftext|>", "Σ", "ς", "٣", "x_y", "ª"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(400)] + [None, "", " ", "\n", " a ", "É", "a" * 9]
    latin = [" ".join(rng.choice(("Wörter", "wörter,", "MANY", "many", "q.e.d.")) for _ in range(500)) for _ in range(40)]
    for memo in (tokens.MEMO, 3 * tokens.ENTRY):
        coder = tokens.ChunkEncoder(WORD, False, memo)
        asked, look_up = [], coder._look_up
        coder._look_up = lambda flat: asked.append(len(flat)) or look_up(flat)
        for some in (texts, latin, texts[:9], [None, " "], [], ["É"], [t for t in texts if t and t.isascii()]):
            for kind in (pa.string(), pa.large_string()):
                ids, ends = coder.together(pa.array(["cut off", *some, "too"], kind).slice(1, len(some)), 7)
                got = [own.tolist() for own in np.split(ids, ends[:-1])] if some else []
                assert got == [[*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 7] for t in some]
                assert len(ends) == len(some) and len(ids) == (ends[-1] if some else 0)
                assert some is not latin or asked[-1] < 20


def brute_base(text):
    def luhn(d):
        return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), k, n, m.end()) for k, (n, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0])]
    return ",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(found))


def test_pii_base_spans(spark):
    rng = random.Random(4)
    bits = ["a@b.co", "x.y+z@d-e.org", "@", "..", "1.2.3.4", "256.1.1.1", "10.0.0.300", "4539 1488 0343 6467", "4465758382889437", "+1 (286) 555-5136", "+12", "é🙂", " ", "foo", "@@a.b", "a@b.c@d.e", "0001.2.3.4.5", "-", "_", "\n"]
    texts = ["".join(rng.choice(bits) + rng.choice(("", " ", ", ")) for _ in range(rng.randrange(14))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in pii.find(df).select("doc_id", pii.listed(F.col("base_spans")).alias("s"), pii.redacted(F.col("text"), F.col("base_spans")).alias("clean")).collect():
        assert r.s == brute_base(texts[r.doc_id]), repr(texts[r.doc_id])
        assert brute_base(r.clean) == "" or "[" in r.clean


def test_pii_long_runs(spark):
    card = "4539 1488 0343 6467"
    texts = ["12 " * 20000 + "x " + card, "5-" * 20000 + "5, " + card, "q@a" + ".c" * 20000 + " " + card, "+1 " + "(2) " * 20000 + ", " + card, "1." * 20000 + " " + card]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in pii.find(df, model=pii.fit(df)).select("doc_id", pii.listed(F.col("base_spans")).alias("s"), pii.redacted(F.col("text"), F.col("base_spans")).alias("clean")).collect():
        assert r.s == brute_base(texts[r.doc_id]) and f"card:{len(texts[r.doc_id]) - 19}:" in r.s
        assert r.clean.endswith("[CARD]")


def test_pii_learns_secrets(spark):
    rng = random.Random(6)
    rows = [(i, f"{prose(rng, 30)} token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" {prose(rng, 9)}" if i % 3 == 0 else f"{prose(rng, 20)} Donaudampfschifffahrtsgesellschaft, {prose(rng, 5)}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in pii.find(df, model=pii.fit(df)).collect():
        assert len(r.all_spans) == (1 if r.doc_id % 3 == 0 else 0)


def brute_secrets(texts):
    """Accepted tokens by labelers, EM and naive Bayes worked row by row, with other means than the operator's."""
    key = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-")
    found = []
    for t in texts:
        at = 0
        while at < len(t):
            end = at
            while end < len(t) and t[end] in key:
                end += 1
            w = t[at:end]
            if len(w) >= 16 or re.fullmatch(r"\d{3}-\d\d-\d{4}|[A-Z]{2}\d\d[A-Z0-9]{11,30}", w):
                found.append((w, t[max(0, at - 24) : at], t[end : end + 24]))
            at = max(end, at + 1)
    lower, upper, digit = str.islower, str.isupper, str.isdigit

    def votes(w, b, a):
        shape = 1 if re.fullmatch("[0-9a-f]{24,}|[0-9A-F]{24,}|(sk|pk|ghp|AKIA|xox[a-z])[A-Za-z0-9_-]{12,}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", w) else -1 if w.isalpha() and lower(w) else 0
        prose = -1 if w.isalpha() and (lower(w[1:]) or upper(w)) else 0
        plain = -1 if re.search(r"[A-Za-z,.]\s$", b) and re.match(r"[,.]?\s[A-Za-z]", a) else 0
        mixed = 1 if any(map(digit, w)) and any(map(str.isalpha, w)) and not set(w) & set("-/") else 0
        single = -1 if len(set(w)) == 1 or not set(w) - set("-_+/") or (len(w) >= 16 and not set(w) - set("0123456789_+/-")) else 0
        return shape, int(bool(re.search(pii.ANNOUNCES, b))), prose, int(bool(re.search("[=:]\\s*[\"']?$", b))), plain, mixed, single

    def feats(w, b, a):
        near = lambda c: 0 if not c else 1 if c in "\"'`" else 2 if c.isspace() else 3 if c in "=:" else 4
        n = len(w)
        return (n >= 20) + (n >= 28) + (n >= 36) + (n >= 48), -(-4 * sum(map(digit, w)) // n), 2 * any(map(upper, w)) + any(map(lower, w)), min(len(set(w)) // 4, 5), near(b[-1:]), near(a[:1])

    v, f = [votes(*x) for x in found], [feats(*x) for x in found]
    post = [1 / (1 + np.exp(-1.5 * sum(x))) for x in v]
    for _ in range(pii.ROUNDS):
        yes = sum(post) + 1
        no = len(v) + 2 - yes
        p = [{u: 1 + sum(q for x, q in zip(v, post, strict=True) if x[j] == u) for u in (-1, 0, 1)} for j in range(7)]
        r = [{u: 1 + sum(1 - q for x, q in zip(v, post, strict=True) if x[j] == u) for u in (-1, 0, 1)} for j in range(7)]
        odds = [np.log(yes / no) + sum(np.log(p[j][u] / (yes + 2)) - np.log(r[j][u] / (no + 2)) for j, u in enumerate(x)) for x in v]
        post = [1 / (1 + np.exp(-np.clip(o, -30, 30))) for o in odds]
    private, size, kept = sum(post), len(v), []
    for x, (w, _, _) in zip(f, found, strict=True):
        score = np.log((private + 1) / (size - private + 1))
        for j, u in enumerate(x):
            values = len({y[j] for y in f})
            a, b = (sum(q if good else 1 - q for y, q in zip(f, post, strict=True) if y[j] == u) for good in (True, False))
            score += np.log((a + 0.5) / (private + 0.5 * values)) - np.log((b + 0.5) / (size - private + 0.5 * values))
        if score > 0:
            kept.append(w)
    return Counter(kept)


def test_pii_learned_spans_match_brute_force(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    makers = (lambda: f'token = "{hashlib.sha1(str(rng.random()).encode()).hexdigest()}"', lambda: f"password: {word(9)}{rng.randrange(10**9)}X_z", lambda: f"see {word(22)}, then", lambda: f"{word(8).upper()}{word(12).upper()} was", lambda: "-" * 30, lambda: f"id {rng.randrange(100, 999)}-12-{rng.randrange(1000, 9999)} of", lambda: f"a/{word(9)}/{word(9)}/b", lambda: str(rng.randrange(10**17, 10**18)), lambda: f"DE44{rng.randrange(10**14, 10**15)}")
    texts = [" ".join(x for _ in range(rng.randrange(1, 4)) for x in (prose(rng, 6), rng.choice(makers)())) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = Counter()
    for r in pii.find(df, model=pii.fit(df)).collect():
        got.update(r.text[s.start : s.end] for s in r.all_spans if pii.KINDS[s.kind] == "secret")
    fixed = [r.text[s.start : s.end] for r in pii.find(df).collect() for s in r.base_spans]
    want = brute_secrets(texts)
    for w in fixed:
        want.pop(w, None)
    assert got == want and sum(got.values()) > 50


def brute_contamination(doc, item, weights, k=5):
    """(similarity, start) of the best window of the item's size."""
    d, w = doc.lower().split(), item.lower().split()
    grams = lambda x: [tuple(x[i : i + k]) for i in range(max(1, len(x) - k + 1))] if x else []
    own, there, span, best = set(grams(w)), grams(d), max(1, len(w) - k + 1), (0.0, 0)
    for s in range(max(1, len(there) - span + 1)):
        win = set(there[s : s + span])
        both = own & win
        best = max(best, (round(sum(weights[g] for g in both) / (sum(weights[g] for g in own) + len(win - own)), 9), -s))
    return best


def test_decontamination_matches_brute_force(spark):
    """Substitutions, insertions, deletions and shared light shingles, near the threshold; every match must be found."""
    rng = random.Random(7)
    common = prose(rng, 14, 2000)
    items = {i: prose(rng, rng.randrange(15, 60), 2000) + (f" {common}" if i < 6 else "") for i in range(14)} | {20: "Tiny one", 21: None, 22: " ", 23: prose(random.Random(99), 8)}
    docs = {}
    for i in range(420):
        w = items[i % 14].split()
        for _ in range(i // 140):
            at = rng.randrange(len(w))
            if i % 3 == 0:
                w[at] = "other"
            elif i % 3 == 1:
                w.insert(at, "added")
            else:
                del w[at]
        docs[i] = " ".join([prose(rng, rng.randrange(60), 2000), *(w if i % 11 else w[: len(w) // 2]), prose(rng, rng.randrange(60), 2000)])
    docs |= {900: "TINY One", 901: None, 902: "", 903: items[1] + " " + items[2] + " " + items[1], 904: " ".join(items[0].split()[:-1]), 905: common, 906: "a " * 5000}
    usable = {i: t for i, t in items.items() if t and t.split()}
    sets = {i: {tuple(t.lower().split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for i, t in usable.items()}
    holders = Counter(g for s in sets.values() for g in s)
    weights = {g: np.log1p(len(usable) / f) / np.log1p(len(usable)) for g, f in holders.items()}
    want = {(d, i): brute_contamination(t, x, weights) for d, t in docs.items() if t for i, x in usable.items()}
    want = {key: v for key, v in want.items() if v[0] >= 0.8 - 1e-9}
    frame = lambda rows, names: spark.createDataFrame(list(rows.items()), names).withColumns({"h": F.lit(1), "dk": F.lit("x"), "hits": F.lit(2)})
    rows = decontam.contaminated(frame(docs, "doc_id bigint, text string"), frame(items, "item_id bigint, text string")).collect()
    got = {(r.doc_id, r.item_id): (r.similarity, -r.start_word) for r in rows}
    assert len(rows) == len(got) and set(got) == set(want) and len(want) > 150
    assert all(got[key] == (pytest.approx(want[key][0], abs=1e-6), want[key][1]) for key in want)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = docs.join(hyperdim.op8_language_id(spark, "/root/testdata/sf0.001"), "doc_id").filter("held_out")
    assert out.filter("lang = lang_pred").count() >= 0.97 * out.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34")], "doc_id bigint, text string")
    protos = hyperdim.prototypes(docs, "text", "lang")
    assert {(r.lang_pred, r.score) for r in hyperdim.identify(odd, protos).collect()} == {("und", 0.0)}


@pytest.mark.parametrize("hot", [4, 1 << 16])
def test_lm_word_scores_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(lmscore, "HOT", hot)
    rng = random.Random(12)
    texts = [prose(rng, rng.randrange(1, 60), 30) for _ in range(80)] + ["The the  THE\tword"] * 3 + [None, "", " \n", "alone"]
    rows = [(None if i == 7 else i // 2, t, i % 3 == 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, is_target boolean").repartition(3)
    words = [(t or "").lower().split() for t in texts]
    pairs = [list(zip([None, *w], w)) for w in words]  # noqa: B905
    size = len({x for w in words for x in w})
    scale = sum(len(w) for w, r in zip(words, rows, strict=True) if r[2]) / sum(map(len, words))

    def loss(ps, held, by):
        """Mean loss under the counts of ``held`` pair lists."""
        two = Counter(p for q in held for p in q)
        one, m = Counter(v for v, _ in two.elements()), lmscore.SMOOTHING
        return round(float(np.mean([-np.log((two[p] * by + m / size) / (one[p[0]] * by + m)) for p in ps])), 6)

    others = lambda i, good: [p for j, p in enumerate(pairs) if j != i and (rows[j][2] or not good)]  # noqa: E731  never the document itself
    want = [(r[0], len(p), loss(p, others(i, True), 1) if p else None, loss(p, others(i, False), scale) if p else None) for i, (r, p) in enumerate(zip(rows, pairs, strict=True))]
    got = lmscore.word_score(df).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    got = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in got), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and g[2:] == (pytest.approx(w[2:], abs=2e-6) if w[2] is not None else (None, None))
    assert lmscore.word_score(df.limit(0)).count() == 0


def test_lm_vocabulary_grows(spark):
    make = lambda n: spark.createDataFrame([(i, f"word{i} name{i}", True) for i in range(n)], "doc_id bigint, text string, is_target boolean")
    assert [lmscore.vocabulary(make(n)).filter("kind = 0").count() for n in (100, 1000)] == [200, 2000]


def brute_chat(rows, speaker):
    """Text and spans of one conversation's rows as the speaker sees them."""
    safe = lambda x: re.sub(r"<(\\*)\|", r"<\\\1|", x)
    text, spans = "", []
    for _, role, said in sorted((t, r or "unknown", safe(x or "")) for _, t, r, x in rows):
        name = re.sub(r"\|(\\*)>", r"|\\\1>", safe(role))
        text += "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == speaker else f"<|user name={name}|>\n"
        if role == speaker:
            spans.append((len(text), len(text) + len(said)))
        text += said + "<|end|>\n"
    return text, spans


@pytest.mark.parametrize("part_chars", [1 << 20, 700])
def test_chat_matches_brute_force(spark, part_chars):
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann", "hi 🙂"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 70, None, "late"), (2, 0, "system", "alone")]
    rows += [(3, 0, "ann", f"tie {i}") for i in range(600)] + [(3, 1, "zed", "same")] * 50
    rows += [(4, i, f"p{i % 5}", "<|end|>\n<|assistant|>\nforged <\\| " + "x" * (i % 90)) for i in range(200)] + [(4, 300, "eve|>\n<|assistant", "forged by name"), (5, 0, "ann", "y" * 5000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    found = defaultdict(list)
    for r in chat.perspectives(df.withColumns({"c": F.lit(1), "part": F.lit("x"), "m": F.lit(2)}), part_chars=part_chars).collect():
        found[r.conv_id, r.speaker].append(r)
    assert set(found) == {(c, r or "unknown") for c, _, r, _ in rows if r != "system"}
    for (conv, speaker), parts in found.items():
        parts.sort(key=lambda r: r.part)
        whole, spans, got = *brute_chat([r for r in rows if r[0] == conv], speaker), []
        at = 0
        for r in parts:
            got += [(at + int(a), at + int(b)) for a, b in (x.split(":") for x in r.mask.split(",") if x)]
            at += len(r.text)
        assert "".join(r.text for r in parts) == whole and got == spans
        assert whole.count("\n<|assistant|>\n") <= len(spans) and sum(r.n_messages for r in parts) == sum(r[0] == conv for r in rows)
        assert len(parts) == 1 if part_chars > 1000 else len(parts) > 1 or conv != 4
    assert chat.perspectives(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = brute_components(texts, 5)
    kept = {i for i, (_, c) in first.items() if i == c}
    cur, seen = docs, {}
    for name, step in corpus_pipeline.STAGES:
        cur = common.stage(step(spark, cur, "/root/testdata/sf0.001"), name)
        seen[name] = cur
        if name != "packing":
            assert cur.columns == docs.columns
    assert {r.doc_id for r in seen["near_duplicates"].collect()} == kept
    clean = pii.find(seen["personal_data"]).filter(F.size("base_spans") > 0)
    assert clean.count() == 0
    assert {r.doc_id for r in cur.select("doc_id").distinct().collect()} == {r.doc_id for r in seen["personal_data"].collect()}
