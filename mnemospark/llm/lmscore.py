"""Cross-entropy difference between matched n-gram models of target and background text.

op9_lm_score uses word bigrams over one vocabulary, the words of all documents (``word_score``). The
target model is counted over the documents marked as good and the background model over all documents,
its counts scaled to the target's total so that both are smoothed alike. No document is scored by a model that has
counted it: its own counts are taken out of both models first. A document's score is its mean loss per word under the
target model minus that under the background model: the smaller, the closer to the target. Words and bigrams are told apart by 64-bit hashes (bigrams by 53 bits at least).

Defined results: null and empty texts have no tokens and null losses and score. Without target
documents the target model is uniform. A document repeated in the labels counts once; repeated rows
get equal results. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if_small, released, stage, words_of

SMOOTHING = 8.0
HOT = 1 << 16  # a gram with a share of 1 / HOT of all words is kept out of the buckets
BUCKETS, BUCKET_BYTES = 256, 4 << 20  # buckets at least, and text a bucket; never more sums leave than grams came
MIX, FIRST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)
WORDS = 1 << 18  # words handled at once, which bounds a worker's memory
_PLACED = "bucket int, base bigint, code binary, gap binary, n binary, target binary, sums binary, id binary"


def word_hashes(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs`` as columns ``keep`` and h, the 64-bit hashes of the words of the lower-cased text in order; empty for null."""
    words = F.transform(words_of(F.lower("text")), lambda w: F.xxhash64(w))
    return docs.select(*keep, F.coalesce(words, F.array().cast("array<bigint>")).alias("h"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about WORDS words; a longer text is a slice of its own."""
    for batch in batches:
        ends = batch.column("h").offsets.to_numpy().astype(np.int64)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + WORDS, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _grams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, context codes (even), bigram codes (odd) and the place in the batch of every word."""
    column = batch.column("h")
    ends = column.offsets.to_numpy().astype(np.int64)
    word = column.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64)
    before = np.roll(word, 1)
    lengths = np.diff(ends)
    before[(ends[:-1] - ends[0])[lengths > 0]] = FIRST
    one = lambda x: (x ^ (x >> np.uint64(31))) * MIX
    context = one(before)
    pair = one(context ^ (word >> np.uint64(1)) ^ (word << np.uint64(63)))
    return word, context & ~np.uint64(1), pair | np.uint64(1), np.repeat(np.arange(len(lengths)), lengths)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(kind, code, n): all words (kind 0), and as kinds 1 and 2 contexts and bigrams that a batch finds often."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            for kind, codes in enumerate(_grams(batch)[:3]):
                code, n = np.unique(codes, return_counts=True)
                if kind:
                    often = n >= max(8, len(codes) / HOT)
                    code, n = code[often], n[often]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), kind, np.int32)), pa.array(code.view(np.int64)), pa.array(n)], names=["kind", "code", "n"])

    return word_hashes(docs).mapInArrow(tally, "kind int, code bigint, n bigint").groupBy("kind", "code").agg(F.sum("n").alias("n"))


def _count_hot(docs: DataFrame, hot: np.ndarray) -> tuple[np.ndarray, int]:
    """Counts of the sorted codes ``hot`` in all and in target documents, shape (2, n), and the words of the target."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, words = np.zeros((2, len(hot)), np.int64), 0
        for batch in _pieces(batches):
            _, context, pair, place = _grams(batch)
            target = batch.column("is_target").to_numpy(zero_copy_only=False)[place]
            words += int(target.sum())
            for codes in (context, pair):
                at, held = _find(hot, codes)
                sums[0] += np.bincount(at[held], minlength=len(hot))
                sums[1] += np.bincount(at[held & target], minlength=len(hot))
        seen = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(sums[0][seen], 0)), pa.array(np.append(sums[1][seen], words))], names=["at", "n", "t"])

    out, words = np.zeros((2, len(hot)), np.int64), 0
    for at, n, t in word_hashes(docs, "is_target").mapInArrow(tally, "at bigint, n bigint, t bigint").groupBy("at").agg(F.sum("n"), F.sum("t")).collect():  # at most 5 HOT rows
        if at < 0:
            words = t
        else:
            out[:, at] = n, t
    return out, words


def _find(hot: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each code in ``hot``, and whether it is there."""
    at = np.minimum(np.searchsorted(hot, codes), len(hot) - 1)
    return at, hot[at] == codes


def _terms(odd: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Part of the loss that each gram adds: a bigram -log(n + m / V), its context log(n + m)."""
    return np.where(odd, -1.0, 1.0) * np.log(counts + np.where(odd, SMOOTHING / size, SMOOTHING))


def _distinct(code: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of code and row, sorted by row and code, and how often each occurs."""
    order = np.lexsort((code, where))
    code, where = code[order], where[order]
    first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (where[1:] != where[:-1])))[: len(code)]
    return code[first], where[first], np.diff(np.append(first, len(code)))


def word_score(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of ``docs`` with columns doc_id, text and is_target.

    p(w | v) = (n(v, w) + m / V) / (n(v) + m) over the V words of all documents. Each document's distinct
    contexts and bigrams are dealt by hash to buckets, where all holders of a gram meet: they are counted and, each
    without its own part, rated there, and only sums by document leave. The few grams with many holders (at most 5 HOT, by their
    share of all words) are counted beforehand and rated where the document is read.
    """
    found = stage(vocabulary(bounded_batches(docs)), "vocabulary")
    total, size = found.filter("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    size = max(1, size)
    common = found.filter((F.col("kind") > 0) & (F.col("n") >= max(1, total / HOT / 2))).select("code")
    hot = np.unique(np.array([0] + [r.code for r in common.collect()], np.int64).view(np.uint64))
    counts, of_target = _count_hot(docs, hot)
    scale = of_target / max(1, total)
    odd = (hot & np.uint64(1)) == 1
    octets = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(1 << 16, max(BUCKETS, octets // BUCKET_BYTES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(released(batches)):
            _, context, pair, place = _grams(batch)
            rows = batch.column("row").to_numpy()
            target = batch.column("is_target").to_numpy(zero_copy_only=False)
            sums = np.zeros((3, batch.num_rows))
            sums[0] = np.bincount(place, minlength=batch.num_rows)
            code, where, n = _distinct(np.concatenate([context, pair]), np.concatenate([place, place]))
            at, held = _find(hot, code)
            at, who, own = at[held], where[held], n[held]
            sums[1] = np.bincount(who, own * _terms(odd[at], counts[1][at] - own * target[who], size), minlength=batch.num_rows)
            sums[2] = np.bincount(who, own * _terms(odd[at], (counts[0][at] - own) * scale, size), minlength=batch.num_rows)
            ids = batch.column("doc_id")
            no = np.asarray(ids.is_null())
            head = [rows.tobytes(), sums.tobytes(), np.stack([np.where(no, 0, ids.fill_null(0).to_numpy()), no]).astype(np.int64).tobytes()]
            out = [(int(rows[0] % buckets), 0, head[0], b"", b"", b"", head[1], head[2])]
            code, where, n = code[~held], where[~held], n[~held]
            bucket = ((code >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            code, where, n, bucket = code[order], where[order], n[order], bucket[order]
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in range(buckets):
                lo, hi = edges[b], edges[b + 1]
                if lo < hi:
                    r = rows[where[lo:hi]]
                    raw = code[lo:hi].view(np.uint8).reshape(-1, 8)
                    out.append((b, int(r[0]), np.ascontiguousarray(raw[:, :6]).tobytes(), np.diff(r, prepend=r[0]).astype(np.uint32).tobytes(), n[lo:hi].astype(np.uint32).tobytes(), np.packbits(target[where[lo:hi]]).tobytes(), b"", b""))
            for at in range(0, len(out), 64):
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out[at : at + 64]], schema=schema)

    names = [x.split()[0] for x in _PLACED.split(", ")]
    schema = pa.schema([(x.split()[0], {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in _PLACED.split(", ")])

    def rate(table: pa.Table) -> pa.Table:
        codes, places, ns, goods, row, sums, ids, nulls = [], [], [], [], [], [], [], []
        for x in table.to_pylist():
            if x["sums"]:
                row.append(np.frombuffer(x["code"], np.int64))
                sums.append(np.frombuffer(x["sums"]).reshape(3, -1))
                i = np.frombuffer(x["id"], np.int64).reshape(2, -1)
                ids.append(i[0])
                nulls.append(i[1] == 1)
                continue
            raw = np.frombuffer(x["code"], np.uint8).reshape(-1, 6)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :6] = raw
            codes.append(wide.view(np.uint64).ravel())
            places.append(x["base"] + np.cumsum(np.frombuffer(x["gap"], np.uint32).astype(np.int64)))
            ns.append(np.frombuffer(x["n"], np.uint32).astype(np.float64))
            goods.append(np.unpackbits(np.frombuffer(x["target"], np.uint8), count=len(raw)))
        if codes:
            n = np.concatenate(ns)
            own, at = np.unique(np.concatenate(codes), return_inverse=True)
            odd = ((own & np.uint64(1)) == 1)[at]
            mine = n * np.concatenate(goods)
            every, good = np.bincount(at, n)[at] - n, np.bincount(at, mine)[at] - mine
            held, to = np.unique(np.concatenate(places), return_inverse=True)
            row.append(held)
            sums.append(np.stack([np.zeros(len(held)), np.bincount(to, n * _terms(odd, good, size)), np.bincount(to, n * _terms(odd, every * scale, size))]))
            ids.append(np.zeros(len(held), np.int64))
            nulls.append(np.ones(len(held), bool))
        s = np.concatenate(sums, axis=1)
        return pa.table({"row": np.concatenate(row), "id": pa.array(np.concatenate(ids), mask=np.concatenate(nulls)), "n": s[0].astype(np.int64), "t": s[1], "b": s[2]})

    marked = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "is_target", "text")
    dealt = word_hashes(marked, "row", "doc_id", "is_target").mapInArrow(deal, _PLACED)
    parts = dealt.groupBy("bucket").applyInArrow(rate, "row bigint, id bigint, n bigint, t double, b double")
    whole = parts.groupBy("row").agg(F.max("id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sum("t").alias("t"), F.sum("b").alias("b"))
    mean = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens"))
    return whole.select("doc_id", "n_tokens", mean("t").alias("target_loss"), mean("b").alias("background_loss"), (mean("t") - mean("b")).alias("score"))


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document; documents labelled as good are the target."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id").distinct().withColumn("is_target", F.lit(True))
    marked = docs.select("doc_id", "text").join(broadcast_if_small(good, 16), "doc_id", "left").select("doc_id", "text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    return word_score(marked)
