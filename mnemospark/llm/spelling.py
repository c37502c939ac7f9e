"""Grouping spelling variants: words at edit distance one, found by asymmetric chunks.

Each word counts its occurrences; two words are near if exactly one inserted, deleted or replaced code point tells them apart. A
word is paired as the shorter side with words of its own length or one code point longer. The shorter side contributes
two disjoint chunks, its halves, with their places; the other side contributes its positional grams of
those lengths: of all grams only those within shift one of a chunk's place can meet one, and an edit
behind a chunk shifts it by nothing, one before it by the difference of lengths. One edit spares one of two halves, so every near pair
shares a chunk; equal chunks are joined and the pairs verified by edit distance.

A chunk that very many words share isn't joined: the part of the word beside it holds the edit, and is halved
again by the same rule, until a chunk has few words or the open part is one code point, where all
that meet are near (so their number is bounded by the letters). A pair is taken from the part in which its first difference
lies, so each is found once. No pair is lost and none is listed to be counted later: rows of a chunk make at most
``CROWD`` candidates each on average.

Defined results: a null text has no words; a null id draws no deletion. Copies of rows count each time they occur. An empty table, or one
without words of enough letters, gives no rows. Other columns are not read. Texts are cut at places without letters, so no
text is too long; a word of any length is one string.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, released, slices, stage, unstage

LEAST_LETTERS = 7
LEAST_COUNT = 2
RATIO = 10
CROWD = 64
#: One in so many runs loses a code point, so that variants exist to be found.
THIN = 31
#: A task holds the counts of about this many words before it hands them on.
HELD = 200_000
PIECE = 1 << 20
_RUN = re.compile("[a-zÀ-ÿ]+")
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about a million code points, cut where no letter stands."""
    at = 0
    while at < len(text):
        cut = _OTHER.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def varied(key: str | None, run: str, thin: int) -> str:
    """The run, or without one of its code points if the draw for this document and run says so."""
    if key is None:
        return run
    draw = zlib.crc32(f"{key}:{run}".encode())
    at = draw % len(run)
    return run if draw % thin else run[:at] + run[at + 1 :]


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thin: int = THIN, letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, n) of all words with enough letters, lower-cased A-Z, one in ``thin`` runs of a document thinned."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for part in slices(batch, 1):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for piece in _pieces(text):
                        # lower() of bytes changes A-Z only
                        for run, n in Counter(_RUN.findall(piece.encode().lower().decode())).items():
                            if len(run) >= letters:
                                total[varied(key, run, thin)] += n
                    if len(total) >= HELD:
                        yield told()
        yield told()

    texts = docs.select(F.col(f"`{id_col}`").cast("string").alias("key"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")
    partial = texts.mapInArrow(lambda batches: released(count(batches)), "word string, n bigint")
    return partial.filter(F.length("word") >= letters).groupBy("word").agg(F.sum("n").alias("n"))


def _outside(word: Column, start: Column, stop: Column) -> tuple[Column, Column]:
    """The word before ``start`` and from ``stop`` on, counted from 0."""
    return F.substring(word, F.lit(1), start), F.substring(word, stop + 1, F.length(word))


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the hash of what stands outside the open part [start, stop): the same for both sides of a near pair whose edit lies in it.

    ``long`` is the shorter word's length and ``shift`` the number of code points that this side has more.
    """
    before, behind = _outside(F.col("word"), F.col("start"), F.col("stop") + F.col("shift"))
    return rows.withColumn("chunk", F.xxhash64("long", "start", "stop", before, behind))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice, with either half of its open part closed."""
    middle = F.floor((F.col("start") + F.col("stop")) / 2).cast("int")
    halves = F.array(F.struct(F.col("start").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("stop").alias("b")))
    parts = rows.withColumn("half", F.explode(halves))
    return _keyed(parts.withColumns({"start": F.col("half.a"), "stop": F.col("half.b")}).select("word", "n", "short", "long", "shift", "start", "stop"))


def _sides(words: DataFrame) -> DataFrame:
    """Every word as the shorter side, and as the other one for shorter words of its length and of one code point less, all of it open."""
    size = F.length("word")
    side = lambda short, long, shift: F.struct(F.lit(short).alias("short"), long.alias("long"), F.lit(shift).alias("shift"))
    rows = words.select("word", "n", F.explode(F.array(side(True, size, 0), side(False, size, 0), side(False, size - 1, 1))).alias("s"))
    return rows.select("word", "n", "s.*", F.lit(0).alias("start"), F.col("s.long").alias("stop"))


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, n_a, b, n_b): each near pair of ``words`` (word, n; distinct) once."""
    rows, found = stage(_halved(_sides(words)), "chunks"), None
    while True:
        sizes = rows.groupBy("chunk").agg(F.count_if("short").alias("x"), F.count_if(~F.col("short")).alias("y"), F.max(F.col("stop") - F.col("start")).alias("open"))
        # a crowded chunk has more than `crowd` rows, so there are far fewer of these than rows
        crowded = broadcast_if_small(sizes.filter((F.col("x") * F.col("y") > crowd * (F.col("x") + F.col("y"))) & (F.col("open") > 1)).select("chunk"), 16)
        last = crowded.isEmpty()
        few = rows if last else rows.join(crowded, "chunk", "left_anti")
        a = few.filter("short").select("chunk", F.col("word").alias("a"), F.col("n").alias("n_a"), "stop", "long")
        b = few.filter("not short").select("chunk", F.col("word").alias("b"), F.col("n").alias("n_b"), "shift")
        first = (F.col("stop") == F.col("long")) | (F.substring("a", F.lit(1), F.col("stop")) != F.substring("b", F.lit(1), F.col("stop")))
        met = a.join(b, "chunk").filter((F.col("shift") == 1) | (F.col("a") < F.col("b"))).filter(first & (F.levenshtein("a", "b", 1) == 1))
        met = stage(met.select("a", "n_a", "b", "n_b"), "pairs")
        found = met if found is None else found.unionByName(met)
        if last:
            unstage(rows)
            return found
        before, rows = rows, stage(_halved(rows.join(crowded, "chunk", "left_semi")), "chunks")
        unstage(before, crowded)


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all ``words``: a word's form is its near word of largest n, if that is ``ratio`` times its own."""
    both = near_pairs(words).select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n")))).alias("e"))
    best = both.groupBy("e.word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("e.n")).alias("less"), F.col("e.near").alias("near"))).alias("top"))
    enough = -F.col("top.less") >= F.col("n") * ratio
    formed = stage(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("top.near")).alias("form"), F.when(enough, -F.col("top.less")).alias("form_n")), "forms")
    # a form has ratio times the count, so chains are short; each round doubles what they span
    links = stage(formed.filter("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        step = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if links.join(step, "root", "left_semi").isEmpty():
            break
        before, links = links, stage(links.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "links")
        unstage(before)
    return formed.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """Words of all documents with their forms and roots."""
    words = stage(counted(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter(F.col("n") >= LEAST_COUNT), "words")
    return grouped(words).select("word", "form", "root", "n", "n_near", "form_n")
