"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

Texts are lower-cased and cut into words; an item's shingles are its distinct k-word runs (a shorter
item is one shingle). A document is compared with an item through its windows of as many words as the item
has (a shorter document is one window). A shingle weighs ln(1 + N / f), where f of the N distinct items hold it, divided
by the largest such weight; a shingle that the item lacks weighs 1. The similarity is the weight of the shingles in
both over that of the shingles in either. The steps:

1. Windows. A match at threshold t needs t times the weight of the item's shingles, and none weighs more than 1; so
   windows with fewer shingles from items of their size than t times the least weight of such an item match
   none of them and are not fingerprinted. Nothing else is left out.
2. SimHash. A window's 64-bit fingerprint is the sign of the weighted sum of its shingles' bits. Windows meet
   items of their size by multi-index Hamming join: 8 blocks of 8 bits, each indexed for the items under
   all values with at most two errors. Fingerprints within RADIUS = 23 bits have a block with at most two errors (three in
   each of eight were 24), so the join finds all of them.
3. The exact weighted similarity confirms what is left.

The fingerprints' distance at similarity 0.8 has mean 10 and deviation 3 of 64, so a match falls outside the radius with a
probability of about 1e-5; that is the method's only loss.

Defined results: null or empty texts match nothing; items without words are skipped; items with equal
words count as the one with the smallest id; repeated rows give one result; the best window of a document
and item counts, the first one on ties. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, let, shingle_hashes, stage, words_of

K = 5
THRESHOLD = 0.8
BLOCKS, BLOCK_ERRORS = 8, 2
WIDTH = 64 // BLOCKS
RADIUS = BLOCKS * (BLOCK_ERRORS + 1) - 1


def simhash(shingles: Column) -> Column:
    """64-bit SimHash of an array of structs h (64-bit hash) and weight."""

    def bit(i: Column) -> Column:
        votes = F.aggregate(shingles, F.lit(0.0), lambda n, s: n + s["weight"] * (F.getbit(s["h"], i) * 2 - 1))
        return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def _block(value: Column, number: Column) -> Column:
    """Bits of one block of a fingerprint."""
    return F.call_function("shiftrightunsigned", value, number * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))


def item_index(items: DataFrame, id_col: str, text_col: str, k: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items with their shingles; Hamming index of their fingerprints; shingles with the sizes of the items that hold them."""
    worded = items.select(F.col(id_col).alias("item_id"), words_of(F.lower(text_col)).alias("w")).filter("size(w) > 0")
    worded = worded.groupBy("w").agg(F.min("item_id").alias("item_id"))
    placed = worded.select("item_id", F.size("w").alias("n_words"), F.explode(shingle_hashes(F.col("w"), k)).alias("h")).distinct()
    total = worded.count()
    held = placed.groupBy("h").agg(F.count(F.lit(1)).alias("f"))
    weight = F.log1p(F.lit(float(total)) / F.col("f")) / F.lit(math.log1p(max(total, 1)))
    weighed = stage(placed.join(held, "h").withColumn("weight", weight), "item_shingles")
    entries = weighed.groupBy("item_id").agg(F.first("n_words").alias("n_words"), F.sum("weight").alias("total"), F.sort_array(F.collect_list(F.struct("h", "weight"))).alias("s"))
    entries = stage(entries.withColumn("item_hash", simhash(F.col("s"))), "items")
    masks = [sum(1 << b for b in bits) for n in range(BLOCK_ERRORS + 1) for bits in combinations(range(WIDTH), n)]
    near = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda b: F.transform(F.array(*map(F.lit, masks)), lambda m: F.struct(b.alias("block"), _block(F.col("item_hash"), b).bitwiseXOR(m).alias("value")))))
    index = entries.select("item_id", "n_words", "item_hash", F.explode(near).alias("key")).select("item_id", "n_words", "item_hash", "key.block", "key.value")
    least = entries.groupBy("n_words").agg(F.greatest(F.ceil(F.min("total") * threshold - 1e-9), F.lit(1)).cast("int").alias("least"))
    sizes = weighed.select("h", "weight", "n_words").distinct().join(least, "n_words").groupBy("h").agg(F.first("weight").alias("weight"), F.collect_list(F.struct("n_words", "least")).alias("sizes"))
    return entries, index, sizes


def _window_starts(hits: Column, n_words: Column, least: Column, shingles: Column, k: int) -> Column:
    """First shingle of every window of a size that holds at least ``least`` of the sorted ``hits`` (structs with place)."""
    span, last = F.greatest(n_words - (k - 1), F.lit(1)), F.greatest(shingles - F.greatest(n_words - (k - 1), F.lit(1)), F.lit(0))

    def runs(hs: Column) -> Column:
        def starts(i: Column) -> Column:
            low = F.greatest(F.get(hs, i + least - 1)["place"] - span + 1, F.lit(0))
            high = F.least(F.get(hs, i)["place"], last)
            return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size(hs) - least), starts)))

    return F.when(F.size(hits) >= least, let(hits, runs)).otherwise(F.array().cast("array<int>"))


def _hits_before(hits: str, shingles: Column) -> Column:
    """For each place from 0 to ``shingles``: the number of the sorted hits before it, so that a window's hits are a slice."""
    place = lambda i: F.get(hits, i)["place"]
    upto = F.transform(F.sequence(F.lit(0), F.size(hits) - 1), lambda i: F.array_repeat(i, F.when(i > 0, place(i) - place(i - 1)).otherwise(place(i) + 1)))
    return F.flatten(F.concat(upto, F.array(F.array_repeat(F.size(hits), shingles - place(F.size(hits) - 1)))))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, item_id, similarity, start_word, n_words): the best window of each document and item that match."""
    entries, index, sizes = item_index(items, item_id, item_text, k, threshold)
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("body")).filter("body is not null")
    hashes = let(words_of(F.lower("body")), lambda w: shingle_hashes(w, k))
    key = F.xxhash64("doc", "body")
    spots = docs.select(key.alias("dk"), hashes.alias("hs")).select("dk", F.size("hs").alias("shingles"), F.posexplode("hs").alias("place", "h"))
    hits = spots.join(broadcast_if_small(sizes, 64 + 24 * F.size("sizes")), "h").select("dk", "shingles", F.explode("sizes").alias("size"), F.struct("place", "h", "weight").alias("hit"))
    # at most one entry for each word of the document and size of an item that holds its shingle
    sized = hits.groupBy("dk", "size.n_words", "size.least").agg(F.first("shingles").alias("shingles"), F.array_sort(F.collect_set("hit")).alias("hits"))
    sized = sized.withColumn("starts", _window_starts(F.col("hits"), F.col("n_words"), F.col("least"), F.col("shingles"), k)).filter("size(starts) > 0")
    sized = stage(sized.select("dk", "n_words", "hits", "starts"), "windows")

    def window(hs: Column) -> Column:
        """Distinct shingles with their weights of each window."""
        span = F.greatest(F.col("n_words") - (k - 1), F.lit(1))

        def one(start: Column, earlier: Column) -> Column:
            first = F.get(earlier, start)
            inside = F.slice("hits", first + 1, F.get(earlier, F.least(start + span, F.size(hs))) - first)
            known = F.array_distinct(F.transform(inside, lambda x: F.struct(x["h"].alias("h"), x["weight"].alias("weight"))))
            every = F.slice(hs, start + 1, F.least(span, F.size(hs) - start))
            other = let(known, lambda kn: F.concat(kn, F.transform(F.array_except(every, F.transform(kn, lambda x: x["h"])), lambda h: F.struct(h.alias("h"), F.lit(1.0).alias("weight")))))
            return let(other, lambda own: F.struct(start.alias("start"), own.alias("own"), simhash(own).alias("hash")))

        return let(_hits_before("hits", F.size(hs)), lambda earlier: F.transform("starts", lambda start: one(start, earlier)))

    # only documents with such windows are moved to them
    chosen = docs.withColumn("dk", key).join(broadcast_if_small(sized.select("dk").distinct(), 8), "dk", "left_semi")
    windows = chosen.join(sized, "dk").select("doc", "n_words", F.explode(let(hashes, window)).alias("win")).select("doc", "n_words", "win.*")
    blocks = F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda b: F.struct(b.alias("block"), _block(F.col("hash"), b).alias("value")))
    met = windows.withColumn("key", F.explode(blocks)).withColumns({"block": F.col("key.block"), "value": F.col("key.value")}).join(broadcast_if_small(index, 48), ["n_words", "block", "value"])
    # a pair counts once, where its first block with few errors meets, and only within the radius
    differs = F.col("hash").bitwiseXOR(F.col("item_hash"))
    earlier = F.exists(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda b: (b < F.col("block")) & (F.bit_count(_block(differs, b)) <= BLOCK_ERRORS))
    met = met.filter((F.bit_count(differs) <= RADIUS) & ~earlier).select("doc", "item_id", "n_words", "start", "own")
    met = met.join(broadcast_if_small(entries.select("item_id", "s", "total"), 64 + 32 * F.size("s")), "item_id")

    both = F.aggregate(F.filter("s", lambda e: F.array_contains(F.transform("own", lambda o: o["h"]), e["h"])), F.struct(F.lit(0.0).alias("w"), F.lit(0).alias("n")), lambda a, e: F.struct((a["w"] + e["weight"]).alias("w"), (a["n"] + 1).alias("n")))
    similar = F.round(let(both, lambda b: b["w"] / (F.col("total") + F.size("own") - b["n"])), 9)
    scored = met.select("doc", "item_id", "n_words", "start", similar.alias("similarity")).filter(F.col("similarity") >= threshold - 1e-9)
    best = scored.groupBy("doc", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("b"), F.first("n_words").alias("n_words"))
    return best.select(F.col("doc").alias(id_col), "item_id", F.round("b.similarity", 6).alias("similarity"), (-F.col("b.back")).cast("bigint").alias("start_word"), F.col("n_words").cast("bigint").alias("n_words"))


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the window."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
