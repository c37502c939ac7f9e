"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

Targets: the sources share ``share`` times all words by their weights; a target stops at ``most`` times its source's words
and the excess goes to the others by weight, until none is above. Quotas: the mix has as many blocks of
``block`` words as its budget holds, dealt to ``shards`` of equal numbers of blocks. A source's k-th block has the quotient target /
(2k - 1); the blocks of highest quotients win, shard after shard, so that every shard gets whole blocks of each source
near the weights. Selection: a source's documents stand in an order drawn by a seeded hash, their words are
cut into blocks, and the shards take the blocks in that order, from the start again when all have been taken.

Only a source's totals are gathered, one row a source, and ranked as a distributed table. A source's documents are placed by
``before``, which splits a source that holds most rows. Which words of a document fall to which shard then follows from
its own row: its place among the source's words and the source's quotas.

Defined results: a null text has no words, a null source is a source of its own after all others. Documents without
words take part with nothing taken. Repeated rows are documents of their own. An empty table gives no rows. Columns of the
input named as a result column give way. A source is met to within about a block: its last block may be shorter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import before, broadcast_if_small, stage, unused

SEED = 1319
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 8
SHARDS = 16
RESULT = ("size", "source_size", "target", "slices")


def source_order(source: Column) -> list[Column]:
    """By code point, null last."""
    return [source.isNull(), F.coalesce(source, F.lit(""))]


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (source_size, weight, ...) with ``target``: the water level times the weight, or ``most`` times the size where that is less."""
    cap = F.col("source_size") * most
    budget, free = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * share, F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, full = budget / free if free else 0.0, None
    while True:
        above = cap <= F.col("weight") * level
        held, left, n = sources.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))).first()
        if n == full or not left:
            break
        level, full = (budget - (held or 0)) / left, n
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))))


def quotas(sources: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """``sources`` (place, source_size, target, ...) with ``ends``: how many of its blocks the first 1, 2, .. ``shards`` shards take together.

    A divisor above budget / seats gives seats that are won for certain, one below it those that can be won at
    all; the two differ by at most two seats a source, and only these are ranked by quotient, ties by the sources' order.
    """
    budget, n = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count(F.lit(1))).first()
    seats = [int(budget / block + 0.5) * (s + 1) // shards for s in range(shards)]
    sure = [budget / (m - n) if m > n else None for m in seats]
    won = lambda d: F.floor(F.col("target") / F.lit(d) + 0.5).cast("bigint") if d else F.lit(0).cast("bigint")
    most = F.ceil(F.col("source_size") / block) * MOST
    bounds = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(m).cast("bigint").alias("seats"), F.least(won(sure[s]), most).alias("low"), (F.least(won(budget / (m + n)), most) if m else F.lit(0)).cast("bigint").alias("high")) for s, m in enumerate(seats)])
    ranges = stage(sources.select("place", "target", F.explode(bounds).alias("b")).select("place", "target", "b.*"), "ranges")
    open_seats = ranges.filter("high > low").select("place", "shard", F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("k"), "target")
    ranked = before(open_seats.withColumn("quotient", F.col("target") / (2 * F.col("k") - 1)), "shard", [F.desc("quotient"), F.asc("place"), F.asc("k")], {"rank": F.lit(1)})
    left = ranges.groupBy("shard").agg((F.first("seats") - F.sum("low")).alias("left"))  # a row for each shard
    more = ranked.join(F.broadcast(left), "shard").filter(F.col("rank") < F.col("left")).groupBy("place", "shard").agg(F.count(F.lit(1)).alias("more"))
    ends = ranges.join(more, ["place", "shard"], "left").groupBy("place").agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", (F.col("low") + F.coalesce("more", F.lit(0))).alias("end")))), lambda e: e["end"]).alias("ends"))
    return sources.join(ends, "place")


def slices(start: Column, size: Column, source_size: Column, ends: Column, block: int = BLOCK) -> Column:
    """Which of a document's words each shard takes, as (shard, from_word, to_word): the document's words meet its source's blocks."""
    blocks = F.ceil(source_size / block).cast("bigint")

    def cut(taken: Column, turn: int) -> Column:
        """The document's words before the end of the first ``taken`` blocks, of which each turn through the source holds ``blocks``."""
        word = F.least(F.greatest(taken - blocks * turn, F.lit(0)) * block, source_size)
        return F.least(F.greatest(word - start, F.lit(0)), size)

    def turn_of(turn: int) -> Column:
        return F.transform(ends, lambda e, i: F.struct(i.alias("shard"), cut(F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0)), turn).alias("from_word"), cut(e, turn).alias("to_word")))

    parts = [turn_of(turn) for turn in range(MOST)]
    return F.filter(F.concat(*parts), lambda s: s["to_word"] > s["from_word"])


def mix(docs: DataFrame, size: Column, source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, shards: int = SHARDS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``docs`` with size, source_size, target and ``slices`` (shard, from_word, to_word): the words of the document that the mix takes, repeats included.

    ``weights`` repeat over the sources in their order. The draw depends on all columns, so equal rows are interchangeable.
    """
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULT])
    key, draw, place, start, ends = unused(docs, "mix_key", "mix_draw", "place", "mix_start", "ends")
    text = F.concat(F.when(F.col(f"`{source}`").isNull(), "1").otherwise("0"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")))
    sized = docs.withColumns({"size": size.cast("bigint"), key: text})
    sized = sized.withColumn(draw, F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in sized.columns]))
    placed = stage(before(sized, key, [F.col(draw), F.col("size")], {start: F.col("size")}), "placed")
    sources = placed.groupBy(F.col(key).alias("key")).agg(F.sum("size").alias("source_size"))
    numbered = before(sources.withColumn("all", F.lit(0)), "all", ["key"], {"place": F.lit(1)})
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int"))
    shared = stage(targets(stage(numbered.withColumn("weight", weight), "sources"), share), "targets")
    told = quotas(shared, shards, block).select(F.col("key").alias(key), "source_size", "target", F.col("ends").alias(ends))
    joined = placed.join(broadcast_if_small(told, F.octet_length(key) + 64 + 8 * shards), key)
    return joined.withColumn("slices", slices(F.col(start), F.col("size"), F.col("source_size"), F.col(ends), block)).select(*docs.columns, "size", "source_size", "target", "slices")


def op13_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents: how many of their words the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("n"))
    taken = F.aggregate("slices", F.lit(0).cast("bigint"), lambda a, s: a + s["to_word"] - s["from_word"])
    return mix(texts, F.col("n")).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", F.transform("slices", lambda s: s["shard"]).alias("shards"))
