"""Two-pass external shuffle into shards, in DataFrame functions only.

Pass one scatters the records: a record's shard is the one of largest seeded hash of (id, shard number), so the
id and the shard count decide, and one more shard takes rows only into itself (law ``key``). Inside
its shard a seeded hash of the record picks one of as many buckets as keep a bucket near ``bucket_bytes`` and ``BUCKET_ROWS``; the n-th
of equal records is hashed with n, so equal rows are drawn apart. Equal records are found by their hashes, counted as groups and made
again from their number, so that a record that very many rows repeat passes no task as rows of its own. Pass two shuffles each bucket
by Fisher-Yates and writes it: the bucket's records are put in one array in a fixed order, and a chain of swaps, each with a place drawn by seeded hash
of shard, bucket and step, gives the order of its places. Whole records move through both passes. A shard's files hold its buckets; a
record's slot is its place in its bucket after the buckets before it. A shard with many rows is written by many tasks, a bucket by one.

So the slots depend on the records alone, not on files, splits or tasks. Swaps copy the array of places, which is why a bucket
has a bound on rows besides the one on bytes.

Defined results: a null id is hashed as such, a null text is a record like any other. Repeated rows get slots of their own in
one shard. An empty table gives no rows. Input columns named as a result column give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, let, shared_folder

SEED = 1117
BUCKET_BYTES = 8 << 20
BUCKET_ROWS = 512
#: Copies of a record that one row stands for while they are counted out.
COPIES = 1 << 14
RESULT = ("shard", "slot", "grown_shard")


def shard_draws(key: Column, shards: int, seed: int = SEED) -> Column:
    """A key's hash for each shard; the largest one says where it goes."""
    return F.array(*[F.xxhash64(F.lit(seed), key, F.lit(s)) for s in range(shards)])


def shuffled(values: Column, *keys: Column) -> Column:
    """The array in Fisher-Yates order; each step's place is drawn from the hash of ``keys`` and the step."""
    last = F.size(values) - 1
    steps = F.when(last > 0, F.sequence(last, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))

    def swap(places: Column, i: Column) -> Column:
        drawn = F.pmod(F.xxhash64(*keys, i), i + 1).cast("int")
        return let(drawn, lambda j: F.transform(places, lambda x, p: F.when(p == i, F.get(places, j)).when(p == j, F.get(places, i)).otherwise(x)))

    order = F.aggregate(steps, F.sequence(F.lit(0), F.greatest(last, F.lit(0))), swap)
    return let(order, lambda o: F.transform(F.slice(o, 1, F.size(values)), lambda p: F.get(values, p)))


def write_shards(records: DataFrame, path: str, key: str, size: Column, shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> None:
    """Write the records (column ``record``) below ``path``, one folder a shard, buckets shuffled.

    ``size`` gives a record's bytes, which set, with the number of rows, how many buckets a shard has. A bucket's records meet in one array.
    """
    records = records.select([F.col(f"`{c}`") for c in records.columns if c.lower() not in RESULT])
    home = lambda own: let(shard_draws(own, shards, seed), lambda d: (F.array_position(d, F.array_max(d)) - 1).cast("int"))
    # a row for each shard; one that holds a key of very many rows has more buckets
    held = {r["shard"]: max(1, -(-(r["total"] or 0) // bucket_bytes), -(-r["n"] // bucket_rows)) for r in records.groupBy(home(F.col(f"`{key}`")).alias("shard")).agg(F.sum(size).alias("total"), F.count(F.lit(1)).alias("n")).collect()}
    buckets = F.array(*[F.lit(held.get(s, 1)) for s in range(shards)])
    record = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    hashed = records.select(F.xxhash64(F.lit(seed + 1), record).alias("h"), record.alias("r"))
    repeated = broadcast_if_small(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), 16)
    once = hashed.join(repeated, "h", "left_anti").select("h", "r", F.lit(0).cast("bigint").alias("copy"))
    groups = hashed.join(repeated, "h", "left_semi").groupBy("h", "r").agg(F.count(F.lit(1)).alias("n"))
    runs = groups.select("h", "r", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(COPIES).cast("bigint"))).alias("from")).repartition("h", "from")
    again = runs.select("h", "r", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + COPIES, F.col("n")) - 1)).alias("copy"))
    sent = once.unionByName(again).select(home(F.col(f"r.`{key}`")).alias("shard"), "h", "copy", "r")
    scattered = sent.select("shard", F.pmod(F.xxhash64(F.lit(seed), "h", "copy"), F.get(buckets, "shard")).cast("int").alias("bucket"), F.struct("h", "r").alias("e"))
    shelves = scattered.groupBy("shard", "bucket").agg(F.sort_array(F.collect_list("e")).alias("es"))
    mixed = shelves.select("shard", "bucket", F.posexplode(shuffled(F.col("es"), F.lit(seed), F.col("shard"), F.col("bucket"))).alias("at", "e")).select("shard", "bucket", "at", F.col("e.r").alias("record"))
    mixed.sortWithinPartitions("shard", "bucket", "at").write.partitionBy("shard").parquet(path)


def read_shards(spark, path: str, schema: T.StructType, key: str, shards: int, seed: int = SEED) -> DataFrame:
    """The written records (of ``schema``) plus shard, slot (gapless from 0 in the shard) and grown_shard (the shard if there were one more)."""
    kept = T.StructType([f for f in schema.fields if f.name.lower() not in RESULT])
    rows = spark.read.schema(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("record", kept), T.StructField("shard", T.IntegerType())])).parquet(path)
    # a row for each bucket, which holds about bucket_bytes
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = broadcast_if_small(counts.select("shard", "bucket", before.alias("before")), 32)
    own = F.col(f"record.`{key}`")
    grows = let(shard_draws(own, shards + 1, seed), lambda d: F.get(d, F.lit(shards)) == F.array_max(d))
    return rows.join(offsets, ["shard", "bucket"]).select("record.*", "shard", (F.col("before") + F.col("at")).alias("slot"), F.when(grows, F.lit(shards)).otherwise(F.col("shard")).alias("grown_shard"))


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents, whole, written to 40 shards and read back: each one's place, size and checksum."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/shards"
    write_shards(docs, path, "doc_id", F.octet_length(F.coalesce("text", F.lit(""))) + 16, 40)
    text = F.coalesce("text", F.lit(""))
    return read_shards(spark, path, docs.schema, "doc_id", 40).select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
