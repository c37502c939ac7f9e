"""Keyed tables that micro-batches change: partitions rewritten by dynamic overwrite, rows marked with their batch.

A micro-batch that is run again, whole or after half its partitions were written, leaves the table as if it had run once. Only the
partitions that a batch touches are read and written; the new rows are staged before any old file goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import broadcast_if_small, stage, unstage

#: Partitions of a table that has no natural one.
BUCKETS = 64


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_table(spark, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def _rewrite(rows: DataFrame, path: str, partition: str) -> None:
    done = stage(rows, "upsert")
    done.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    unstage(done)


def _touched(spark, path: str, schema, partition: str, new: DataFrame) -> DataFrame:
    """The table's rows in the partitions that ``new`` touches; none where there is no table yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).join(broadcast_if_small(new.select(partition).distinct(), 64), partition, "left_semi").select(schema.names)


def upsert_by_key(batch: DataFrame, path: str, keys: list[str], partition: str, number: int) -> None:
    """Rows of ``batch`` replace those of the same partition and keys, unless those come from a later batch; a key comes once in a batch."""
    new = stage(batch.withColumn("batch", F.lit(number).cast("bigint")), "batch")
    if not new.isEmpty():
        old = _touched(new.sparkSession, path, new.schema, partition, new)
        row = F.struct(*[F.col(c) for c in new.columns])
        last = old.unionByName(new).groupBy(partition, *keys).agg(F.max_by(row, "batch").alias("r")).select("r.*")
        _rewrite(last, path, partition)
    unstage(new)


def add_by_key(batch: DataFrame, path: str, key: str, total: str, latest: str, number: int) -> None:
    """``total`` is added to the key's and ``latest`` raised, once for each batch: a row that already has this batch's mark stays."""
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    new = stage(batch.select(key, F.col(total).cast("bigint").alias(total), latest, F.lit(number).cast("bigint").alias("batch"), bucket.alias("bucket")), "batch")
    if not new.isEmpty():
        old = _touched(new.sparkSession, path, new.schema, "bucket", new)
        before = old.select(key, F.col(total).alias("t0"), F.col(latest).alias("l0"), F.col("batch").alias("b0"), F.col("bucket").alias("k0"))
        fresh = F.col("batch").isNotNull() & (F.col("b0").isNull() | (F.col("b0") < F.col("batch")))
        both = before.join(new, key, "full_outer")
        after = both.select(key, (F.coalesce("t0", F.lit(0)) + F.when(fresh, F.col(total)).otherwise(0)).cast("bigint").alias(total), F.when(fresh, F.greatest("l0", latest)).otherwise(F.col("l0")).alias(latest), F.when(fresh, F.col("batch")).otherwise(F.col("b0")).alias("batch"), F.coalesce("bucket", "k0").alias("bucket"))
        _rewrite(after, path, "bucket")
    unstage(new)
