"""Snapshots in the folder that ``spark.checkpoint.dir`` names, shared by driver and executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    Where that setting is missing, a temporary folder is made and set, but only for a local master: on a
    cluster no other machine would see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/mnemospark-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without recomputing ``df``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.option("compression", compression).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.staged_at = path
    return found


def unstage(*staged: DataFrame) -> None:
    """Delete snapshots that nothing will read again."""
    for df in staged:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def broadcast_if_small(df: DataFrame, row_bytes: int | Column, most_mb: int = 64) -> DataFrame:
    """``df`` marked for broadcast if its rows, counted first, take at most ``most_mb``; else unchanged.

    ``row_bytes`` is a row's size where it is fixed, else a column that gives each row's.
    """
    df = stage(df, "side")
    size = df.count() * row_bytes if isinstance(row_bytes, int) else df.agg(F.sum(row_bytes)).first()[0] or 0
    if size > most_mb << 20:
        return df
    small = F.broadcast(df)
    small.staged_at = df.staged_at
    return small
