"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import broadcast_if_small, shared_folder, stage, unstage

__all__ = ["SPACE", "ascii_lower", "before", "bounded_batches", "broadcast_if_small", "let", "prefix_sums", "released", "remembered", "shared_folder", "shingle_hashes", "slices", "stage", "unstage", "unused", "words_of"]

#: Words are maximal runs of characters other than space and U+0009..U+000D.
SPACE = "[\\x20\\x09-\\x0D]+"
#: Texts are turned into Python strings in slices of about this many bytes.
SLICE_BYTES = 1 << 20
#: Arrow batches between JVM and workers hold about this many bytes.
BATCH_BYTES = 8 << 20

_held: dict[str, Any] = {}


def remembered(key: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one thing at a time, so that stages don't add up in reused workers."""
    if key not in _held:
        _held.clear()
        _give_back()
        _held[key] = make()
    return _held[key]


def _give_back() -> None:
    """Free memory goes back to the machine: the worker lives on beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end the task's free memory is given back."""
    yield from batches
    _give_back()


def bounded_batches(df: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """``df``, after the session's Arrow batches have been limited to ``most`` bytes: JVM and worker each hold one."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    held = int(conf.get(name).rstrip("b"))
    if held > most:
        conf.set(name, most)
    return df


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of a string or binary column; a longer value is a slice of its own."""
    texts = batch.column(column)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    ends = memoryview(texts.buffers()[1]).cast("B").cast("q" if wide else "i")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else [0]
    at = 0
    while at < len(texts):
        stop = at + 1
        while stop < len(texts) and ends[stop + 1] - ends[at] <= most:
            stop += 1
        yield batch.slice(at, stop - at)
        at = stop


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once per row.

    A lambda over an aliased column may be inlined by the optimizer and then evaluates the column
    once per array element; a lambda variable is never inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(numbers: Column, width: int = 128) -> Column:
    """For each integer of an array the sum of those before it, as bigint.

    ``aggregate`` copies the array it grows, so sums are made in runs of ``width`` and over the runs' totals.
    """
    none = F.array().cast("array<bigint>")

    def running(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))
        return F.aggregate(xs, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def whole(xs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / width).cast("int")), lambda i: running(F.slice(xs, i * width + 1, F.lit(width))))
        return let(runs, lambda rs: F.flatten(F.zip_with(rs, running(F.transform(rs, lambda r: r["at"]))["out"], lambda r, before: F.transform(r["out"], lambda x: x + before))))

    return let(F.transform(numbers, lambda x: x.cast("bigint")), lambda xs: F.when(F.size(xs) == 0, none).otherwise(whole(xs)))


def words_of(text: Column) -> Column:
    """Words of a text in order; null for a null text."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(words: Column, k: int) -> Column:
    """64-bit hashes of the k-word shingles by position; fewer words give the whole sequence as one.

    Words are hashed once and shingles from the words' hashes; places past the end are null, which the
    hash skips.
    """

    def combine(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0)))
        return F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

    none = F.array().cast("array<bigint>")
    return F.when(F.size(words) == 0, none).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), combine))


def before(df: DataFrame, key: str, order: list[str | Column], sums: dict[str, Column], xors: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with each named sum (or ``bit_xor``) of a number over the rows of its key that come before it; 0 for none.

    Rows are dealt by ranges of key and order, so that a key with very many rows lies in many partitions; what lies in
    earlier partitions is added from a table of one row per key and partition. ``key`` is never null. Rows that
    ``order`` does not tell apart must be interchangeable.
    """
    xors = xors or {}
    (part, *own) = unused(df, "part", *[f"earlier_{name}" for name in (*sums, *xors)])
    whole = {name: F.sum(value) for name, value in sums.items()} | {name: F.bit_xor(value) for name, value in xors.items()}
    dealt = stage(df.repartitionByRange(F.col(key), *order).withColumn(part, F.spark_partition_id()), "dealt")
    rows = Window.partitionBy(part, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.groupBy(part, key).agg(*[total.alias(o) for o, total in zip(own, whole.values(), strict=True)])
    held = held.select(part, key, *[F.coalesce((F.sum if name in sums else F.bit_xor)(o).over(parts), F.lit(0)).alias(o) for o, name in zip(own, whole, strict=True)])
    local = dealt.withColumns({name: F.coalesce(total.over(rows), F.lit(0)) for name, total in whole.items()}).join(held, [part, key])
    return local.withColumns({name: F.col(name) + F.col(o) if name in sums else F.col(name).bitwiseXOR(F.col(o)) for o, name in zip(own, whole, strict=True)}).drop(part, *own)
