"""Token ids in Simple-8b blocks, written in ascending id order and read back.

A 64-bit word holds a four-bit selector and 60 bits of payload; the selector says how many ids of
how many bits follow. An id too wide for the usual selectors is written alone with all 60 bits (the
escape). A block holds whole documents: their ids and lengths, the words, and for every
``OFFSET_WORDS`` words the number of ids before them. Reading decodes a block in strips that begin at such offsets,
all words of one selector at once. Blocks are rows of Parquet files: part (range of document ids), block,
first_id (ids before it in its part), n_ids.

Documents are encoded where they are read; only ids (two bytes each where the vocabulary allows) are
sorted and shuffled, and a hash and a random number behind the document id keep one id's many rows in many ranges.

Defined results: a null text is written as an empty one (only the end id); null ids come first; equal
ids follow each other by a hash of their tokens, and equal rows are interchangeable. An empty table gives no
blocks and no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, broadcast_if_small, released, shared_folder, slices, stage, unstage
from .tokens import encoder

# Fixed values: (ids a word, bits an id) by selector, as Simple-8b defines them.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([n for n, _ in SELECTORS])
OFFSET_WORDS = 128
#: A block ends with the document that fills it to this many ids.
BLOCK_IDS = 1 << 16
#: A part holds about this many bytes of ids; reading decodes this many offsets' words at once.
PART_BYTES, STRIP = 32 << 20, 64
#: Texts are encoded in groups of about this many bytes; a group's different words are looked up once.
GROUP_BYTES = 4 << 20
BLOCKS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("first_id", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("offsets", T.BinaryType()), T.StructField("words", T.BinaryType())])


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets) of the ids; each word takes as many ids as fit."""
    n, last = len(ids), len(SELECTORS) - 1
    # the narrowest of the selectors' widths that holds an id, and the widest of these over as many ids as a selector takes
    widest = np.zeros(n + int(COUNTS[0]) - 1, dtype=np.uint8)
    for _, bits in SELECTORS[1:last]:
        if bits < 8 * ids.itemsize:
            widest[:n] += ids >= ids.dtype.type(1 << bits)
    choice, held = np.full(n, last, dtype=np.uint8), 1
    for s in range(last - 1, -1, -1):
        count = SELECTORS[s][0]
        widest, held = np.maximum(widest[: held - count], widest[count - held :]), count
        choice -= widest[:n] <= max(s - 1, 0)  # what fits a selector fits the next ones too
    # where a word begins: one in eight is found by eight steps at once
    step = [np.append(np.minimum(np.arange(n) + COUNTS[choice], n), n).astype(np.int32)]
    for _ in range(3):
        step.append(step[-1][step[-1]])
    starts, at, eight = [], 0, memoryview(step[3])
    while at < n:
        starts.append(at)
        at = eight[at]
    starts = np.array(starts, dtype=np.int32)
    for own in step[2::-1]:
        starts = np.column_stack([starts, own[starts]]).ravel()
    starts = starts[starts < n].astype(np.int64)
    chosen = choice[starts]
    takes = np.diff(starts, append=n)
    place = np.arange(n) - np.repeat(starts, takes)
    shift = (place * np.repeat(np.array([bits for _, bits in SELECTORS])[chosen], takes)).astype(np.uint64)
    words = np.bitwise_or.reduceat(ids.astype(np.uint64) << shift, starts) | chosen.astype(np.uint64) << np.uint64(60)
    return words, starts[::OFFSET_WORDS].astype("<u4")


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of the words, all words of a selector at once."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype="<u4")
    for s in np.unique(selector):
        count, bits = SELECTORS[s]
        if bits:
            mine = np.flatnonzero(selector == s)
            values = (words[mine][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
            out[starts[mine][:, None] + np.arange(count)] = values
    return out[:n]


def decode_block(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block, strip by strip."""
    out = np.empty(n, dtype="<u4")
    for g in range(0, len(offsets), STRIP):
        lo, hi = int(offsets[g]), int(offsets[g + STRIP]) if g + STRIP < len(offsets) else n
        out[lo:hi] = decode(words[g * OFFSET_WORDS : (g + STRIP) * OFFSET_WORDS], hi - lo)
    return out


def _encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """id, n and ids (little-endian, of two or four bytes) of every document (id, text)."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, False)
        kind = "<u2" if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for batch in (part for batch in released(batches) for part in slices(batch, 1, GROUP_BYTES)):
            ids, ends = coder.together(batch.column(1), end_id)
            ids, ends = ids.astype(kind), np.insert(ends, 0, 0)
            column = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.array(ends * ids.itemsize, pa.int32()).buffers()[1], pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int32()), column], names=["id", "n", "ids"])

    return bounded_batches(docs).mapInArrow(code, "id bigint, n int, ids binary")


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents' ids as blocks in ascending id order."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    encoded = stage(_encoded(docs, vocabulary, end_id), "encoded", "zstd")
    total = encoded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    parts = max(1, docs.sparkSession.sparkContext.defaultParallelism, -(-total // PART_BYTES))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        number, before, names, lengths, held, size = 0, 0, [], [], [], 0

        def block() -> pa.RecordBatch:
            words, offsets = encode(np.concatenate(held))
            row = {"part": part, "block": number, "first_id": before, "n_ids": size, "doc_ids": names, "lengths": lengths, "offsets": offsets.tobytes(), "words": words.astype("<u8").tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in (piece for batch in released(batches) for piece in slices(batch, 2)):
            for name, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4")
                names.append(name), lengths.append(n), held.append(ids.astype(np.uint32))
                size += n
                if size >= BLOCK_IDS:
                    yield block()
                    number, before, names, lengths, held, size = number + 1, before + size, [], [], [], 0
        if held:
            yield block()

    arrow = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("offsets", pa.binary()), ("words", pa.binary())])
    order = ["id", "hash", "salt"]
    ranged = encoded.withColumns({"hash": F.xxhash64("ids"), "salt": F.rand(5)}).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged.select("id", "n", "ids").mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").parquet(path)
    unstage(encoded)


def read_ids(spark, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32[, ids]) of every document in the files."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # a row for each range of documents that was written, of PART_BYTES each
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before.alias("before"))
    placed = blocks.join(broadcast_if_small(starts, 16), "part").select((F.col("before") + F.col("first_id")).alias("first"), "n_ids", "doc_ids", "lengths", "offsets", "words")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for batch in released(batches) for piece in slices(batch, 5)):
            for row in batch.to_pylist():
                ids = decode_block(np.frombuffer(row["words"], dtype="<u8"), np.frombuffer(row["offsets"], dtype="<u4"), row["n_ids"])
                ends = np.cumsum(row["lengths"])
                begins = ends - row["lengths"]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(begins + row["first"], pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(begins, ends, strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    return placed.mapInArrow(unpack, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


def op5_token_file(spark, sf_dir: str) -> DataFrame:
    """Write every document's ids, read the files back and report each document."""
    import public_tokenizers

    path = f"{shared_folder(spark)}/ids"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_ids(spark, path)
