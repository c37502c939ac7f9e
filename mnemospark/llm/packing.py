"""Best-fit packing of tokenised documents by minimum bin slack.

Documents are tokenised and an end id is appended; one that is longer than a sequence is cut into
full pieces, the first of which may be shorter. A sequence is filled by minimum bin slack: the
longest piece left is taken, and a bitset subset-sum over the lengths available (with their counts)
finds the fullest feasible combination, which is then removed. All sequences of one combination are
made at once, as often as the counts allow, so planning needs only the histogram of lengths: at
most ``capacity`` numbers reach the driver, whatever the corpus. Pieces are numbered inside their
length by salted windows, and each takes its place from the plan by its number.

Defined results: a null text is packed as an empty one (only the end id). Repeated rows are packed
each on its own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, released, slices, stage
from .tokens import encoder

CAPACITY = 2048
#: Bytes of chunks a worker remembers: no shuffle runs beside the encoding.
MEMO = 56 << 20
#: Pieces of one length and salt are numbered by one task.
PER_SALT = 100_000
LEAST_SALTS = 128


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32) of every document's pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, True, MEMO)
        for batch in (part for batch in released(batches) for part in slices(batch, 1)):
            row, piece, start, length, crc = [], [], [], [], []
            for k, own in enumerate(encode.many([t or "" for t in batch.column(1).to_pylist()])):
                ids = np.append(own, np.uint32(end_id)).astype("<u4")
                at, size = 0, len(ids) % capacity or capacity
                while at < len(ids):
                    row.append(k), piece.append(len(row)), start.append(at), length.append(size)
                    piece[-1] = 0 if at == 0 else piece[-2] + 1
                    crc.append(zlib.crc32(ids[at : at + size].tobytes()))
                    at, size = at + size, capacity
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=[id_col, "piece", "start", "length", "ids_crc32"])

    return bounded_batches(docs).select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias("text")).mapInArrow(cut, f"`{id_col}` bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def _with_item(reach: int, length: int, copies: int, mask: int) -> int:
    """Sums reachable with up to ``copies`` more items of a length."""
    step = 1
    while copies > 0:
        use = min(step, copies)
        reach |= (reach << (use * length)) & mask
        copies -= use
        step *= 2
    return reach


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first number, end number, copies a sequence, first sequence, offset)."""
    left = dict(sorted(counts.items()))
    lengths = list(left)
    place = {n: i for i, n in enumerate(lengths)}
    mask = (1 << (capacity + 1)) - 1
    reach = [1]  # reach[i]: sums of the i shortest lengths with their counts

    def renew(i: int) -> None:
        del reach[i + 1 :]

    def upto(i: int) -> int:
        while len(reach) <= i:
            n = lengths[len(reach) - 1]
            reach.append(_with_item(reach[-1], n, min(left[n], capacity // n), mask))
        return reach[i]

    used, sequence, rows = dict.fromkeys(lengths, 0), 0, []
    top = len(lengths) - 1
    while top >= 0:
        longest = lengths[top]
        if not left[longest]:
            top -= 1
            continue
        room = capacity - longest
        combination = {longest: 1}
        left[longest] -= 1
        renew(min(place[longest], len(reach) - 1))
        i = top + 1
        while i > 0 and lengths[i - 1] > room:
            i -= 1
        total = (upto(i) & ((1 << (room + 1)) - 1)).bit_length() - 1
        while total > 0:  # the longest lengths first, so that short ones stay for later sequences
            n = lengths[i - 1]
            copies = 0
            while not (reach[i - 1] >> total) & 1:
                copies, total = copies + 1, total - n
            if copies:
                combination[n] = combination.get(n, 0) + copies
            i -= 1
        left[longest] += 1
        times = min(left[n] // c for n, c in combination.items())
        offset, touched = 0, len(lengths)
        for n, c in combination.items():
            rows.append((n, used[n], used[n] + times * c, c, sequence, offset))
            offset += n * c
            used[n] += times * c
            left[n] -= times * c
            if left[n] < capacity // n:
                touched = min(touched, place[n])
        renew(min(touched, len(reach) - 1))
        sequence += times
    return rows


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (with a column length) plus sequence_id and offset."""
    cut = stage(cut, "pieces")
    salts = max(LEAST_SALTS, cut.count() // PER_SALT)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in cut.columns]), F.lit(salts)))
    tally = stage(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "tally")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    rows = plan({r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    table: dict[int, np.ndarray] = {}
    for r in rows:
        table.setdefault(r[0], []).append(r[1:])
    table = {n: np.array(r, dtype=np.int64) for n, r in table.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(zero_copy_only=False), batch.column("number").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                own = table[int(length[part[0]])]
                r = own[np.searchsorted(own[:, 0], number[part], side="right") - 1]
                step = number[part] - r[:, 0]
                sequence[part], offset[part] = r[:, 3] + step // r[:, 2], r[:, 4] + step % r[:, 2] * length[part]
            yield pa.RecordBatch.from_arrays([*batch.select(names[:-2]).columns, pa.array(sequence), pa.array(offset)], names=names)

    names = [*cut.columns, "sequence_id", "offset"]
    in_salt = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*[F.col(f"`{c}`") for c in cut.columns]))
    numbered = salted.withColumn("row", in_salt).join(tally.select("length", "salt", before.alias("before")), ["length", "salt"])
    numbered = numbered.select(*[F.col(f"`{c}`") for c in cut.columns], (F.col("before") + F.col("row") - 1).alias("number"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return numbered.mapInArrow(assign, f"{schema}, sequence_id bigint, offset bigint")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Place of every document piece in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")))
