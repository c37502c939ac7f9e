"""Near-duplicate groups by MinHash signatures and a multi-index Hamming join.

Every distinct shingle set gets a signature of K = CHUNKS * CHUNK minimum hashes cut to 16 bits. Two
signatures at distance (differing places) below CHUNKS * (ERRORS + 1) have, by pigeonhole, a chunk
with at most ERRORS differences; so each chunk is indexed once for every choice of ERRORS places
left out, and the pairs that share an index key include all pairs under that distance. A pair at
the similarity threshold 0.8 shares no key with a probability of (1 - 0.8^4 - 4 * 0.2 * 0.8^3)^6,
about 3.5e-5. Every candidate is confirmed on the full sets.

Large groups are not expanded into pairs. Round one confirms, for each set, only the links to the
smallest and to the largest set among all that share a key with it, and joins these links into
components. Round two looks at keys whose sets are still in different components. Where such a key
has at most SMALL sets, the pairs across components that are close in size and signature are
confirmed one by one; larger ones are compared in blocks of bounded size. Nothing is capped.

Defined results: texts without words (null, empty, blank) have an empty set, are linked with
nothing and are their own component. Equal texts share one set and one component. Rows with a null
id take no part: component null, kept true. Rows that share an id count as one document in links: it is
linked with what any of its texts is linked with; a row's component is that of its own text. Other columns
are ignored. Words are hashed to 64 bits; sets are compared by these hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import bounded_batches, broadcast_if_small, released, remembered, slices, stage, unstage

CHUNKS, CHUNK, ERRORS = 6, 4, 1
#: Round two asks for this many equal places of the 24 (a pair at 0.8 fails with probability 2e-5).
LEAST_EQUAL = 10
THRESHOLD = (80, 100)
#: Keys with more sets are compared in blocks of about this many sets and hashes.
SMALL, BLOCK_MEMBERS, BLOCK_HASHES = 16, 512, 1 << 20
#: A set with more copies is joined to its rows by broadcast.
HOT_COPIES = 100_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_seeds = np.random.Generator(np.random.PCG64(4242)).integers(0, 2**63, (2, CHUNKS * CHUNK), dtype=np.uint64)
_MULTIPLY, _ADD = (_seeds[0] << np.uint64(1)) | np.uint64(1), _seeds[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> np.ndarray:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""

    def made(size: int) -> np.ndarray:
        steps = np.array([[_BASE], [_INVERSE]], dtype=np.uint64) * np.ones((1, size), dtype=np.uint64)
        steps[:, 0] = 1
        return np.multiply.accumulate(steps, axis=1)

    kept = remembered("neardup powers", lambda: made(1 << 16))
    return kept if n <= kept.shape[1] else made(n)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of the ASCII-lower-cased text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    lower = raw + ((raw >= 65) & (raw <= 90)) * np.uint8(32)
    powers, inverse = _power_table(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=sums[1:])
    word = _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    k = min(k, len(word))
    out = np.full(len(word) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        out = _mix((out + word[j : len(word) - k + 1 + j]) * np.uint64(_BASE))
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Smallest values of the permuted hashes, cut to their upper 16 bits after mixing."""
    least = np.full(CHUNKS * CHUNK, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        least = np.minimum(least, (part[None, :] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1))
    return (_mix(least) >> np.uint64(48)).astype(np.int32)


def _signed(docs: DataFrame, k: int) -> DataFrame:
    """id, n (set size), set_hi, set_lo (128-bit hash of the set) and sig for every row."""
    import hashlib

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in released(batches) for part in slices(batch, 1)):
            n, keys, sigs, memo = [], [], [], {}
            for text in batch.column("text").to_pylist():
                if text not in memo:
                    s = shingle_set(text, k)
                    key = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype="<i8")
                    memo[text] = (len(s), key, signature(s) if len(s) else np.zeros(CHUNKS * CHUNK, np.int32))
                row = memo[text]
                n.append(row[0]), keys.append(row[1]), sigs.append(row[2])
            both, flat = np.array(keys).reshape(-1, 2), np.array(sigs, dtype=np.int32).reshape(-1)
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, CHUNKS * CHUNK, dtype=np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), lists], names=["id", "n", "set_hi", "set_lo", "sig"])

    return docs.mapInArrow(sign, "id bigint, n bigint, set_hi bigint, set_lo bigint, sig array<int>")


def _index_keys() -> Column:
    """Array of the index keys of a signature: chunk and left-out places with the other places' values."""
    keys, number = [], 0
    for c in range(CHUNKS):
        for out in combinations(range(CHUNK), ERRORS):
            rest = [F.get("sig", F.lit(c * CHUNK + p)) for p in range(CHUNK) if p not in out]
            keys.append(F.xxhash64(F.lit(number), *rest))
            number += 1
    return F.array(*keys)


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id and its full set (bytes) for the ids of ``ids``; one row for each distinct set of an id."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in released(batches) for part in slices(batch, 1)):
            made = [shingle_set(t, k) for t in batch.column("text").to_pylist()]
            sums = np.array([_mix(s).sum(dtype=np.uint64) for s in made], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sums), pa.array([s.tobytes() for s in made], pa.binary())], names=["id", "h", "s"])

    found = docs.join(broadcast_if_small(ids, 8), "id", "left_semi").mapInArrow(build, "id bigint, h bigint, s binary")
    return found.dropDuplicates(["id", "h"]).select("id", "s")


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    part, whole = threshold

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                good.append(whole * common >= part * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = stage(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = stage(_sets(docs, ends, k), "sets")
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    found = stage(joined.select("a", "b", "sa", "sb").mapInArrow(check, "a bigint, b bigint").distinct(), "links")
    unstage(pairs, sets)
    return found


def _confirmed_in_blocks(members: DataFrame, docs: DataFrame, k: int, threshold: tuple[int, int]) -> DataFrame:
    """Links (a, b) that join what is linked among the members of each key.

    A key's members are dealt into ``ways`` blocks, and every pair of blocks is a group of its own.
    Products of the blocks' incidence matrices give all sizes of intersections at once, so no pair
    is emitted: only a tree over the members of a group that hang together.
    """
    part, whole = threshold

    def compare(table: pa.Table) -> pa.Table:
        rid = table.column("rid").to_numpy()
        comp = table.column("comp").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table.column("s").to_pylist()]
        size = np.array([len(s) for s in sets])
        codes, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rows, shared = np.repeat(np.arange(len(sets)), size), seen[column] > 1
        rows, column = rows[shared], (np.cumsum(seen > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        common = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for at in range(0, int((seen > 1).sum()), 4096):
            lo, hi = np.searchsorted(column, [at, at + 4096])
            grid = np.zeros((len(sets), 4096), dtype=np.float32)
            grid[rows[lo:hi], column[lo:hi] - at] = 1
            common += grid @ grid.T
        linked = (whole * common >= part * (size[:, None] + size[None, :] - common)) | (comp[:, None] == comp[None, :])
        a, b, left = [], [], np.ones(len(sets), dtype=bool)
        for root in range(len(sets)):
            if left[root]:
                left[root], edge = False, np.array([root])
                while len(edge):
                    edge = np.flatnonzero(linked[edge].any(axis=0) & left)
                    left[edge] = False
                    edge_new = edge[comp[edge] != comp[root]]
                    a.extend([rid[root]] * len(edge_new)), b.extend(rid[edge_new].tolist())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    own = F.pmod(F.xxhash64("rid"), F.col("ways")).cast("int")
    dealt = members.select("key", "rid", "comp", "ways", own.alias("own"))
    dealt = dealt.select("key", "rid", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("other"))
    dealt = dealt.select("key", "rid", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    ids = dealt.select(F.col("rid").alias("id")).distinct()
    sets = stage(_sets(docs, ids, k).withColumnRenamed("id", "rid"), "sets")
    # a pair of blocks whose members are all in one component is left out
    mixed = dealt.groupBy("key", "i", "j").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 < c2").select("key", "i", "j")
    found = stage(dealt.join(mixed, ["key", "i", "j"]).join(sets, "rid").groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct(), "links")
    unstage(sets)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id, kept (first of its component)."""
    docs = bounded_batches(docs).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = stage(_signed(docs, k), "signed")
    named = docs.filter("id is not null")
    reps = stage(signed.filter("n > 0 and id is not null").groupBy("set_hi", "set_lo").agg(F.min("id").alias("rid"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies")), "reps")
    keys = stage(reps.select("rid", F.explode(_index_keys()).alias("key")), "keys")
    hubs = keys.groupBy("key").agg(F.min("rid").alias("low"), F.max("rid").alias("high")).filter("low < high")
    stars = keys.join(hubs, "key").groupBy("rid").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    stars = stars.select("rid", F.explode(F.array("low", "high")).alias("hub")).filter("rid <> hub")
    pairs = stars.select(F.least("rid", "hub").alias("a"), F.greatest("rid", "hub").alias("b")).distinct()
    first = _confirmed(pairs, named, k, threshold)
    comp = stage(components(first), "components")

    part, whole = threshold
    placed = keys.join(comp.withColumnRenamed("id", "rid"), "rid", "left").select("key", "rid", F.coalesce("comp", "rid").alias("comp"))
    placed = stage(placed, "placed")
    weights = placed.join(reps.select("rid", "n"), "rid").groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight"))
    ways = F.ceil(F.greatest(F.col("members") / BLOCK_MEMBERS, F.col("weight") / BLOCK_HASHES))
    open_keys = weights.filter("c1 < c2").select("key", F.when(F.col("members") > SMALL, ways).otherwise(F.lit(0)).cast("int").alias("ways"))
    members = stage(placed.join(open_keys, "key").join(reps.select("rid", "n", "sig"), "rid"), "members")

    x, y = (members.filter("ways = 0").select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("rid", "comp", "n", "sig"))) for s in "ab")
    equal = reduce(lambda p, q: p + q, [(F.get("sig_a", F.lit(i)) == F.get("sig_b", F.lit(i))).cast("int") for i in range(CHUNKS * CHUNK)])
    near = x.join(y, (x["key"] == y["key"]) & (F.col("comp_a") < F.col("comp_b")) & (F.least("n_a", "n_b") * whole >= F.greatest("n_a", "n_b") * part) & (equal >= LEAST_EQUAL))
    pairs = near.select(F.least("rid_a", "rid_b").alias("a"), F.greatest("rid_a", "rid_b").alias("b")).distinct()
    one_by_one, in_blocks = _confirmed(pairs, named, k, threshold), _confirmed_in_blocks(members.filter("ways > 0"), named, k, threshold)
    if not (one_by_one.isEmpty() and in_blocks.isEmpty()):
        comp = stage(components(first.union(one_by_one).union(in_blocks)), "components")
    homes = stage(reps.join(comp.withColumnRenamed("id", "rid"), "rid", "left").select("set_hi", "set_lo", F.coalesce("comp", "rid").alias("comp"), "copies"), "homes")
    unstage(reps, keys, placed, members, first, one_by_one, in_blocks)

    # rows of a set with very many copies find it by broadcast (there are few such sets), the others by a shuffled join
    hot = broadcast_if_small(homes.filter(F.col("copies") > HOT_COPIES).select("set_hi", "set_lo", F.col("comp").alias("hot")), 32)
    worded = (F.col("n") > 0) & F.col("id").isNotNull()
    rows = signed.filter(worded).select("id", "n", "set_hi", "set_lo").join(hot, ["set_hi", "set_lo"], "left")
    cold = rows.filter("hot is null").join(homes.filter(F.col("copies") <= HOT_COPIES), ["set_hi", "set_lo"], "left").select("id", "n", "comp")
    alone = signed.filter(~worded | F.col("id").isNull()).select("id", "n", F.col("id").alias("comp"))
    out = cold.union(rows.filter("hot is not null").select("id", "n", "hot")).union(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("comp") == F.col("id"), F.lit(True)).alias("kept"))


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Component and kept flag of every document, on four-word shingles at 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)
