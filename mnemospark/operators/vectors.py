"""Nearest neighbours of a table of queries: exact by block products, approximate by an inverted file of vectors.

Both are one product of blocks. Queries and items that may meet share a group: the length of their vectors for exact search, a
cell of the inverted file for approximate search. A group with many rows is cut into blocks by hash, and every query
block meets every item block of its group in one task, which multiplies them in single precision, again in double precision what may be
among the best, and keeps its own k best per query. Only queries x k
rows a block pair are shuffled on. Nothing passes through the driver but counts, the plan is the same for any number
of queries, and a cell or vector that a third of all items share is only more blocks.

Defined results: rows without a vector match nothing; vectors meet only vectors of their own length; a null or zero vector
has cosine 0 with all of its length. Ties go by key. An empty side gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import broadcast_if_small, stage, unstage
from .ranking import top_k

#: Bytes of vectors in a block of queries and in a block of items.
QUERY_BYTES, ITEM_BYTES = 16 << 20, 64 << 20
#: Queries and items multiplied at once inside a task.
STEP_QUERIES, STEP_ITEMS = 256, 16_384
#: Items multiplied first, which bound what of the others can be among the best, and pairs multiplied at once in double precision.
FIRST_ITEMS, STEP_PAIRS = 1024, 32_768
#: Pairs that are work enough for one task.
PAIRS_TASK = 16_000_000
#: The inverted file: most cells, items that train them, trial queries, and the recall at ten that they are to reach.
MOST_CELLS, TRAINING, TRIALS, RECALL = 4096, 65_536, 256, 0.95


def _best(mine: np.ndarray, theirs: np.ndarray, rank: np.ndarray, own: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, score) of the k best items of each query, by places in ``mine`` and ``theirs`` (rows of length 1), ties by ``rank``; items of rank ``own`` of a query are left out.

    Products in single precision only leave out what can't be among the best by more than their error; the rest is multiplied in double precision.
    """
    single, narrow, span = theirs.astype(np.float32), mine.astype(np.float32), int(rank.max(initial=0)) + 1
    slack = 1.2e-7 * (mine.shape[1] + 8) + 2e-6
    out = []
    for q in range(0, len(mine), STEP_QUERIES):
        asked = narrow[q : q + STEP_QUERIES]
        # score and rank of what is kept, as one number that is smaller for better items
        order, item = np.full((len(asked), k), np.iinfo(np.int64).max), np.full((len(asked), k), -1)
        at, to, most = 0, min(FIRST_ITEMS, STEP_ITEMS), k + (own is not None)
        while at < len(theirs):
            sims = asked @ single[at:to].T
            held = item[:, -1] >= 0
            low = np.where(held, 1.0 - order[:, -1] // span / 1e6, -np.inf)
            if not held.all() and sims.shape[1] > most:
                low[~held] = np.partition(sims[~held], -most, axis=1)[:, -most]
            flat = np.flatnonzero(sims >= (low - slack).astype(np.float32)[:, None])
            row, col = flat // sims.shape[1], flat % sims.shape[1] + at
            if own is not None:
                other = rank[col] != own[q + row]
                row, col = row[other], col[other]
            exact = [np.einsum("ij,ij->i", mine[q + row[c : c + STEP_PAIRS]], theirs[col[c : c + STEP_PAIRS]]) for c in range(0, len(row), STEP_PAIRS)]
            place = (1_000_000 - np.rint(np.concatenate([np.zeros(0), *exact]) * 1e6).astype(np.int64)) * span + rank[col]
            ends = np.searchsorted(row, np.arange(len(asked) + 1))
            for r in np.flatnonzero(np.diff(ends) > 0):
                some, where = place[ends[r] : ends[r + 1]], col[ends[r] : ends[r + 1]]
                if len(some) > k:  # many items may tie
                    best = np.argpartition(some, k - 1)[:k]
                    some, where = some[best], where[best]
                some, where = np.concatenate([order[r], some]), np.concatenate([item[r], where])
                best = np.argsort(some, kind="stable")[:k]
                order[r], item[r] = some[best], where[best]
            at, to = to, to + STEP_ITEMS
        row, n = np.nonzero(item >= 0)
        out.append((q + row, item[row, n], (1_000_000 - order[row, n] // span) / 1e6))
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def _unit(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    v = column.combine_chunks()
    m = np.asarray(v.flatten(), dtype=np.float64).reshape(rows, -1) if rows else np.zeros((0, 1))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def block_product(queries: DataFrame, items: DataFrame, k: int, strata: int = 1, exclude_self: bool = False) -> DataFrame:
    """(q, key, stratum, score): the k best items of each query, stratum and block pair.

    ``queries``: q, grp, v; ``items``: key (string), grp, v and marks, whose bit s says that the item is in stratum s. Both are
    staged tables, read once to be counted and once to be dealt.
    """
    width = F.max(F.size("v"))
    asked = queries.groupBy("grp").agg(F.count(F.lit(1)).alias("nq"), width.alias("dq"))
    held = items.groupBy("grp").agg(F.count(F.lit(1)).alias("ni"), width.alias("di"))
    blocks = lambda n, d, most: F.ceil(F.col(n) * F.col(d) * 8 / most).cast("int")
    # a task should have work for seconds, so few items are not cut for the sake of tasks alone; blocks of queries make tasks too
    spread = F.least(F.lit(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.ceil(F.col("nq") * F.col("ni") / PAIRS_TASK))
    sizes = asked.join(held, "grp").withColumn("qs", blocks("nq", "dq", QUERY_BYTES))
    sizes = sizes.select("grp", "qs", F.greatest(blocks("ni", "di", ITEM_BYTES), F.ceil(spread / F.col("qs")).cast("int")).alias("ks"))
    sizes = broadcast_if_small(sizes, 16)  # a row for each length or cell
    part = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = queries.join(sizes, "grp").select("grp", F.pmod(F.xxhash64("q"), F.col("qs")).cast("int").alias("qb"), F.explode(part("ks")).alias("kb"), "q", "v")
    right = items.join(sizes, "grp").select("grp", F.explode(part("qs")).alias("qb"), F.pmod(F.xxhash64("key"), F.col("ks")).cast("int").alias("kb"), "key", "v", "marks")
    kind = queries.schema["q"].dataType
    arrow = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}.get(kind, pa.string())

    def multiply(asked: pa.Table, held: pa.Table) -> pa.Table:
        names, keys, marks, found = asked["q"], held["key"], held["marks"].to_numpy(), []
        if len(names) and len(keys):
            mine, theirs = _unit(asked["v"], len(names)), _unit(held["v"], len(keys))
            rank, own = pc.rank(keys, tiebreaker="dense").to_numpy().astype(np.int64), None
            if exclude_self:
                same = pc.index_in(names.cast(pa.string()), keys.combine_chunks().cast(pa.string())).to_numpy(zero_copy_only=False)
                own = np.where(np.isnan(same), -1, rank[np.nan_to_num(same).astype(np.int64)])
            for s in range(strata):
                some = np.flatnonzero(marks >> s & 1)
                if len(some):
                    row, col, score = _best(mine, theirs[some] if len(some) < len(keys) else theirs, rank[some], own, k)
                    found.append((row, some[col], np.full(len(row), s), score))
        row, col, stratum, score = (np.concatenate(part) for part in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
        return pa.table([names.take(pa.array(row)).cast(arrow), keys.take(pa.array(col)).cast(pa.string()), pa.array(stratum, pa.int32()), pa.array(score, pa.float64())], names=["q", "key", "stratum", "score"])

    schema = T.StructType([T.StructField("q", kind), T.StructField("key", T.StringType()), T.StructField("stratum", T.IntegerType()), T.StructField("score", T.DoubleType())])
    by = ("grp", "qb", "kb")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(multiply, schema)


def _sides(queries: DataFrame, items: DataFrame, query: str, key: str, vector: str, strata: dict[str, Column | None]) -> tuple[DataFrame, DataFrame]:
    """The two tables of a block product, one group a length of vector."""
    q = queries.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(query).alias("q"), F.col(vector).alias("v"))
    if not isinstance(q.schema["q"].dataType, (T.LongType, T.IntegerType, T.StringType)):
        q = q.withColumn("q", F.col("q").cast("string"))
    marks = sum((F.when(F.lit(True) if when is None else when, 1 << s).otherwise(0) for s, when in enumerate(strata.values())), F.lit(0))
    i = items.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("string").alias("key"), F.col(vector).alias("v"), marks.alias("marks"))
    if all(when is not None for when in strata.values()):
        i = i.filter("marks <> 0")
    return q.withColumn("grp", F.size("v")), i.withColumn("grp", F.size("v"))


def knn_strata(queries: DataFrame, items: DataFrame, k: int, strata: dict[str, Column | None], query: str = "query_id", key: str = "id", vector: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """(query, key, stratum, score, rank): the k best cosines per query among the items of each named condition (None: all), in one pass."""
    q, i = (stage(side, name) for side, name in zip(_sides(queries, items, query, key, vector, strata), ("asked", "held"), strict=True))
    return _ranked(block_product(q, i, k, len(strata), exclude_self), k, list(strata), query, key)


def _ranked(found: DataFrame, k: int, strata: list[str], query: str, key: str) -> DataFrame:
    named = F.get(F.array(*map(F.lit, strata)), F.col("stratum"))
    best = top_k(found, k, [F.desc("score"), F.col("key")], ["q", "stratum"])
    return best.select(F.col("q").alias(query), F.col("key").alias(key), named.alias("stratum"), "score", F.col("rn").alias("rank"))


def knn(queries: DataFrame, items: DataFrame, k: int, query: str = "query_id", key: str = "id", vector: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """(query, key, score, rank) of the k best cosines per query, ties by key. Filters on ``items`` belong below this operator, where the scan sees them."""
    return knn_strata(queries, items, k, {"all": None}, query, key, vector, exclude_self).drop("stratum")


class InvertedFile:
    """Items by the cell of their nearest centroid, staged once for any number of searches.

    ``cells`` centroids (the square root of the number of items, at most ``MOST_CELLS``) are trained by k-means on at most ``TRAINING`` items,
    drawn by hash; every item is indexed. Vectors are compared by direction. Vectors of another length than the most common one in
    the training sample can't be told a cell and stay in a cell of their own length, which queries of that length search whole.

    ``probes``, the number of nearest cells that a query searches, is measured: so many hold ``recall`` of the ten nearest neighbours of
    ``TRIALS`` sampled items inside the sample. Vectors in clusters need few cells, vectors without structure most of them. In all
    items neighbours lie nearer than in the sample, so recall is rather higher.
    """

    def __init__(self, items: DataFrame, key: str = "id", vector: str = "embedding", cells: int | None = None, recall: float = RECALL, seed: int = 17):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        _, held = _sides(items.limit(0), items, key, key, vector, {"all": None})
        held = stage(held, "vectors")
        sample = held.withColumn("h", F.xxhash64(F.lit(seed), "key")).orderBy("h").limit(TRAINING)
        sample = stage(sample, "training")
        common = sample.groupBy("grp").count().orderBy(F.desc("count"), "grp").first()
        self.width, self.centroids, self.probes = (common["grp"] if common else 0), np.zeros((0, 1)), 1
        if common:
            most = max(1, min(MOST_CELLS, cells or round(held.count() ** 0.5), common["count"]))
            vectors = sample.filter(F.col("grp") == self.width).select(array_to_vector(_direction(F.col("v"))).alias("features"))
            model = KMeans(k=most, seed=seed, maxIter=10).fit(vectors)
            self.centroids = _rows(np.array(model.clusterCenters()))
            self.probes = self._measured(sample.filter(F.col("grp") == self.width), recall)
        self.items = stage(self._placed(held, 1), "cells")
        unstage(held, sample)

    def _measured(self, sample: DataFrame, recall: float) -> int:
        """How many nearest cells hold ``recall`` of the neighbours of the sample's first items."""
        trial = stage(sample.orderBy("h").limit(TRIALS).select(F.col("key").alias("q"), "grp", "v"), "trial")
        near = block_product(trial, sample.drop("h"), 10, 1, exclude_self=True)
        near = top_k(near, 10, [F.desc("score"), F.col("key")], ["q"]).select("q", "key")
        pairs = near.join(trial.select("q", F.col("v").alias("a")), "q").join(sample.select("key", F.col("v").alias("b")), "key").select("a", "b").collect()
        unstage(trial)
        if not pairs:
            return 1
        # at most ten pairs for each trial
        mine, theirs = (_rows(np.array([r[side] for r in pairs], dtype=np.float64)) @ self.centroids.T for side in ("a", "b"))
        cell = theirs.argmax(axis=1)
        places = np.sort((mine > mine[np.arange(len(cell)), cell][:, None]).sum(axis=1))
        return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1

    def _placed(self, rows: DataFrame, probes: int) -> DataFrame:
        """``rows`` once for each of their ``probes`` nearest cells."""
        centroids, width = self.centroids, self.width

        def place(batches):
            for batch in batches:
                sizes = batch.column(batch.schema.get_field_index("grp")).to_numpy()
                mine = np.flatnonzero(sizes == width)
                cells = np.full((len(sizes), 1), -1) - sizes[:, None]  # vectors of other lengths: a cell for each length
                times = np.ones(len(sizes), dtype=np.int64)
                if len(mine):
                    sims = _unit(pa.chunked_array([batch.column(batch.schema.get_field_index("v")).take(pa.array(mine))]), len(mine)) @ centroids.T
                    n = min(probes, len(centroids))
                    best = np.argsort(-sims, axis=1, kind="stable")[:, :n]
                    cells = np.repeat(cells, n, axis=1)
                    cells[mine] = best
                    times[mine] = n
                at = np.repeat(np.arange(len(sizes)), times)
                flat = np.concatenate([cells[r, :t] for r, t in enumerate(times)]) if len(sizes) else np.zeros(0)
                out = batch.take(pa.array(at))
                yield out.set_column(out.schema.get_field_index("grp"), "grp", pa.array(flat.astype(np.int32)))

        return rows.mapInArrow(place, rows.schema)

    def search(self, queries: DataFrame, k: int, query: str = "query_id", key: str = "id", vector: str = "embedding", probes: int | None = None) -> DataFrame:
        """(query, key, score, rank): exact cosines of the items in the ``probes`` cells (as measured, if None) that lie nearest to the query."""
        asked, _ = _sides(queries, queries.limit(0), query, query, vector, {"all": None})
        near = stage(self._placed(asked, probes or self.probes), "probes")
        return _ranked(block_product(near, self.items, k), k, ["all"], query, key).drop("stratum")


def _direction(v: Column) -> Column:
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def _rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
