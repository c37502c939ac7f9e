"""A staged inverted index: term -> (id, positions), written once, extended in parts, met by a query's rarest term.

Every part is a folder of Parquet files of (term, id, positions), sorted by term inside each file, so that a search for few
terms reads few row groups. A file holds the postings of the rows that its task read, so building shuffles nothing, and a
term that is in every text lies in all files. ``add`` writes one more part; an id that it holds replaces that id in all parts before it. A search never sees a text: it
counts the wanted terms, meets each query's rarest one, and looks the others up by (term, id): the next rarest ones one by one, which
leaves few rows for all others.

``holding`` answers a whole table of queries from rows that no index holds, in one scan and without Python: each row meets the queries whose rarest term
it has and is tested there for their next rarest ones, so that only what holds all of these leaves the scan.

Defined results: null ids and null texts are not indexed; an id added again without terms is gone; an empty corpus is an index without rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import broadcast_if_small, shared_folder, stage

POSTING = "term string, id string, positions array<int>"
#: Rarest terms of a query that a row is tested for where it is read, and those that an index looks up one by one.
TESTED, STEPS = 8, 4
#: Terms that are turned into postings at once.
TURNED = 1 << 20


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = batch.column(1).offsets.to_numpy()
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + TURNED, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, own) as postings, sorted by numbers of terms in slices of batches with about ``TURNED`` terms."""
    for batch in (part for whole in batches for part in _slices(whole)):
        own = batch.column(1)
        words = own.flatten().dictionary_encode()
        sizes = np.diff(own.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        term = words.indices.to_numpy().astype(np.int64)
        order = np.lexsort((at, row, term))
        row, term = row[order], term[order]
        first = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(row) != 0)]) if len(row) else np.zeros(0, np.int64)
        places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype(np.int32)), pa.array(at[order].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(term[first])), batch.column(0).take(pa.array(row[first])), places], names=["term", "id", "positions"])


class Postings:
    """An index below ``path`` (a fresh folder in the shared folder if None) of the term arrays of rows."""

    def __init__(self, spark: SparkSession, path: str | None = None, parts: int = 0):
        self.spark, self.path, self.parts = spark, path or f"{shared_folder(spark)}/postings", parts

    @classmethod
    def of(cls, rows: DataFrame, own: Column, key: str = "id", path: str | None = None) -> Postings:
        """An index of one part; ``own`` is a row's array of terms in order."""
        return cls(rows.sparkSession, path).add(rows, own, key)

    def add(self, rows: DataFrame, own: Column, key: str = "id") -> Postings:
        """The index with one more part; what had been written stays as it is. A part that is written again replaces itself."""
        texts = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), own.alias("own")).filter(F.size("own") > 0)
        texts.mapInArrow(_turned, POSTING).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.path}/terms/part={self.parts}")
        if self.parts:
            ids = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id")).distinct()
            ids.write.mode("overwrite").parquet(f"{self.path}/ids/part={self.parts}")
        return Postings(self.spark, self.path, self.parts + 1)

    def read(self) -> DataFrame:
        """(term, id, positions), each id as its last part has it."""
        rows = self.spark.read.schema(POSTING + ", part int").parquet(f"{self.path}/terms")
        if self.parts < 2:
            return rows.filter(F.col("part") < self.parts).drop("part")
        last = self.spark.read.schema("id string, part int").parquet(f"{self.path}/ids").filter(F.col("part") < self.parts).groupBy("id").agg(F.max("part").alias("last"))
        joined = rows.filter(F.col("part") < self.parts).join(broadcast_if_small(last, F.octet_length("id") + 16), "id", "left")
        return joined.filter(F.coalesce("last", F.lit(0)) <= F.col("part")).select("term", "id", "positions")

    def holders(self, asked: DataFrame, query: str = "one") -> DataFrame:
        """(query, id, places): the ids that hold every term of ``asked`` (query, wanted: distinct terms), with the positions of each.

        Candidates are the postings of each query's rarest term; a query with a term that nothing holds has none.
        """
        every = self.read()
        each = asked.select(query, F.explode("wanted").alias("term"), F.size("wanted").alias("n_terms"))
        words = broadcast_if_small(each.select("term").distinct(), F.octet_length("term") + 16)
        counts = every.join(words, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        ranked = stage(each.join(counts, "term", "left"), "terms_asked")
        # the terms of one query
        order = Window.partitionBy(query).orderBy(F.coalesce("df", F.lit(0)), "term")
        placed = ranked.withColumns({"nth": F.row_number().over(order), "least": F.min(F.coalesce("df", F.lit(0))).over(Window.partitionBy(query))}).filter("least > 0")
        placed = stage(placed.select(query, "term", "n_terms", "nth"), "terms_placed")
        rare = broadcast_if_small(placed.filter("nth = 1").select(query, "term", "n_terms"), F.octet_length("term") + 64)
        met = every.join(rare, "term").select(query, "id", "n_terms", F.col("positions").alias("first"))
        single = met.filter("n_terms = 1").select(query, "id", F.array("first").alias("places"))
        met = stage(met.filter("n_terms > 1"), "met")
        alive = met.select(query, "id", "n_terms")
        for nth in range(2, STEPS + 1):  # all terms of every row with a rare one would be quadratic in the rows
            next_ = broadcast_if_small(alive.join(placed.filter(F.col("nth") == nth).select(query, "term"), query), F.octet_length("term") + 64)
            alive = stage(every.select("term", "id").join(next_, ["term", "id"]).select(query, "id", "n_terms").unionByName(alive.filter(F.col("n_terms") < nth)), "alive")
        met = met.join(alive.select(query, "id"), [query, "id"])
        others = met.select(query, "id").join(placed.filter("nth > 1").select(query, "term"), query)
        found = every.join(broadcast_if_small(others, F.octet_length("term") + 64), ["term", "id"]).groupBy(query, "id").agg(F.count(F.lit(1)).alias("n"), F.collect_list("positions").alias("rest"))
        held = met.join(found, [query, "id"]).filter("n = n_terms - 1")
        return single.unionByName(held.select(query, "id", F.concat(F.array("first"), "rest").alias("places")))


def holding(rows: DataFrame, once: DataFrame, *shown: Column) -> DataFrame:
    """(one, id, n_terms, own, *shown) of the rows (id, own: distinct terms) that hold the first ``TESTED`` of the terms of ``once`` (one, wanted: distinct terms), rarest first.

    ``own`` is null where a query has no more terms; the others are to be compared by ``holds_all``. ``shown`` are columns
    of the rows, of ``n_terms`` and of the tested terms ``t0``, ``t1``..., null where a query has fewer. Queries that
    one broadcast can't hold are dealt to several scans.
    """
    words = broadcast_if_small(once.select(F.explode("wanted").alias("term")).distinct(), F.octet_length("term") + 16)
    counts = rows.select(F.explode("own").alias("term")).join(words, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    each = once.select("one", F.size("wanted").alias("n_terms"), F.explode("wanted").alias("term"))
    each = each.join(broadcast_if_small(counts, F.octet_length("term") + 24), "term")
    # the terms of one query; one that nothing holds leaves fewer
    ranked = each.groupBy("one", "n_terms").agg(F.sort_array(F.collect_list(F.struct("df", "term"))).alias("r")).filter(F.size("r") == F.col("n_terms"))
    tested = [f"t{n}" for n in range(TESTED)]
    asked = stage(ranked.select("one", "n_terms", *[F.get("r", F.lit(n))["term"].alias(t) for n, t in enumerate(tested)]), "rarest")
    size = asked.agg(F.sum(F.octet_length(F.concat_ws("", *tested)) + 96)).first()[0] or 0
    scans = size // (64 << 20) + 1
    out = None
    for n in range(scans):
        some = F.broadcast(asked.filter(F.pmod(F.xxhash64("one"), F.lit(scans)) == n) if scans > 1 else asked)
        met = rows.select("*", F.explode("own").alias("term")).join(some, F.col("term") == F.col("t0"))
        for t in tested[1:]:
            met = met.filter(F.col(t).isNull() | F.array_contains("own", F.col(t)))
        part = met.select("one", "id", "n_terms", F.when(F.col("n_terms") > TESTED, F.col("own")).alias("own"), *shown)
        out = part if out is None else out.unionByName(part)
    return stage(out, "met")


def holds_all(wanted: str, own: str) -> Column:
    """Whether the array ``own`` has all that ``wanted`` has."""
    return F.size(F.array_except(wanted, own)) == 0


def spans(places: list[np.ndarray]) -> float:
    """Sum over the minimal spans that hold a position of every term of (number of terms) / length."""
    n = len(places)
    if n == 1:
        return float(len(places[0]))
    at = np.concatenate(places)
    by = np.argsort(at, kind="stable")
    term = np.repeat(np.arange(n), [len(p) for p in places])[by]
    last: OrderedDict[int, int] = OrderedDict()  # least recently seen term first
    total, start = 0.0, -1
    for p, t in zip(at[by].tolist(), term.tolist(), strict=True):
        last[t] = p
        last.move_to_end(t)
        if len(last) == n:
            low = next(iter(last.values()))
            if low > start:
                total, start = total + n / float(p - low + 1), low
    return total


@F.arrow_udf(T.DoubleType())
def cover_density(places: pa.Array) -> pa.Array:
    """``spans`` of each row's array of the positions of each wanted term; only one row's arrays are Python objects at a time."""
    rows, at = places.offsets.to_numpy(), places.values.offsets.to_numpy()
    flat = places.values.values.to_numpy(zero_copy_only=False)
    each = ([flat[at[t] : at[t + 1]] for t in range(rows[n], rows[n + 1])] for n in range(len(places)))
    return pa.array((spans(p) for p in each), pa.float64(), size=len(places))
