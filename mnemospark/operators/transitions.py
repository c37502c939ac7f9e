"""Requests that change keyed rows, worked off in order: each sees what those before it left.

``apply_in_order`` is the batch form: the rows that requests name and the requests themselves are dealt by key and read as one sorted
stream, of which a task holds the row of one key. Rows that no request names never reach Python. ``TransitionProcessor`` is its twin
for a stream of requests, with the row in keyed state. A transition is a function ``(row | None, request) -> (row | None,
outcome, version)`` over dicts; None is a row that doesn't exist. It may leave private keys (``_name``) in a row, which
live as long as the key's requests and are not written; a row with ``_none`` has nothing else.

Defined results: requests of one key go by ``seq``, ties by the request's other columns; a request without a key or with an unknown one meets
None. A key that most requests name is worked off by one task, in order, as its meaning demands, in bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.staging import stage

Row = dict[str, Any]
Transition = Callable[[Row | None, Row], tuple[Row | None, str, int | None]]


#: Rows of requests that a task is dealt.
ROWS = 500_000


def shares(requests: DataFrame) -> int:
    """In how many parts requests are dealt, so that a task's share doesn't grow with them; a given number is not coalesced, as rows that compress well would be."""
    return max(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), requests.count() // ROWS + 1)


def apply_in_order(state: DataFrame, requests: DataFrame, step: Transition, key: str = "id", parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(next state, outcomes): outcomes are (seq, key, outcome, version), one for each request (seq, key, ...).

    ``state`` has one row a key. Rows that end as None are gone from the next state. ``parts`` are the requests' ``shares``, if they are known.
    """
    kept, asked = T.StructType(state.schema.fields), T.StructType(requests.schema.fields)
    kept_names, asked_names = [f"s_{f.name}" for f in kept], [f"r_{f.name}" for f in asked]
    none = lambda names, fields: [F.lit(None).cast(f.dataType).alias(n) for n, f in zip(names, fields, strict=True)]
    named = requests.select(F.col(key).alias("k")).distinct()
    rows = state.join(named, state[key] == named["k"], "left_semi")
    before = rows.select(F.col(key).alias("k"), F.lit(None).cast("bigint").alias("seq"), *[F.col(f.name).alias(n) for n, f in zip(kept_names, kept, strict=True)], *none(asked_names, asked))
    each = requests.select(F.col(key).alias("k"), F.col("seq").cast("bigint").alias("seq"), *none(kept_names, kept), *[F.col(f.name).alias(n) for n, f in zip(asked_names, asked, strict=True)])
    plain = [n for n, f in zip(asked_names, asked, strict=True) if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    dealt = before.unionByName(each).repartition(parts or shares(requests), "k").sortWithinPartitions("k", F.col("seq").asc_nulls_first(), *plain)
    key_type = requests.schema[key].dataType
    out = T.StructType([T.StructField("seq", T.LongType()), T.StructField("k", key_type), T.StructField("outcome", T.StringType()), T.StructField("version", T.IntegerType()), *[T.StructField(n, f.dataType) for n, f in zip(kept_names, kept, strict=True)]])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, row, begun = None, None, False
        arrow: pa.Schema | None = None

        def told(rows: list[Row]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        def final() -> Row:
            return {"seq": None, "k": at, "outcome": None, "version": None} | {n: row[f.name] for n, f in zip(kept_names, kept, strict=True)}

        for batch in batches:
            if arrow is None:
                types = {"seq": pa.int64(), "outcome": pa.string(), "version": pa.int32()}
                arrow = pa.schema([(f.name, types.get(f.name) or batch.schema.field(f.name).type) for f in out])
            done = []
            for r in batch.to_pylist():
                if not begun or r["k"] != at:
                    if begun and row is not None and "_none" not in row:
                        done.append(final())
                    at, row, begun = r["k"], None, True
                if r["seq"] is None and all(r[n] is None for n in asked_names):
                    row = {f.name: r[n] for n, f in zip(kept_names, kept, strict=True)}
                    continue
                row, outcome, version = step(row, {f.name: r[n] for n, f in zip(asked_names, asked, strict=True)})
                done.append({"seq": r["seq"], "k": at, "outcome": outcome, "version": version} | dict.fromkeys(kept_names))
            if done:
                yield told(done)
        if begun and row is not None and "_none" not in row:
            yield told([final()])

    folded = stage(dealt.mapInArrow(fold, out), "transitions")
    outcomes = folded.filter("outcome is not null").select("seq", F.col("k").alias(key), "outcome", "version")
    after = folded.filter("outcome is null").select(*[F.col(n).alias(f.name) for n, f in zip(kept_names, kept, strict=True)])
    untouched = state.join(named, state[key] == named["k"], "left_anti")
    return untouched.unionByName(after), outcomes


class TransitionProcessor(StatefulProcessor):
    """The same transitions over a stream of requests: a key's row is its state, and each request's outcome a row.

    Requests of a micro-batch are put in ``seq`` order, whatever Arrow batches they come in; a later micro-batch comes later.
    """

    def __init__(self, step: Transition, schema: str, names: list[str]):
        self.step, self.schema, self.names = step, schema, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", self.schema)

    def _held(self) -> Row | None:
        return dict(zip(self.names, self.row.get(), strict=True)) if self.row.exists() else None

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState[self.names].itertuples(index=False):
            self.row.update(tuple(_plain(v) for v in r))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        row, out = self._held(), []
        for r in sorted((r for part in rows for r in part.to_dict("records")), key=lambda r: r["seq"]):
            row, outcome, version = self.step(row, {n: _plain(v) for n, v in r.items()})
            out.append((r["seq"], key[0], outcome, version))
        if row is None:
            self.row.clear()
        else:
            self.row.update(tuple(row[n] for n in self.names))
        yield pd.DataFrame({"seq": pd.Series([o[0] for o in out], dtype="int64"), "id": [o[1] for o in out], "outcome": [o[2] for o in out], "version": pd.array([o[3] for o in out], dtype="Int32")})

    def close(self) -> None:
        pass


def _plain(v: Any) -> Any:
    """A value as the batch form has it: pandas' missing ones are None."""
    if isinstance(v, (list, tuple, dict)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return list(v) if hasattr(v, "tolist") else v
    return None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v


def stream_transitions(state: DataFrame, requests: DataFrame, step: Transition) -> DataFrame:
    """Outcomes (seq, id, outcome, version) of a stream of requests by ``id``; ``state`` is what held before it."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema)
    kind = requests.schema["id"].dataType.simpleString()
    return requests.groupBy("id").transformWithStateInPandas(TransitionProcessor(step, schema, state.columns), f"seq bigint, id {kind}, outcome string, version int", "Append", "None", initialState=state.groupBy("id"))


# -- the transitions -----------------------------------------------------------------------------------------------


def deletion(row: Row | None, request: Row) -> tuple[Row | None, str, int | None]:
    """delete, restore or hard delete at ``at``: events (``event``) are refused, repeats do nothing, a restored row is superseded by nothing."""
    if request["event"]:
        return row, "refused", None
    if row is None:
        return row, "missing", None
    gone = row["deleted_at"] is not None
    if request["action"] == "hard":
        return None, "removed", None
    if request["action"] == "delete" and not gone:
        return row | {"deleted_at": request["at"]}, "deleted", None
    if request["action"] == "restore" and gone:
        return row | {"deleted_at": None} | ({"superseded_by": None} if "superseded_by" in row else {}), "restored", None
    return row, "noop", None


def resolution(row: Row | None, request: Row) -> tuple[Row | None, str, int | None]:
    """promote or discard of a dissent (dissent_id, with its status and payload) on its live fact, which ``row`` is.

    A dissent is resolved once. Promotion expects the version that the fact has by then, and writes payload, source and version.
    """
    done = row["_done"] if row and "_done" in row else set()
    if request["status"] is None:
        return row, "missing", None
    if request["status"] != "pending" or request["dissent_id"] in done:
        return row, "not_pending", None
    if request["action"] == "discard":
        # what is done is kept with the fact; a dissent without one is kept by an empty row that is not written
        return (row or {"_none": True}) | {"_done": done | {request["dissent_id"]}}, "discarded", None
    if row is None or "_none" in row or row["deleted_at"] is not None:
        return row, "missing", None
    if request["expected"] is not None and request["expected"] != row["version"]:
        return row, "conflict", None
    new = {"payload": request["payload"], "source": request["source"], "version": row["version"] + 1, "_done": done | {request["dissent_id"]}}
    return row | ({"payload_hash": request["payload_hash"]} if "payload_hash" in row else {}) | new, "promoted", row["version"] + 1


def update(row: Row | None, request: Row) -> tuple[Row | None, str, int | None]:
    """New text (with its hash), tags or volatility of a live agent-authored row; None leaves what is there."""
    if all(request[n] is None for n in ("text", "tags", "volatility")) or request["text"] is not None and not request["text"].strip():
        return row, "invalid", None
    if row is None or row["deleted_at"] is not None:
        return row, "missing", None
    if row["source"] != "AgentProposal":
        return row, "not_agent_authored", None
    given = {n: request[n] for n in ("text", "content_hash", "tags", "volatility") if request[n] is not None}
    return row | given, "updated", None


def supersession(row: Row | None, request: Row) -> tuple[Row | None, str, int | None]:
    """Replace ``old_id`` by ``new_id``; ``row`` is the first of the chain that both belong to, whose live members it keeps."""
    if request["text"] is None or not request["text"].strip():
        return row, "invalid", None
    if row is None:
        return row, "missing", None
    alive = row["_alive"] if "_alive" in row else frozenset({row["id"]} if row["deleted_at"] is None else ())
    if request["old_id"] not in alive:
        return row, "missing", None
    if row["source"] != "AgentProposal":
        return row, "not_agent_authored", None
    first = {"superseded_by": request["new_id"], "deleted_at": request["at"]} if request["old_id"] == row["id"] else {}
    return row | first | {"_alive": alive - {request["old_id"]} | {request["new_id"]}}, "superseded", None
