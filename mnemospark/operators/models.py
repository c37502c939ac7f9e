"""Seams for models: an embedder and a pair scorer as iterator UDFs, with the checks that keep a bad model's answers out.

``load`` returns the model and is called once a worker, not once a batch. An embedder maps a list of texts to as many vectors of
``dim`` finite numbers; anything else ends the job with the reason. A pair scorer maps a query and a list of texts to as
many finite scores; if it fails or answers with fewer, more or other things, the pairs of that query get null, and
``retrieval.rerank`` leaves that query's order as it was.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_loaded: dict[str, Any] = {}


def _model(load: Callable[[], Any], number: str) -> Any:
    if number not in _loaded:
        _loaded[number] = load()
    return _loaded[number]


def embedder(load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], dim: int, prefix: str = ""):
    """A column function of texts to vectors of ``dim``; ``prefix`` goes before each text, as some models want for queries. Null and blank texts get null."""
    number = uuid.uuid4().hex

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(load, number)
        for part in texts:
            asked = [i for i, t in enumerate(part) if t is not None and t.strip()]
            out: list[list[float] | None] = [None] * len(part)
            if asked:
                found = [list(map(float, v)) for v in model([prefix + part.iloc[i] for i in asked])]
                if len(found) != len(asked):
                    raise ValueError(f"the embedder gave {len(found)} vectors for {len(asked)} texts")
                for i, v in zip(asked, found, strict=True):
                    if len(v) != dim:
                        raise ValueError(f"the embedder gave a vector of {len(v)} numbers, not {dim}")
                    if not all(map(math.isfinite, v)):
                        raise ValueError("the embedder gave a number that is not finite")
                    out[i] = v
            yield pd.Series(out)

    return embed


def pair_scorer(load: Callable[[], Callable[[str, list[str]], Sequence[float]]]):
    """A column function of (query, text) to a score, null for all pairs of a query in a batch for which the model fails."""
    number = uuid.uuid4().hex

    @F.pandas_udf("double")
    def scored(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _model(load, number)

        def one(query: str, texts: list[str]) -> list[float | None]:
            try:
                got = [float(x) for x in model(query, texts)]
            except Exception:  # whatever the model raises: this query keeps its order
                return [None] * len(texts)
            return got if len(got) == len(texts) and all(map(math.isfinite, got)) else [None] * len(texts)

        for queries, texts in pairs:
            out = np.full(len(queries), np.nan, dtype=object)
            for query, rows in queries.groupby(queries, dropna=True).groups.items():
                places = [queries.index.get_loc(r) for r in rows]
                out[places] = one(query, [texts.iloc[i] or "" for i in places])
            yield pd.Series([None if x is None or x != x else x for x in out], dtype="float64")

    return scored


def hashed_terms(dim: int) -> Callable[[list[str]], list[np.ndarray]]:
    """Offline embedder: signed hashing of terms to a unit vector."""
    import re

    def model(texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            v = np.zeros(dim, dtype=np.float32)
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h >> 31 else -1.0
            out.append(v / max(float(np.linalg.norm(v)), 1e-9))
        return out

    return model
