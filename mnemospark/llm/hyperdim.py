"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound by multiplying the vectors of its
letters, each rotated by its place; a document is the bundle (sum) of its trigrams; a language's
prototype is the bundle of its training documents, each weighing the same. A document gets the
language whose prototype has the largest cosine.

Defined results: null text, empty text and text without a letter give ``und`` and score 0; ties go
to the language that sorts first; without training rows everything is ``und``. Other columns of the
input are ignored. In texts of more than PIECE_CHARS code points a space is read at every cut. What reaches the driver is one vector per distinct training language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, released, remembered, slices, unused

DIMENSIONS = 1024
SEED = 20240
#: Trigram vectors a Python worker remembers (1 KB each); older ones are made again when needed.
REMEMBERED = 32_000
#: Documents and code points bundled by one matrix product, and vectors of it at once.
BLOCK, BLOCK_CHARS, BLOCK_GRAMS = 256, 1 << 19, 4096
#: A longer text is bundled piece by piece.
PIECE_CHARS = 1 << 17


def trigrams(text: str, letters: np.ndarray) -> np.ndarray:
    """Packed trigrams of the lower-cased text, every run of non-letters being one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = letters[codes]
    if not letter.any():
        return np.empty(0, dtype=np.uint64)
    codes = np.where(letter, codes, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = letter[0]
    codes = np.concatenate(([32], codes[keep], [32] if letter[-1] else [])).astype(np.uint64)
    return (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]


class Space:
    """Trigram vectors, made from letter vectors on demand."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.slot: dict[int, int] = {}
        self.rows = np.empty((REMEMBERED, dimensions), dtype=np.int8)
        #: For each code point whether it is a letter.
        self.isalpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= 20_000:
                self.letters.clear()
            bits = np.random.Generator(np.random.PCG64([self.seed, code])).integers(0, 2, self.dimensions, dtype=np.int8)
            self.letters[code] = bits * 2 - 1
        return self.letters[code]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """The grams' vectors as rows of float32; at most REMEMBERED grams at once."""
        listed = grams.tolist()
        if len(self.slot) + sum(g not in self.slot for g in listed) > REMEMBERED:
            self.slot.clear()
        for g in listed:
            if g not in self.slot:
                a, b, c = g >> 42, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF
                self.slot[g] = k = len(self.slot)
                self.rows[k] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
        return self.rows[[self.slot[g] for g in listed]].astype(np.float32)


def _space(dimensions: int, seed: int) -> Space:
    return remembered(f"hyperdim {dimensions} {seed}", lambda: Space(dimensions, seed))


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Blocks of at most BLOCK texts and about BLOCK_CHARS code points: their rows and texts.

    A text of more than PIECE_CHARS comes in pieces whose trigrams are counted on their own: a cut is read like a space.
    """
    rows, held, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text or ""), 1), PIECE_CHARS):
            piece = (text or "")[at : at + PIECE_CHARS]
            if held and (len(held) == BLOCK or size + len(piece) > BLOCK_CHARS):
                yield rows, held
                rows, held, size = [], [], 0
            rows.append(i), held.append(piece)
            size += len(piece)
    if held:
        yield rows, held


def _bundles(texts: list[str | None], space: Space) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, vector, trigram count) of each text in order."""
    last, vector, count = 0, np.zeros(space.dimensions, np.float32), 0
    for rows, held in _pieces(texts):
        grams = [trigrams(t, space.isalpha) if t else np.empty(0, np.uint64) for t in held]
        sizes = np.array([len(g) for g in grams])
        every, column = np.unique(np.concatenate(grams), return_inverse=True)
        out = np.zeros((len(grams), space.dimensions), dtype=np.float32)
        row = np.repeat(np.arange(len(grams)), sizes)
        for lo in range(0, len(every), BLOCK_GRAMS):  # bounds memory for texts of many scripts
            hi = min(lo + BLOCK_GRAMS, len(every))
            mine = (column >= lo) & (column < hi)
            cells = np.bincount(row[mine] * (hi - lo) + column[mine] - lo, minlength=len(grams) * (hi - lo))
            out += cells.reshape(len(grams), hi - lo).astype(np.float32) @ space.vectors(every[lo:hi])
        for i, v, n in zip(rows, out, sizes.tolist(), strict=True):
            if i != last:
                yield last, vector, count
                last, vector, count = i, v, n
            else:
                vector, count = vector + v, count + n
    if texts:
        yield last, vector, count


def prototypes(train: DataFrame, text: str, lang: str, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Unit prototype vector of each language in ``train`` (rows with null language must be gone)."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = _space(dimensions, seed), {}
        for batch in released(batches):
            for part in slices(batch, 0):
                langs = part.column(1).to_pylist()
                for i, vector, n in _bundles(part.column(0).to_pylist(), space):
                    if n:
                        sums[langs[i]] = sums.get(langs[i], 0) + (vector / n).astype(np.float64)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "v": pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))})

    parts = bounded_batches(train).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(bundle, "lang string, v array<double>")
    # sums of rounded values don't depend on the order in which tasks end
    cells = parts.select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum(F.round(F.col("x") * 1e6).cast("long")).alias("x"))
    found: dict[str, np.ndarray] = {}
    for r in cells.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v")).collect():
        v = np.array([c["x"] for c in r["v"]], dtype=np.float64)
        if (norm := np.linalg.norm(v)) > 0:
            found[r["lang"]] = (v / norm).astype(np.float32)
    return dict(sorted(found.items()))


def identify(docs: DataFrame, protos: dict[str, np.ndarray], text: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED, keep: list[Column] | None = None, pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``keep`` columns (by default all) plus the predicted language and the cosine cut to 0..1; input columns of these two names give way."""
    names = list(protos)
    matrix = np.stack([protos[n] for n in names], axis=1) if names else np.zeros((dimensions, 0), np.float32)
    (body,) = unused(docs, "__text")
    chosen = docs.select(*(keep if keep is not None else [F.col(f"`{c}`") for c in docs.columns if c not in (pred_col, score_col)]), F.col(text).alias(body))
    schema = T.StructType([*chosen.schema.fields[:-1], T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = _space(dimensions, seed)
        for batch in released(batches):
            for part in slices(batch, batch.num_columns - 1):
                best, score = ["und"] * part.num_rows, [0.0] * part.num_rows
                for i, vector, n in _bundles(part.column(part.num_columns - 1).to_pylist(), space) if names else ():
                    if n:
                        cosines = (vector @ matrix) / max(float(np.linalg.norm(vector)), 1e-9)
                        top = int(cosines.argmax())
                        best[i], score[i] = names[top], float(min(1.0, max(0.0, cosines[top])))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(best, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return bounded_batches(chosen).mapInArrow(predict, schema)


def held_out(doc_id: Column) -> Column:
    """True for the fold that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learnt from the documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    protos = prototypes(docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()), "text", "lang")
    return identify(docs, protos, keep=[F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")])
