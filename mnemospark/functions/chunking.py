"""Chunks of documents: sections under heading paths, blank-line blocks and bounded windows; as a table job and as an SQL table function.

Markdown is read line by line with two states. Outside a fence a line opens a fence (three or more backticks, without another one
behind them, or tildes), is a heading, or is text; inside one only a line of at least as many of the same character
closes it, and all else is text, up to the end if nothing does. Four columns of indent, or a tab, make any line text. A heading's text, blank
lines and fences included, is one block under the path of headings above it; a heading without text is part of paths only. Other texts are blocks
between blank lines.

Blocks of one path are packed while they stay within ``TARGET`` bytes; a longer block is cut into windows of ``TARGET`` characters that overlap.
A packed piece under ``LEAST`` bytes joins the one before it if the path is the same; a markdown piece under ``LEAST_BODY`` characters is dropped. The
path stands before the text of a chunk. Chunks over the token ceiling are cut into smaller windows until all fit.

Defined results: null, empty and blank texts have no chunks; repeated rows have chunks of their own. Texts are normalised first. Code is
chunked like plain text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import normalised

TARGET, OVERLAP, LEAST, LEAST_BODY = 800, 200, 64, 40
#: Token estimate that no chunk exceeds.
CEILING = 512
SCHEMA = "id string, chunk_index int, heading_path string, text string, chunk_hash string"

_INDENT = r" {0,3}(?![ \t])\s*"
_OPENS = re.compile(_INDENT + r"(?P<mark>`{3,}(?=[^`]*\Z)|~{3,})")
_HEADING = re.compile(_INDENT + r"(?P<level>#{1,6})[ \t](?P<title>.*)")

Block = tuple[str | None, str]


def _sections(text: str) -> Iterator[Block]:
    """(heading path, text) of each section of markdown that has text."""
    titles: dict[int, str] = {}
    path: str | None = None
    held: list[str] = []
    closes: re.Pattern[str] | None = None
    for line in text.split("\n"):
        if closes:
            closes = None if closes.fullmatch(line) else closes
        elif opened := _OPENS.match(line):
            mark = opened["mark"]
            closes = re.compile(_INDENT + re.escape(mark[0]) + "{%d,}\\s*" % len(mark))
        elif heading := _HEADING.match(line):
            if any(map(str.strip, held)):
                yield path, "\n".join(held)
            held = []
            level = len(heading["level"])
            titles = {n: t for n, t in titles.items() if n < level} | {level: heading["title"].strip()}
            path = " > ".join(titles.values())
            continue
        held.append(line)
    if any(map(str.strip, held)):
        yield path, "\n".join(held)


def windows(text: str, size: int, overlap: int) -> list[str]:
    """The text in windows of ``size`` characters, each of which repeats the last ``overlap`` of the one before."""
    step = max(1, size - overlap)
    last = max(0, -(-(len(text) - size) // step))
    return [text[n * step : n * step + size] for n in range(last + 1)]


def _packed(blocks: Iterable[Block], target: int, overlap: int) -> list[Block]:
    """Blocks joined within the target, or cut into windows above it."""
    groups: list[tuple[str | None, list[str], bool]] = []  # path, blocks, whether it is cut
    for path, body in blocks:
        body = body.strip()
        if not body:
            continue
        size = len(body.encode())
        if size > target:
            groups.append((path, windows(body, target, overlap), True))
        elif groups and not groups[-1][2] and groups[-1][0] == path and len("\n\n".join(groups[-1][1]).encode()) + size + 2 <= target:
            groups[-1][1].append(body)
        else:
            groups.append((path, [body], False))
    out: list[Block] = []
    for path, parts, cut in groups:
        text = "\n\n".join(parts)
        if cut:
            out += [(path, p) for p in parts]
        elif len(text.encode()) < LEAST and out and out[-1][0] == path:
            out[-1] = (path, f"{out[-1][1]}\n\n{text}")
        else:
            out.append((path, text))
    return out


def token_estimate(text: str) -> int:
    """As the column function of this name in ``text``."""
    plain = len(text.encode("ascii", "ignore"))
    return 2 + max(-(-plain // 3) + len(text) - plain, len(re.findall(r"[^ \t\n\x0b\f\r]+", text)))


def fitting(text: str, ceiling: int) -> list[str]:
    """The text, or the widest of its windows, halved each time, whose token estimates are all within the ceiling; at the least of ``LEAST`` characters."""
    size = len(text)
    if token_estimate(text) <= ceiling:
        return [text]
    size = max(0, ceiling - 2) * 3
    while size >= LEAST:
        parts = windows(text, size, min(OVERLAP, size // 4))
        if all(token_estimate(p) <= ceiling for p in parts):
            return parts
        size //= 2
    return windows(text, LEAST, LEAST // 4)


def chunks_of(text: str | None, markdown: bool, target: int = TARGET, overlap: int = OVERLAP, ceiling: int = CEILING) -> Iterator[Block]:
    """(heading path, chunk) of a normalised text, in order."""
    blocks = _sections(text or "") if markdown else ((None, p) for p in (text or "").split("\n\n"))
    for path, body in _packed(blocks, target, overlap):
        if not markdown or len(body.strip()) >= LEAST_BODY:
            whole = (body if path is None else f"{path}\n\n{body}").strip()
            yield from ((path, piece) for piece in fitting(whole, ceiling) if whole)


def chunk_documents(docs: DataFrame, id_col: str = "id", text_col: str = "text", language_col: str | None = None, target: int = TARGET, ceiling: int = CEILING) -> DataFrame:
    """One row per chunk with a gapless index per document and the chunk's hash; ``language_col`` says which texts are markdown (all, if None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text, lang in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                for n, (path, body) in enumerate(chunks_of(text, lang == "markdown", target, ceiling=ceiling)):
                    rows.append((i, n, path, body, hashlib.sha256(body.encode()).hexdigest()))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(5)], names=["id", "chunk_index", "heading_path", "text", "chunk_hash"])

    lang = F.col(language_col) if language_col else F.lit("markdown")
    return docs.select(F.col(id_col).cast("string"), normalised(F.col(text_col)), lang).mapInArrow(run, SCHEMA)


def register_chunks(spark: SparkSession, name: str = "chunks") -> None:
    """The table function ``chunks(text, language)`` for SQL: ``SELECT d.id, c.* FROM docs d, LATERAL chunks(d.text, d.language) c``.

    The text is to be normalised (as ``chunk_documents`` does) before it comes here.
    """

    @F.udtf(returnType="chunk_index int, heading_path string, text string, chunk_hash string", useArrow=True)
    class Chunks:
        def eval(self, text: str, language: str):
            for n, (path, body) in enumerate(chunks_of(text, language == "markdown")):
                yield n, path, body, hashlib.sha256(body.encode()).hexdigest()

    spark.udtf.register(name, Chunks)
