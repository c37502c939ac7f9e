"""Text columns: normalisation, hashes, token estimates, language labels."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Language label by file extension.
LANGUAGES = {"md": "markdown", "markdown": "markdown", "mdx": "markdown", "rs": "rust", "py": "python", "pyi": "python", "sh": "shell", "bash": "shell", "zsh": "shell", "toml": "toml"}


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC; only rows that are not ASCII need it."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def normalised(text: Column) -> Column:
    """NFC, one CR off each line, right-trimmed lines, single blank lines, no outer blanks."""
    t = F.when(F.octet_length(text) == F.length(text), text).otherwise(nfc(text))
    lines = F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "\r$", ""), r"\s+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def content_hash(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def acceptable(text: Column, tags: Column, most: int = 32, longest: int = 64) -> Column:
    """Whether a row may be written: some text, at most ``most`` tags, each of 1 to ``longest`` characters; null tags are none."""
    own = F.coalesce(tags, F.array().cast("array<string>"))
    return F.coalesce(F.length(normalised(text)) > 0, F.lit(False)) & (F.size(own) <= most) & F.forall(own, lambda t: F.coalesce(F.length(t).between(1, longest), F.lit(False)))


def token_estimate(text: Column) -> Column:
    """2 + max(ceil(ascii / 3) + other characters, words)."""
    other = F.length(F.regexp_replace(text, "[\\x00-\\x7F]", ""))
    return F.lit(2) + F.greatest(F.ceil((F.length(text) - other) / 3) + other, F.regexp_count(text, F.lit("\\S+")))


def oversize(rows: DataFrame, text: str = "text", ceiling: int = 512) -> DataFrame:
    """The rows that an embedder of this ceiling would refuse, with chars, estimate, ceiling, max_chars (what ASCII would fit) and their whole text."""
    sized = rows.withColumn("estimate", token_estimate(F.col(text)).cast("bigint")).filter(F.col("estimate") > ceiling)
    return sized.withColumns({"chars": F.length(text).cast("bigint"), "ceiling": F.lit(ceiling), "max_chars": F.lit((ceiling - 2) * 3)})


def json_cost(*columns: Column | str) -> Column:
    """ceil(characters / 4) of the row's JSON."""
    return F.ceil(F.length(F.to_json(F.struct(*columns))) / 4)


def language_of(path: Column) -> Column:
    """Label by the path's extension in any case of letters; null for plain text."""
    ext = F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext)


@F.pandas_udf(T.StringType())
def canonical_json(payload: pd.Series) -> pd.Series:
    """Compact JSON with sorted keys; null for a payload that is no JSON."""

    def one(p: str | None) -> str | None:
        try:
            return None if p is None else json.dumps(json.loads(p), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return payload.map(one)


def fact_hash(kind: Column, payload: Column) -> Column:
    """SHA-256 of the kind, a zero byte and the canonical payload."""
    return F.sha2(F.concat(kind, F.lit("\0"), canonical_json(payload)), 256)


def terms(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
