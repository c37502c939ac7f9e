"""Token ids from a public tokenizer file, with a bounded memo of white-space chunks.

Both vocabularies never join characters across a boundary found here, so encoding each distinct
chunk once and gluing the ids gives the ids of the whole text. Tests compare it with encoding whole
texts.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import remembered

#: Bytes of chunks and ids that a Python worker remembers unless the caller allows more; the memo starts over when full.
MEMO = 72 << 20
#: Bytes that a remembered chunk takes besides its characters and ids.
ENTRY = 200
#: Texts are worked off in groups of about this many characters.
GROUP_CHARS = 1_000_000
#: New chunks are encoded so many at a time; an encoding takes far more memory than its ids.
LEARNT = 4096
#: Of these, so many make a line where chunks can be told apart by their ids.
LINE = 256
#: Letters before white space, ASCII punctuation (no apostrophe, which may begin a contraction) or the end:
#: the tokenizers' patterns end a piece there too. Few of these are new, as they come without punctuation.
_LETTERS = r"[A-Za-zß-öø-ÿ]++(?=[\s!-&(-/:-@\[-`{-~]|\Z)"
#: Letters or a word with at most one space before it, or white space that no word takes.
_BYTE_CHUNKS = re.compile(rf" ?{_LETTERS}| ?\S+|\s+(?!\S)|\s+")
_WORD_CHUNKS = re.compile(rf"{_LETTERS}|\S+")
#: Words that NFC and lower-casing leave as they are.
_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
#: Python counts these as white space and the tokenizers' patterns do not.
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


class ChunkEncoder:
    """``many(texts)`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids`` of each text."""

    def __init__(self, path: str, keep_space: bool, memo: int = MEMO):
        self.most = memo
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks = (_BYTE_CHUNKS if keep_space else _WORD_CHUNKS).findall
        self.memo: dict[str, bytes] = {}
        self.held, self.starts = 0, 1
        self.lowers = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("Aß À") == "aß à"
        #: What a line of lower-case Latin-1 words (and one of ASCII words) needs in place of the tokenizer's own steps, where these make the same pieces.
        self.simple = None
        if self.lowers and self.tokenizer.pre_tokenizer is not None:
            steps = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            probe = " ".join(f"{c} {c}a{c}" for c in filter(_PLAIN, map(chr, range(256))))
            if self.tokenizer.normalizer.normalize_str(probe) == probe and self.tokenizer.pre_tokenizer.pre_tokenize_str(probe) == steps.pre_tokenize_str(probe):
                split = pre_tokenizers.CharDelimiterSplit(" ")  # a letter of ASCII stands for its own byte
                self.simple = normalizers.Sequence([]), steps, split
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Whether an id ends a word, where the vocabulary says so.
        self.last = None
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        #: Bytes that an id stands for, where a character of a token is a byte of the text.
        self.width = None
        if keep_space and self.tokenizer.normalizer is None and "ByteLevel" in str(self.tokenizer.pre_tokenizer):
            vocabulary = self.tokenizer.get_vocab()
            self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
            self.width[list(vocabulary.values())] = list(map(len, vocabulary))
        #: A text with one of these is encoded whole.
        self.odd = [*_ODD_SPACE, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]

    def folded(self, text: str) -> str:
        """The text in lower case where the tokenizer would see no difference: it lower-cases, and all is Latin-1."""
        if not self.lowers:
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    def many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text in order, as little-endian unsigned 32-bit integers."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < GROUP_CHARS):
                size += len(texts[end])
                end += 1
            yield from self._group(texts[at:end])
            at = end

    def _learn(self, unknown: list[str]) -> None:
        """Put the chunks' ids into the memo; those that stay apart in one line are encoded many at a time and cut where one ends."""
        if self.last is not None:
            words, rest = [c for c in unknown if c.isalpha()], [c for c in unknown if not c.isalpha()]
            if self.simple:
                normalizer, steps, split = self.simple
                ascii_only, words = [c for c in words if c.isascii() and c.islower()], [c for c in words if not (c.isascii() and c.islower())]
                plain, words = list(filter(_PLAIN, words)), [c for c in words if not _PLAIN(c)]
                held = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
                for own, how in ((ascii_only, split), (plain, steps)):
                    self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = normalizer, how
                    rest += self._lines(own, " ", self._word_ends)
                self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = held
            rest += self._lines(words, " ", self._word_ends)
        elif self.width is not None:
            # a piece takes at most the space before it, so a chunk that begins with one is a piece of its own after any other
            spaced, rest = [c for c in unknown if c[0] == " " and not c.isspace()], [c for c in unknown if c[0] != " " or c.isspace()]
            rest += self._lines(spaced, "", self._byte_ends)
        else:
            rest = unknown
        for i in range(0, len(rest), LEARNT):
            some = rest[i : i + LEARNT]
            for c, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.memo[c] = array("I", e.ids).tobytes()

    def _word_ends(self, own: list[str], ids: np.ndarray) -> np.ndarray:
        """How many ids end with each word."""
        return np.flatnonzero(self.last[ids]) + 1

    def _byte_ends(self, own: list[str], ids: np.ndarray) -> np.ndarray:
        """How many ids end with each chunk, by the bytes that they stand for; none where an id goes beyond a chunk."""
        have, want = np.cumsum(self.width[ids]), np.cumsum([len(c.encode()) for c in own])
        at = np.searchsorted(have, want)
        return at + 1 if at[-1] < len(have) and (have[at] == want).all() else at[:0]

    def _lines(self, chunks: list[str], between: str, ends_of) -> list[str]:
        """Encode chunks in lines; returns those whose lines were not cut into as many."""
        failed = []
        for at in range(0, len(chunks), LEARNT):
            each = [chunks[i : i + LINE] for i in range(at, min(at + LEARNT, len(chunks)), LINE)]
            for own, e in zip(each, self.tokenizer.encode_batch_fast([between.join(o) for o in each], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype="<u4")
                ends = (4 * ends_of(own, ids)).tolist()
                if len(ends) != len(own):
                    failed += own
                    continue
                raw = ids.tobytes()
                self.memo.update(zip(own, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=False))
        return failed

    def _look_up(self, flat: list[str]) -> list[bytes]:
        """Ids of each chunk; new ones are learnt."""
        found = list(map(self.memo.get, flat))
        missing = [i for i, f in enumerate(found) if f is None]
        unknown = list({flat[i] for i in missing})
        size = ENTRY * len(unknown) + 2 * sum(map(len, unknown))
        if self.held + size > self.most:
            self.memo.clear()
            self.held, self.starts = 0, self.starts + 1
        self.held += size
        self._learn(unknown)
        for i in missing:
            found[i] = self.memo[flat[i]]
        return found

    def together(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): ids of all texts one after the other, each text's followed by ``end_id``, and where each ends.

        For vocabularies that drop white space. Words are told apart in Arrow, so only different ones become Python strings.
        """
        texts = texts.fill_null("")
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), pa.scalar("\n", coded.dictionary.type))[0].as_py()
        lower = self.folded(joined)
        own = lower.split("\n") if lower is not joined else [self.folded(w) for w in joined.split("\n")]
        if not len(coded.dictionary):
            own = []
        # words of letters alone are one chunk and come first in the table, then those of several; an end is its last row
        alone = np.fromiter(map(str.isalpha, own), dtype=bool, count=len(own))
        cut = list(map(self.chunks, compress(own, (~alone).tolist())))
        flat, before = [*compress(own, alone.tolist()), *chain.from_iterable(cut)], self.starts
        found = self._look_up(flat)
        if self.starts > before:  # the memo has started over, and goes on with what these texts have
            self.memo.update(zip(flat, found, strict=True))
            self.held = sum(ENTRY + 2 * len(c) for c in set(flat))
        raw = b"".join([*found, np.array([end_id], "<u4").tobytes()])
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        chunks = np.concatenate([np.ones(len(own) - len(cut), np.int64), np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))])
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(chunks)])]
        table = pa.Array.from_buffers(pa.large_binary(), len(own) + 1, [None, pa.py_buffer(np.append(bounds, len(raw))), pa.py_buffer(raw)])
        row = np.empty(len(own), dtype=np.int32)
        row[np.concatenate([np.flatnonzero(alone), np.flatnonzero(~alone)])] = np.arange(len(own))
        at = words.offsets.to_numpy()[1:].astype(np.int64)
        taken = table.take(pa.array(np.insert(row[coded.indices.to_numpy()], at, len(own))))
        ids = np.frombuffer(taken.buffers()[2], dtype="<u4")
        ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[at + np.arange(1, len(at) + 1)] // 4
        odd = np.zeros(len(texts), dtype=bool)
        for o in self.odd:
            if o in joined or o.split() not in ([], [o]):
                odd |= pc.match_substring(texts, o).to_numpy(zero_copy_only=False)
        if odd.any():
            parts = np.split(ids, ends[:-1])
            for i in np.flatnonzero(odd):
                parts[i] = np.array([*self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, end_id], dtype="<u4")
            ids, ends = np.concatenate(parts), np.cumsum(list(map(len, parts)))
        return ids, ends

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        odd = [any(o in t for o in self.odd) for t in texts]
        cut = [[] if o else self.chunks(self.folded(t)) for t, o in zip(texts, odd, strict=True)]
        found = self._look_up(list(chain.from_iterable(cut)))
        at = 0
        for text, whole, parts in zip(texts, odd, cut, strict=True):
            if whole:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
            else:
                yield np.frombuffer(b"".join(found[at : at + len(parts)]), dtype="<u4")
            at += len(parts)


def encoder(path: str, keep_space: bool, memo: int = MEMO) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    return remembered(f"tokens {path} {keep_space} {memo}", lambda: ChunkEncoder(path, keep_space, memo))
