"""Token ids of whole texts, as the ``tokenizers`` library gives them, with every distinct word encoded once.

A vocabulary whose normaliser maps white space to a space and whose pre-tokeniser never joins
characters over white space gives the same ids for a text as for its white-space-separated words
one after the other. :class:`WordEncoder` therefore keeps the ids of each distinct word in one flat
array and gathers whole batches from it. Plain words (letters of Latin blocks, digits, marks) reach the
library's BPE model directly, all others pass through the library's whole pipeline.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Id appended to every document.
END_ID = 2
#: Words and pieces kept by one task before their tables start anew. They bound memory; ids do not depend on them.
MAX_WORDS, MAX_PIECES = 100_000, 400_000

# Fixed values of the word-end vocabulary's file: its pre-token pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next code point from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Ids of white-space-separated words. One object serves all tasks of a worker, one after the other (``lent``)."""

    _kept: dict[str, "WordEncoder"] = {}

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str, max_words: int = MAX_WORDS, max_pieces: int = MAX_PIECES) -> None:
        from tokenizers import Tokenizer

        from tidemark.llm.frames import single_threaded

        single_threaded()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        if kind != ["NFC", "Replace", "Lowercase"] or split != PRE_TOKEN:
            raise ValueError("this vocabulary's normaliser or pre-tokeniser is not known to split at white space")
        self.model = self.tokenizer.model
        # The pre-token pattern spelled out for plain characters, in lower case, with words one on a line.
        letter = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e"
        self.pattern = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[0-9]|[^\n0-9{letter}]+|\n")
        self.odd = re.compile("[^\n\x21-\x3B\x3D-\x7E\u00c0-\u012f\u0132-\u017e]")
        self.alphabet = byte_alphabet()
        del self.alphabet[10]  # line feeds separate the pieces while their bytes are mapped
        self.max_words, self.max_pieces = max_words, max_pieces
        self.clear()
        self._forget_pieces()

    @classmethod
    @contextmanager
    def lent(cls, path: str) -> Iterator["WordEncoder"]:
        """The worker's encoder for one task. Its tables are empty again afterwards: workers outlive tasks and stages."""
        from tidemark.llm.frames import give_back

        encoder = cls.of(path)
        try:
            yield encoder
        finally:
            encoder.clear()
            encoder._forget_pieces()
            give_back()

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.pool, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _forget_pieces(self) -> None:
        self.pieces: dict[str, int] = {"\n": 0}
        self.piece_ids, self.piece_first = array("I"), array("q", [0, 0])

    def _learn_pieces(self, new: list[str]) -> None:
        shown = "\n".join(new).encode().decode("latin-1").translate(self.alphabet).split("\n")
        tokenize, ids, first = self.model.tokenize, self.piece_ids, self.piece_first
        for piece in shown:
            ids.extend([x.id for x in tokenize(piece)])
            first.append(len(ids))
        start = len(self.pieces)
        self.pieces.update(zip(new, range(start, start + len(new)), strict=True))

    def _add(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        start = len(self.first) - 1
        self.words.update(zip(words, range(start, start + len(words)), strict=True))
        self.first = np.concatenate([self.first, self.first[-1] + ends])
        self.pool = np.concatenate([self.pool, ids])

    def _learn(self, new: list[bytes]) -> None:
        lines = b"\n".join(new).decode("utf-8")
        if self.odd.search(lines):
            texts = lines.split("\n")
            late = [k for k, x in enumerate(texts) if self.odd.search(x)]
            got = [x.ids for x in self.tokenizer.encode_batch([texts[k] for k in late], add_special_tokens=False)]
            self._add([new[k] for k in late], np.array([i for x in got for i in x], np.uint32), np.cumsum([len(x) for x in got]))
            out = set(late)
            new = [x for k, x in enumerate(new) if k not in out]
            lines = b"\n".join(new).decode("utf-8")
        if not new:
            return
        found = self.pattern.findall(lines.lower())
        if len(self.pieces) > self.max_pieces:
            self._forget_pieces()
        if fresh := set(found).difference(self.pieces):
            self._learn_pieces(list(fresh))
        at = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        ids, bounds = gathered(np.frombuffer(self.piece_ids, np.uint32) if self.piece_ids else np.zeros(0, np.uint32), np.frombuffer(self.piece_first, np.int64), at)
        self._add(new, ids, np.append(bounds[:-1][at == 0], bounds[-1]))

    def encode(self, texts: pa.Array, end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts one after the other, each followed by ``end``, and the offsets of the texts.

        Null texts are empty.
        """
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = split.flatten()
        inside = pc.greater(pc.binary_length(words), 0)  # white space at either end of a text leaves an empty word
        word_ends = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        if pc.min(inside).as_py() is False:
            word_ends = np.concatenate([[0], np.cumsum(inside.to_numpy(zero_copy_only=False))])[word_ends]
            words = words.filter(inside)
        coded = words.cast(pa.large_binary()).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.words) > self.max_words:
            self.clear()
        at = np.fromiter(map(self.words.get, distinct, repeat(-1)), np.int64, len(distinct))
        if (missing := np.flatnonzero(at < 0)).size:
            new = [distinct[k] for k in missing.tolist()]
            self._learn(new)
            at[missing] = np.fromiter(map(self.words.__getitem__, new), np.int64, len(new))
        ids, bounds = gathered(self.pool, self.first, at[coded.indices.to_numpy()] if len(distinct) else at)
        tail = 0 if end is None else 1
        offsets = bounds[word_ends] + tail * np.arange(len(texts) + 1)
        if not tail:
            return ids, offsets
        out = np.full(offsets[-1], end, np.uint32)
        mine = np.ones(offsets[-1], bool)
        mine[offsets[1:] - 1] = False
        out[mine] = ids
        return out, offsets


def gathered(pool: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``pool[first[k]:first[k + 1]]`` for each k of ``at``, one after the other, and their bounds."""
    size = (first[1:] - first[:-1])[at] if len(at) else np.zeros(0, np.int64)
    bounds = np.zeros(len(at) + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    source = np.repeat(first[at] - bounds[:-1], size) + np.arange(bounds[-1])
    return pool[source], bounds
