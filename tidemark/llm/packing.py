"""Operator 4: sum-of-squares packing of token documents into fixed windows.

Each task packs the documents of its own input split, so nothing is shuffled and a lost task is
rebuilt from its split alone. Full windows are cut off long documents at once. The rest of a document
goes to the fill level that keeps the sum over all levels of (open windows at that level)^2 least,
which an array of counts by level tells without looking at any window. What is open when the split ends is
cut and joined to full windows, and the last tokens to windows of a power of two, so no window
is padded at all.

Nulls: a null text is an empty document (its end id alone); a null id is kept. Repeated rows and repeated
ids are packed each on its own. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import encoding
from tidemark.llm.frames import arrow_map, slices

#: Tokens of a window.
CAPACITY = 4096

Piece = tuple[int, int, np.ndarray, int]  # document id, start, ids, the document's length


class SumOfSquares:
    """Open windows by fill level. ``place`` returns a window's pieces once it is full."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def level_for(self, size: int) -> int:
        """The fill level (0: a new window) whose choice adds least to the sum of squares; of equals the fullest."""
        room = self.capacity - size
        if room == 0:
            return 0
        arrive = 2 * self.levels[size : self.capacity + 1] + 1
        arrive[-1] = 0  # a window that becomes full is no longer counted
        change = arrive.copy()
        change[1:] -= 2 * self.levels[1 : room + 1] - 1
        change[1:][self.levels[1 : room + 1] == 0] = np.iinfo(np.int64).max
        return room - int(np.argmin(change[::-1]))

    def place(self, piece: Piece) -> list[Piece] | None:
        size = len(piece[2])
        level = self.level_for(size)
        window = self.open[level].pop() if level else []
        if level:
            self.levels[level] -= 1
        window.append(piece)
        if level + size == self.capacity:
            return window
        self.levels[level + size] += 1
        self.open.setdefault(level + size, []).append(window)
        return None

    def rest(self) -> Iterator[list[Piece]]:
        """All open windows, fullest first, cut and joined to full windows and last to powers of two."""
        left = [p for level in sorted(self.open, reverse=True) for window in self.open[level] for p in window]
        total = sum(len(p[2]) for p in left)
        goals = [self.capacity] * (total // self.capacity) + [1 << k for k in reversed(range(self.capacity.bit_length())) if (total % self.capacity) >> k & 1]
        pieces = iter(left)
        piece = None
        for goal in goals:
            window, room = [], goal
            while room:
                piece = piece or next(pieces)
                doc, start, ids, n = piece
                if len(ids) <= room:
                    window.append(piece)
                    room, piece = room - len(ids), None
                else:
                    window.append((doc, start, ids[:room], n))
                    piece, room = (doc, start + room, ids[room:], n), 0
            yield window


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Packs the texts of ``df`` into windows of ``capacity`` tokens.

    A row for each piece: the document's id, start (its document's tokens before it), length, ids_crc32,
    doc_tokens, sequence_id (unique, not dense), offset (in the window), and with ``with_ids`` the ids as little-endian unsigned 32-bit integers.
    """
    path = vocabulary or encoding.default_vocabulary()
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids

    def rows(windows: list[list[Piece]], first: int) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(7 + with_ids)]
        for k, window in enumerate(windows):
            offset = 0
            for doc, start, ids, n in window:
                for column, value in zip(out, (doc, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes()), n, first + k, offset, *([ids.astype("<u4", copy=False).tobytes()] if with_ids else [])), strict=True):
                    column.append(value)
                offset += len(ids)
        kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 36
        packer = SumOfSquares(capacity)
        with encoding.WordEncoder.lent(path) as encoder:
            yield from packed(batches, packer, encoder, sequence)

    def packed(batches: Iterator[pa.RecordBatch], packer: SumOfSquares, encoder: encoding.WordEncoder, sequence: int) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            ids, offsets = encoder.encode(batch.column(1))
            windows = []
            for doc, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                n = b - a
                for start in range(0, n - capacity + 1, capacity):
                    windows.append([(doc, start, ids[a + start : a + start + capacity], n)])
                if n % capacity:
                    start = n - n % capacity
                    if full := packer.place((doc, start, ids[a + start : b].copy(), n)):
                        windows.append(full)
            if windows:
                yield rows(windows, sequence)
                sequence += len(windows)
        if windows := list(packer.rest()):
            yield rows(windows, sequence)

    named = df.select(df[id_col].cast("bigint").alias("__id"), df[text_col].cast("string").alias("__text"))
    return arrow_map(named, ["__id", "__text"], work, schema)
