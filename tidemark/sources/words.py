"""Typed columns from packed 32-byte words.

A words table has slot, key1 and key2 (null where the slot has no such key), word_index and word (32 bytes). A slice names where a column's bytes
stand; it may begin and end within a byte. Slices of up to 7 bytes become BIGINT, of up to 15 bytes DECIMAL(38,0), and longer ones stay 32-byte integers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import ColumnDef, ColumnKind, TableDef
from tidemark.errors import IngestError


@dataclass(frozen=True)
class Slice:
    """``bits`` from bit ``shift`` (0 is the highest) of byte ``offset`` (0 is the word's first) of word ``word`` of a slot.

    Bits are taken in bytes from the first on. A last byte of fewer bits is a number by itself: the 11 bits 10110101 101 are 0xB505.
    """

    name: str
    slot: int
    offset: int = 0
    bits: int = 256
    word: int = 0
    shift: int = 0

    def __post_init__(self) -> None:
        if self.bits <= 0 or self.offset < 0 or not 0 <= self.shift < 8 or 8 * self.offset + self.shift + self.bits > 256:
            raise IngestError(f"{self.name}: {self.bits} bits at byte {self.offset}, bit {self.shift} are not within a word")


def _bytes(word: Column, offset: int, bits: int, shift: int) -> Column:
    """The bits in whole bytes, the last one's at its low end."""
    n = -(-bits // 8)
    if not shift and not bits % 8:
        return F.substring(word, offset + 1, n)
    byte = lambda k: F.conv(F.hex(F.substring(word, k + 1, 1)), 16, 10).cast("int") if k < 32 else F.lit(0)
    out = [F.shiftleft(byte(k).bitwiseAND((1 << (8 - shift)) - 1), shift) + F.shiftright(byte(k + 1), 8 - shift) for k in range(offset, offset + n)]
    if bits % 8:
        out[-1] = F.shiftright(out[-1], 8 - bits % 8)
    return F.unhex(F.concat(*[F.lpad(F.hex(x), 2, "0") for x in out]))


def cut(word: Column, offset: int, bits: int, shift: int = 0) -> Column:
    """The number in ``bits`` bits from bit ``shift`` of byte ``offset`` of a word."""
    n = -(-bits // 8)
    part = _bytes(word, offset, bits, shift)
    if n <= 7:
        return F.conv(F.hex(part), 16, 10).cast("bigint")
    if n <= 15:
        low = F.conv(F.hex(F.substring(part, n - 6, 7)), 16, 10).cast("decimal(38,0)")
        middle = F.conv(F.hex(F.substring(part, max(1, n - 13), min(7, n - 7))), 16, 10).cast("decimal(38,0)")
        top = F.conv(F.hex(F.substring(part, 1, n - 14)), 16, 10).cast("decimal(38,0)") if n > 14 else F.lit(0).cast("decimal(38,0)")
        base = F.lit(1 << 56).cast("decimal(38,0)")
        return ((top * base + middle).cast("decimal(38,0)") * base + low).cast("decimal(38,0)")
    return F.lpad(part, 32, bytes([0]))


def pack(*parts: tuple[Column, int]) -> Column:
    """A word from (non-negative BIGINT, bytes) parts, first part first, with zeros before them."""
    digits = F.concat(*[F.lpad(F.hex(c.cast("bigint")), 2 * n, "0") for c, n in parts])
    return F.unhex(F.lpad(digits, 64, "0"))


def extract_simple(words: DataFrame, slices: Sequence[Slice]) -> DataFrame:
    """One row: each slice's value from the words without keys. A missing word gives null."""
    use = words.where(F.col("slot").isin(sorted({s.slot for s in slices})) & F.col("key1").isNull())
    return use.agg(*[_value(s).alias(s.name) for s in slices])


def _value(s: Slice) -> Column:
    return F.max(F.when((F.col("slot") == s.slot) & (F.col("word_index") == s.word), cut(F.col("word"), s.offset, s.bits, s.shift)))


def extract_mapping(words: DataFrame, slices: Sequence[Slice], keys: Sequence[str] = ("map_key",)) -> DataFrame:
    """One row for each key (or pair of keys) of a mapping's slot, with the key columns named ``keys``."""
    if not 1 <= len(keys) <= 2:
        raise IngestError("a mapping has one or two keys")
    slots = sorted({s.slot for s in slices})
    use = words.where(F.col("slot").isin(slots) & F.col("key1").isNotNull() & (F.col("key2").isNotNull() if len(keys) == 2 else F.col("key2").isNull()))
    by = [F.col(c).alias(n) for c, n in zip(("key1", "key2"), keys, strict=False)]
    return use.groupBy(*by).agg(*[_value(s).alias(s.name) for s in slices])


def extract_with_length(words: DataFrame, slices: Sequence[Slice], length: Slice, keys: Sequence[str] = ("map_key",)) -> DataFrame:
    """``extract_mapping``, if the mapping has as many keys as the length word says; else an IngestError."""
    rows = extract_mapping(words, slices, keys)
    want = extract_simple(words, [length]).first()[0]
    found = rows.count()
    if want is None or int(want) != found:
        raise IngestError(f"the length word says {want}, the mapping has {found} keys")
    return rows


def merge_single_mapping(single: DataFrame, mapping: DataFrame) -> DataFrame:
    """The one row of ``single`` beside every row of ``mapping``."""
    n = single.limit(2).count()
    if n != 1:
        raise IngestError(f"the single table has {'no' if n == 0 else 'more than one'} row")
    return mapping.crossJoin(F.broadcast(single))  # one row


def _id(*parts: object) -> int:
    """64 bits of the SHA-256 of the parts, never 0."""
    text = "".join(f"{len(x)}:{x}" for x in map(str, parts))
    return int.from_bytes(sha256(text.encode()).digest()[:8], "big") or 1


def slice_id(s: Slice, contract: str = "", chain: int = 0, extra: str = "") -> int:
    """An id that two columns share only if the same bits of the same contract on the same chain are meant, whatever their names."""
    return _id("value", s.slot, s.offset, s.shift, s.bits, s.word, contract.lower(), chain, extra)


def key_id(slot: int, place: str = "key", contract: str = "", chain: int = 0, extra: str = "") -> int:
    """An id for the key of a mapping (``place`` key), or of a mapping of mappings (outer, inner)."""
    if place not in ("key", "outer", "inner"):
        raise IngestError(f"{place}: a mapping's key is key, outer or inner")
    return _id(place, slot, contract.lower(), chain, extra)


def words_table(name: str, primary: str, slices: Sequence[Slice], keys: Sequence[str] = (), secondary: str | None = None, contract: str = "", chain: int = 0) -> TableDef:
    """A table of slices (of one slot, where it has ``keys``) with ids by hash; one of its columns may be the secondary index."""
    slots = sorted({s.slot for s in slices})
    if len(keys) > 2 or keys and len(slots) != 1:
        raise IngestError("a mapping has one slot and one or two keys")
    places = ("key",) if len(keys) == 1 else ("outer", "inner")
    ids = {k: key_id(slots[0], p, contract, chain) for k, p in zip(keys, places, strict=False)} | {s.name: slice_id(s, contract, chain) for s in slices}
    if secondary is not None and secondary not in ids:
        raise IngestError(f"{secondary}: the secondary index is no column")
    kind = lambda c: ColumnKind.SECONDARY if c == secondary else ColumnKind.STANDARD
    return TableDef(name, (ColumnDef(primary, ColumnKind.PRIMARY, _id("primary")), *[ColumnDef(c, kind(c), n) for c, n in ids.items()]), name)
