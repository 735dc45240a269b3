"""Operator 1: chroma fingerprints of recordings, and alignment of recordings by them.

Fingerprints. A recording is decoded to mono at RATE, cut into overlapping Hann frames, and each frame's power is summed by
pitch class. On the resulting image (frames x 12) an integral image gives the sum of any rectangle by four lookups; sixteen
filters compare rectangles of one window of frames (upper with lower, earlier with later, crosswise, middle with outer strips), each
log ratio is cut into four levels, and their Gray codes make one 32-bit integer for each window position.

Alignment. Recordings with one fingerprint are one class. Queries (a stated set) are searched among all classes. Integers that differ from
both their neighbours have a place (those of silence and held tones have none); the index holds every two that follow each other, with their distance. Classes
meet by equal entries (dealt out by entry and salt); each pair's histogram of offsets is an aggregation. At every offset of the histogram the
passage of LEAST_OVERLAP integers or more that lies furthest below the bit errors allowed is found, and the best passage is the alignment:
recordings that share a passage match whatever is around it.

An excerpt may begin between two hops. With their media at hand, queries are therefore fingerprinted from STARTS places within a hop: of excerpts that begin
anywhere, with noise of 12 to 30 dB, 59 of 60 are within the rule and 58 are found (with one place 30 and 29).

The index is exact for passages with two such integers untouched. Of excerpts with noise on the hop it finds all up to 4 % of bit errors, 97 % of those that all
offsets would give at 4.6 %, 90 % at 5.7 % and 81 % at 6.9 %, where the rule itself accepts two of three (``tests/llm`` measures it against all offsets).
Passages of unrelated recordings differ in 14 % of bits or more, even the best of all offsets, so chance gives no match.

Nulls: null or undecodable media, and media shorter than one window, have an empty fingerprint (0 frames, a class of their own) and align with nothing. Null
ids are kept and are no queries. Repeated rows are recordings of their own in one class. An empty table gives an
empty result. Other columns are left out.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import slices, staged

RATE, FRAME, HOP = 4000, 512, 256
#: Frames of a filter's window.
WIDTH = 12
#: Places within a hop from which queries are fingerprinted, where their media are given.
STARTS = 4
#: Parts into which the recordings of one entry of the index are dealt.
SALTS = 8
#: Bytes of the queries' fingerprints that are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: The aligned passage has this many integers at least and differs in this share of bits at most.
LEAST_OVERLAP, MOST_ERRORS = 16, 0.05


def decode_wav(data: bytes) -> np.ndarray:
    """Mono samples at RATE of a RIFF file with 8-, 16- or 32-bit PCM; empty if it can't be read."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return np.zeros(0)
    at, form, pcm = 12, None, b""
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(data):
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data":
            pcm = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if not form or form[0] != 1 or not form[1] or not form[2] or form[5] not in (8, 16, 32):
        return np.zeros(0)
    kind = {8: np.uint8, 16: np.dtype("<i2"), 32: np.dtype("<i4")}[form[5]]
    width = form[5] // 8 * form[1]
    x = np.frombuffer(pcm[: len(pcm) // width * width], kind).astype(np.float64).reshape(-1, form[1]).mean(axis=1)
    x = (x - 128) / 128 if form[5] == 8 else x / float(1 << (form[5] - 1))
    return resample(x, form[2])


def resample(x: np.ndarray, rate: int) -> np.ndarray:
    """x at RATE, by means over whole steps down and linear interpolation for the rest."""
    step = rate // RATE
    if step > 1:
        x = x[: len(x) // step * step].reshape(-1, step).mean(axis=1)
        rate = rate / step
    if rate == RATE or not len(x):
        return x
    return np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x)


@functools.cache
def _tone_table(notes: int = 36) -> np.ndarray:
    t = np.arange(FRAME) / RATE
    return np.sin(2 * np.pi * 220.0 * 2 ** (np.arange(notes)[:, None] / 12) * t)


def decode_tones(data: bytes) -> np.ndarray:
    """A recording from words, for tables without media: each word of the UTF-8 text sounds two notes that its CRC-32 picks."""
    import zlib

    words = data.lower().split()
    if not words:
        return np.zeros(0)
    table = _tone_table()
    picks = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    return (table[picks % len(table)] + 0.5 * table[picks // 64 % len(table)]).reshape(-1)


@functools.cache
def _pitch_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The frames' window, the spectrum's bins in use and their pitch classes."""
    hertz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    use = np.flatnonzero((hertz >= 110) & (hertz <= RATE / 2))
    pitch = np.zeros((len(use), 12))
    pitch[np.arange(len(use)), np.round(12 * np.log2(hertz[use] / 440)).astype(int) % 12] = 1
    return np.hanning(FRAME), use, pitch


def chroma(samples: np.ndarray) -> np.ndarray:
    """Power by pitch class (frames x 12), each frame with sum 1; all 0 for a silent frame."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    window, use, pitch = _pitch_table()
    image = np.empty((n, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for at in range(0, n, 1024):  # long recordings in parts
        found = np.fft.rfft(frames[at : at + 1024] * window, axis=1)[:, use[0] : use[-1] + 1]
        image[at : at + 1024] = (found.real**2 + found.imag**2) @ pitch
    total = image.sum(axis=1, keepdims=True)
    return np.where(total > 1e-9, image / np.maximum(total, 1e-9), 0)


def filter_bank() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, height, width) of the sixteen filters, by rule."""
    return [(k % 5, 5 * k % 7, 4 + k % 3, (WIDTH, WIDTH // 2, WIDTH // 3)[k // 5 % 3]) for k in range(16)]


#: Levels of a log ratio, off the round values that equal or empty rectangles give, and the Gray codes of the four ranges between them.
LEVELS, GRAY = np.array([-0.3505, 0.0005, 0.3505]), np.array([0, 1, 3, 2], np.uint32)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """The 32-bit integers of a recording, one for each window position."""
    image = chroma(samples)
    n = len(image) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    whole = np.zeros((len(image) + 1, 13))
    whole[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)

    def area(t: int, y: int, w: int, h: int) -> np.ndarray:
        a, b = whole[t : t + n], whole[t + w : t + w + n]
        return b[:, y + h] - b[:, y] - a[:, y + h] + a[:, y]

    out = np.zeros(n, np.uint32)
    for k, (kind, y, h, w) in enumerate(filter_bank()):
        if kind == 0:  # upper and lower half
            one, two = area(0, y, w, h // 2), area(0, y + h // 2, w, h - h // 2)
        elif kind == 1:  # earlier and later half
            one, two = area(0, y, w // 2, h), area(w // 2, y, w - w // 2, h)
        elif kind == 2:  # diagonal quarters
            one = area(0, y, w // 2, h // 2) + area(w // 2, y + h // 2, w - w // 2, h - h // 2)
            two = area(0, y + h // 2, w // 2, h - h // 2) + area(w // 2, y, w - w // 2, h // 2)
        elif kind == 3:  # middle and outer pitches
            one = area(0, y + h // 3, w, h - 2 * (h // 3))
            two = area(0, y, w, h) - one
        else:  # middle and outer times
            one = area(w // 3, y, w - 2 * (w // 3), h)
            two = area(0, y, w, h) - one
        # Rounded, so that sums from different starts of the image give the same bits.
        ratio = np.round(np.log1p(np.maximum(one, 0)) - np.log1p(np.maximum(two, 0)), 6)
        out |= GRAY[np.searchsorted(LEVELS, ratio)] << np.uint32(2 * k)
    return out


def places(values: np.ndarray) -> np.ndarray:
    """Where the integers stand that differ from both neighbours."""
    keep = np.ones(len(values), bool)
    change = values[1:] != values[:-1]
    keep[1:] &= change
    keep[:-1] &= change
    return np.flatnonzero(keep)


def entries(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index's entries, as 32-bit hashes of two integers and their distance, and where they begin."""
    at = places(values)
    if len(at) < 2:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    h = values[at[:-1]].astype(np.uint64) << np.uint64(32) | values[at[1:]].astype(np.uint64)
    for x in (np.uint64(0), np.diff(at).astype(np.uint64)):
        h = (h ^ h >> np.uint64(31) ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32), at[:-1]


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """(integers of the overlap, bits that differ in it) with b[i] against a[i + offset]."""
    start, stop = max(0, -offset), min(len(b), len(a) - offset)
    if stop <= start:
        return 0, 0
    return stop - start, int(np.bitwise_count(a[start + offset : stop + offset] ^ b[start:stop]).sum())


def passage(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int] | None:
    """(integers, bits that differ) of the passage of LEAST_OVERLAP integers or more with the fewest bit errors against those
    allowed, with b[i] against a[i + offset]; None if the overlap is shorter."""
    start, stop = max(0, -offset), min(len(b), len(a) - offset)
    if stop - start < LEAST_OVERLAP:
        return None
    errors = np.concatenate([[0], np.cumsum(np.bitwise_count(a[start + offset : stop + offset] ^ b[start:stop]).astype(np.int64))])
    left = 32 * MOST_ERRORS * np.arange(len(errors)) - errors  # errors allowed and not made
    least = np.minimum.accumulate(left)[: len(left) - LEAST_OVERLAP]
    end = int((left[LEAST_OVERLAP:] - least).argmax()) + LEAST_OVERLAP
    begin = int(left[: end - LEAST_OVERLAP + 1].argmin())
    return end - begin, int(errors[end] - errors[begin])


def best_passage(a: np.ndarray, b: np.ndarray, bins: dict[int, int]) -> tuple[int, int, int] | None:
    """(offset, integers, bit errors) of the best passage over all offsets of a histogram; of equal ones that with the most hits."""
    found = [(o, *p) for o in bins if (p := passage(a, b, o))]
    return min(found, key=lambda x: (x[2] - 32 * MOST_ERRORS * x[1], -bins[x[0]], abs(x[0]), x[0]), default=None)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int] | None:
    """(offset, integers, bit errors) of the best passage of two fingerprints; None without one."""
    from collections import Counter

    one: dict[int, list[int]] = {}
    for h, at in zip(*(x.tolist() for x in entries(a)), strict=True):
        one.setdefault(h, []).append(at)
    return best_passage(a, b, Counter(x - at for h, at in zip(*(x.tolist() for x in entries(b)), strict=True) for x in one.get(h, ())))


def fingerprints(df: DataFrame, id_col: str, media_col: str, decode: Callable[[bytes], np.ndarray] = decode_wav) -> DataFrame:
    """(media_id, n_frames, fingerprint as little-endian 32-bit integers) of each recording."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__media"):
            got = [fingerprint(decode(x)) if x else np.zeros(0, np.uint32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in got], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in got], pa.binary())], ["media_id", "n_frames", "fingerprint"])

    named = df.select(df[id_col].cast("bigint").alias("__id"), df[media_col].cast("binary").alias("__media"))
    return named.mapInArrow(work, "media_id bigint, n_frames bigint, fingerprint binary")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "fingerprint"):
        prints = [np.frombuffer(x, "<u4") for x in batch.column(1).to_pylist()]
        found = [entries(x) for x in prints]
        take = pa.array(np.repeat(np.arange(len(found)), [len(h) for h, _ in found]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.concatenate([h for h, _ in found])), pa.array(np.concatenate([at for _, at in found]).astype(np.int32))], ["class_id", "entry", "at"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for query, name, bins, a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            hits = {x["offset"]: x["hits"] for x in bins}
            got = best_passage(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), hits)
            if got:
                rows.append((query, name, got[0], hits[got[0]], got[1], got[2]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], ["query_class", "class_id", "offset", "hits", "overlap", "bit_errors"])


def later_starts(media: DataFrame, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """(query_class, start, fingerprint) of recordings (class_id, media) from the places within a hop after the first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                samples = decode(data) if data else np.zeros(0)
                got = [fingerprint(samples[k * HOP // STARTS :]).astype("<u4").tobytes() for k in range(1, STARTS)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(got), pa.int64()), pa.array(range(1, STARTS), pa.int32()), pa.array(got, pa.binary())], ["query_class", "start", "fingerprint"])

    return media.select("class_id", "media").mapInArrow(work, "query_class bigint, start int, fingerprint binary")


def search(known: DataFrame, is_query: Column, media: DataFrame | None = None, decode: Callable[[bytes], np.ndarray] = decode_wav) -> DataFrame:
    """Aligns the classes of the query recordings with all classes of ``known`` (media_id, n_frames, fingerprint).

    With ``media`` (media_id, media) the queries are fingerprinted from all STARTS places within a hop; without, from the first.
    Rows of kind ``member`` give each recording's class (its least media_id); rows of kind ``match`` give, for a query class
    as media_id and another class as class_id, offset (positive: the class begins later in the query), and overlap, bit_errors and hits
    of the best passage.
    """
    known = known.withColumns({"__q": F.coalesce(is_query, F.lit(False)), "__digest": F.unhex(F.md5("fingerprint"))})
    classes = known.where("n_frames > 0").groupBy("__digest").agg(F.min("media_id").alias("class_id"), F.max("__q").alias("q"), F.any_value("fingerprint").alias("fingerprint"))
    classes = staged(classes.where("class_id is not null"), "recording-classes")
    prints = classes.where("q").select(F.col("class_id").alias("query_class"), F.lit(0).alias("start"), "fingerprint")
    if media is not None:
        asked = media.select(F.col("media_id").cast("bigint").alias("class_id"), F.col("media").cast("binary").alias("media")).join(classes.where("q").select("class_id"), "class_id", "left_semi")
        prints = staged(prints.union(later_starts(asked.dropDuplicates(["class_id"]), decode)), "query-fingerprints")
    # Recordings that share an entry are dealt into SALTS parts, and the few queries go to each.
    salts = F.explode(F.array(*[F.lit(k) for k in range(SALTS)])).alias("salt")
    places_of = lambda rows: rows.select("class_id", "fingerprint").mapInArrow(_postings, "class_id bigint, entry int, at int")
    each = [places_of(prints.where(F.col("start") == k).withColumnRenamed("query_class", "class_id")).withColumn("start", F.lit(k)) for k in range(STARTS if media is not None else 1)]
    queries = functools.reduce(DataFrame.union, each).select(F.col("class_id").alias("query_class"), "start", "entry", F.col("at").alias("query_at"), salts)
    others = places_of(classes).withColumn("salt", F.pmod(F.xxhash64("class_id"), F.lit(SALTS)).cast("int"))
    met = queries.join(others, ["entry", "salt"]).where("query_class <> class_id")
    bins = met.groupBy("query_class", "start", "class_id", (F.col("query_at") - F.col("at")).cast("bigint").alias("offset")).agg(F.count("*").alias("hits"))
    best = bins.groupBy("query_class", "start", "class_id").agg(F.collect_list(F.struct("offset", "hits")).alias("bins"))
    a = prints.select("query_class", "start", F.col("fingerprint").alias("a"))
    size = a.agg(F.sum(F.octet_length("a"))).first()[0] or 0
    a = F.broadcast(a) if size <= BROADCAST_BYTES else a
    b = classes.select("class_id", F.col("fingerprint").alias("b"))
    pairs = best.join(b, "class_id").join(a, ["query_class", "start"]).select("query_class", "class_id", "bins", "a", "b")
    found = pairs.mapInArrow(_verified, "query_class bigint, class_id bigint, offset bigint, hits bigint, overlap bigint, bit_errors bigint")
    found = found.where((F.col("overlap") >= LEAST_OVERLAP) & (F.col("bit_errors") <= F.lit(32 * MOST_ERRORS) * F.col("overlap")))
    if media is not None:  # of a pair's starts the one with the best passage
        left = F.struct(F.col("bit_errors") - F.lit(32 * MOST_ERRORS) * F.col("overlap"), F.abs("offset"), "offset", "hits")
        found = found.groupBy("query_class", "class_id").agg(F.min_by(F.struct("offset", "hits", "overlap", "bit_errors"), left).alias("x")).select("query_class", "class_id", "x.*")
    none = F.lit(None).cast("bigint")
    members = known.select("media_id", "n_frames", "__digest").join(classes.select("__digest", "class_id"), "__digest", "left")
    members = members.select(F.lit("member").alias("kind"), "media_id", F.coalesce("class_id", "media_id").alias("class_id"), "n_frames", none.alias("offset"), none.alias("overlap"), none.alias("bit_errors"), none.alias("hits"))
    matches = found.select(F.lit("match").alias("kind"), F.col("query_class").alias("media_id"), "class_id", none.alias("n_frames"), "offset", "overlap", "bit_errors", "hits")
    return members.unionByName(matches)


#: Bits of a media_id that number the turn.
TURN_BITS = 32


def turn_recordings(conversations: DataFrame) -> DataFrame:
    """Recordings for the conversations table, which has no media: each turn's text as tones. media_id is conv_id * 2^32 + turn (conv_id
    below 2^31)."""
    return conversations.select(F.shiftleft(F.col("conv_id").cast("bigint"), TURN_BITS).bitwiseOR(F.col("turn").cast("bigint")).alias("media_id"), F.col("text").cast("binary").alias("media"))


def recording_report(conversations: DataFrame) -> DataFrame:
    """All turns as recordings; those of conversations whose id is divisible by 50 are the queries."""
    known = staged(fingerprints(turn_recordings(conversations), "media_id", "media", decode_tones), "fingerprints")
    return search(known, F.pmod(F.shiftright("media_id", TURN_BITS), F.lit(50)) == 0)
