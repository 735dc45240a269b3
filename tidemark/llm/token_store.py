"""Operator 8: a content-addressed store of token ids.

Writing. Documents become id streams; a rolling (gear) hash over the last ids cuts each stream into
chunks where its top bits are zero, so equal passages give equal chunks wherever they stand. A chunk's
address is the BLAKE2b digest of its bytes. One shuffle by address leaves a single copy of each chunk
(tasks send a chunk once or a few times each); document rows travel along in the same shuffle, so texts are encoded once and no
staging copy exists. Its partitions follow the bytes of the texts (TASK_BYTES), so the addresses that a task remembers are bounded. Recipes
are then range-sorted by document id.

Files, below one folder, all Parquet that any Spark reader opens:

- ``packs``    chunk_id binary(16), data binary (little-endian ids of ``width`` bytes), or a raw document row
- ``recipes``  shard, doc_id, before (tokens of the shard before it), n_tokens, chunk_ids, chunk_after
  (tokens of the document after each chunk), leaf
- ``manifest`` shard, docs, tokens, start (tokens of all shards before it), root; shard -1 has the root over all

A recipe's leaf is a digest of its id, length and addresses; a shard's root is the Merkle root of its leaves in
order, the store's root that of the shards' roots.

Reading. Leaves, roots and counts are recomputed from the recipes and compared with the manifest. Each chunk is checked against its address and gives its CRC-32; a document's CRC-32 is the exclusive or
of its chunks' values, each advanced by the bytes that follow it, so no ids are shuffled again.

Nulls: a null text is an empty document; a null id sorts first. Repeated rows are documents of their own, next to
each other. An empty table gives an empty store. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidemark.llm import encoding
from tidemark.llm.frames import fresh_path, slices

#: Ids of a chunk: least, most, and bits of the rolling hash that are zero at a cut (512 ids between cuts on average).
LEAST, MOST, BITS, WINDOW = 128, 4096, 9, 8
DIGEST = 16
#: Bytes of text for a partition of chunks (some 100,000 addresses), and addresses that an encoding task remembers to send a chunk once.
TASK_BYTES, REMEMBERED = 32 << 20, 100_000


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def gear_table(n: int = 1 << 16) -> np.ndarray:
    """A 64-bit value for each id (mod n), by the SplitMix64 generator."""
    z = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def cut_candidates(ids: np.ndarray, gear: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions after which the rolling hash allows a cut."""
    value = gear[ids & (len(gear) - 1)]
    rolled = value.copy()
    for k in range(1, WINDOW):
        rolled[k:] += value[:-k] << np.uint64(k)
    return np.flatnonzero(rolled >> np.uint64(64 - bits) == 0) + 1


def chunk_ends(start: int, end: int, cuts: np.ndarray, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of one document, which is at start:end of the stream. A chunk's least length exceeds
    the hash's window, so that no cut depends on ids before the chunk."""
    ends, k, n = [], int(np.searchsorted(cuts, start)), len(cuts)
    while end - start > least:
        while k < n and cuts[k] < start + least:
            k += 1
        stop = int(cuts[k]) if k < n else end
        stop = min(stop, start + most, end)
        ends.append(stop)
        start = stop
    if start < end:
        ends.append(end)
    return ends


class MerkleRoot:
    """Root over leaves that come one by one; an odd node moves up unchanged."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, bytes]] = []

    def add(self, node: bytes, level: int = 0) -> None:
        while self.parts and self.parts[-1][0] == level:
            node, level = digest(self.parts.pop()[1] + node), level + 1
        self.parts.append((level, node))

    def root(self) -> bytes:
        parts = [node for _, node in self.parts]
        while len(parts) > 1:
            right = parts.pop()
            parts[-1] = digest(parts[-1] + right)
        return parts[0] if parts else digest(b"")


def leaf_of(doc_id: int | None, n_tokens: int, chunk_ids: list[bytes]) -> bytes:
    return digest(repr((doc_id, n_tokens)).encode() + b"".join(chunk_ids))


def crc_advance(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The CRC-32 values as parts of a stream that goes on for n_bytes: crc(A + B) = advance(crc(A), len(B)) ^ crc(B)."""
    crc = crc.astype(np.uint64)
    matrix = np.array([0xEDB88320, *(1 << k for k in range(31))], np.uint64)  # one zero bit further

    def times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for k in range(32):
            out ^= np.where(v >> np.uint64(k) & np.uint64(1), m[k], np.uint64(0))
        return out

    left = n_bytes.astype(np.int64) * 8
    while left.any():
        odd = (left & 1) == 1
        if odd.any():
            crc[odd] = times(matrix, crc[odd])
        matrix = times(matrix, matrix)
        left >>= 1
    return crc.astype(np.int64)


def write_store(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, width: int = 2) -> None:
    """Writes the store of ``df``'s texts into ``folder``. ``width``: bytes of a stored id, 2 or 4."""
    spark = df.sparkSession
    path = vocabulary or encoding.default_vocabulary()
    kind = f"<u{width}"
    raw = "route bigint, doc_id bigint, n_tokens bigint, chunk_ids array<binary>, chunk_lengths array<int>, chunk_id binary, data binary"

    def batch_of(columns: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in raw.split(", ")])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoding.WordEncoder.lent(path) as encoder:
            yield from chunked(batches, encoder)

    def chunked(batches: Iterator[pa.RecordBatch], encoder: encoding.WordEncoder) -> Iterator[pa.RecordBatch]:
        gear, sent = gear_table(), set()
        for batch in slices(batches, "__text"):
            if len(sent) > REMEMBERED:
                sent.clear()
            ids, offsets = encoder.encode(batch.column(1))
            if width == 2 and len(ids) and int(ids.max()) >= 1 << 16:
                raise ValueError("ids of this vocabulary need width=4")
            stored, cuts = ids.astype(kind), cut_candidates(ids, gear)
            rows: list[tuple] = []
            for doc, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                names, lengths, start = [], [], a
                for end in chunk_ends(a, b, cuts):
                    data = stored[start:end].tobytes()
                    name = digest(data)
                    names.append(name)
                    lengths.append(end - start)
                    start = end
                    if name not in sent:
                        sent.add(name)
                        rows.append((int.from_bytes(name[:8], "little", signed=True), None, None, None, None, name, data))
                rows.append((int.from_bytes(leaf_of(doc, b - a, names)[:8], "little", signed=True), doc, b - a, names, lengths, None, None))
            yield batch_of([list(x) for x in zip(*rows, strict=True)])

    def first(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen: set[bytes] = set()
        for column in columns:
            yield pa.array([name is None or not (name in seen or seen.add(name)) for name in column.to_pylist()], pa.bool_())

    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, tokens, docs, merkle = TaskContext.get().partitionId(), 0, 0, MerkleRoot()
        schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("chunk_ids", pa.list_(pa.binary())), ("chunk_after", pa.list_(pa.int64())), ("leaf", pa.binary()), ("docs", pa.int64()), ("root", pa.binary())])
        for batch in batches:
            ids, sizes, names = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            leaves, before, after = [], [], []
            for doc, n, chunks in zip(ids, sizes, names, strict=True):
                leaves.append(leaf_of(doc, n, chunks))
                merkle.add(leaves[-1])
                before.append(tokens)
                tokens += n
            for lengths in batch.column(3).to_pylist():
                after.append(sum(lengths) - np.cumsum(lengths))
            docs += len(ids)
            k = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * k, pa.int32()), batch.column(0), pa.array(before, pa.int64()), batch.column(1), batch.column(2), pa.array(after, pa.list_(pa.int64())), pa.array(leaves, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], schema=schema)
        if docs:
            last = [[shard], [None], [None], [tokens], [None], [None], [None], [docs], [merkle.root()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(last, schema, strict=True)], schema=schema)

    named = df.select(df[id_col].cast("bigint").alias("__id"), df[text_col].cast("string").alias("__text"))
    size = df.agg(F.sum(F.octet_length(df[text_col].cast("string")))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    # Only addresses go to Python; what is kept depends on the rows before, so it must not be asked on the other side of the shuffle.
    packs = named.mapInArrow(encode, raw).repartition(tasks, "route").where(arrow_udf(first, "boolean").asNondeterministic()("chunk_id"))
    packs.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 1).parquet(f"{folder}/packs")
    documents = spark.read.schema(packs.schema).parquet(f"{folder}/packs").where("chunk_id is null").select("doc_id", "n_tokens", "chunk_ids", "chunk_lengths")
    order = documents.repartitionByRange("doc_id", "n_tokens").sortWithinPartitions("doc_id", "n_tokens", "chunk_ids")
    order.mapInArrow(recipes, "shard int, doc_id bigint, before bigint, n_tokens bigint, chunk_ids array<binary>, chunk_after array<bigint>, leaf binary, docs bigint, root binary").write.parquet(f"{folder}/recipes")
    write_manifest(spark, folder)


def write_manifest(spark: SparkSession, folder: str) -> None:
    """One row for each shard, in order, from the shards' last rows. There are as many as tasks wrote recipes."""
    shards = recipe_rows(spark, folder).where("root is not null").select("shard", "docs", "n_tokens", "root").orderBy("shard").collect()
    start, top, rows = 0, MerkleRoot(), []
    for r in shards:
        top.add(bytes(r.root))
        rows.append((r.shard, r.docs, r.n_tokens, start, bytearray(r.root)))
        start += r.n_tokens
    rows.append((-1, sum(r.docs for r in shards), start, 0, bytearray(top.root())))
    spark.createDataFrame(rows, "shard int, docs bigint, tokens bigint, start bigint, root binary").coalesce(1).write.parquet(f"{folder}/manifest")


def recipe_rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("shard int, doc_id bigint, before bigint, n_tokens bigint, chunk_ids array<binary>, chunk_after array<bigint>, leaf binary, docs bigint, root binary").parquet(f"{folder}/recipes")


def chunk_rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("chunk_id binary, data binary").parquet(f"{folder}/packs").where("chunk_id is not null")


def verify_manifest(spark: SparkSession, folder: str) -> None:
    """Recomputes every leaf, each shard's root, docs and tokens, and the root over all; the first that differs is an error."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, docs, tokens, merkle = None, 0, 0, MerkleRoot()

        def close() -> Iterator[pa.RecordBatch]:
            if shard is not None:
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64()), pa.array([merkle.root()], pa.binary())], ["shard", "docs", "tokens", "root"])

        for batch in batches:
            for at, doc, before, n, names, leaf in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if at != shard:
                    yield from close()
                    shard, docs, tokens, merkle = at, 0, 0, MerkleRoot()
                if before != tokens or leaf != leaf_of(doc, n, names):
                    raise ValueError(f"the recipe of document {doc} is damaged")
                merkle.add(leaf)
                docs, tokens = docs + 1, tokens + n
        yield from close()

    rows = recipe_rows(spark, folder).where("root is null").select("shard", "doc_id", "before", "n_tokens", "chunk_ids", "leaf")
    order = rows.repartition("shard").sortWithinPartitions("shard", "doc_id", "n_tokens", "chunk_ids")
    got = {r.shard: (r.docs, r.tokens, bytes(r.root)) for r in order.mapInArrow(roots, "shard int, docs bigint, tokens bigint, root binary").collect()}
    start, top, want = 0, MerkleRoot(), {}
    for shard in sorted(got):
        want[shard] = (got[shard][0], got[shard][1], start, got[shard][2])
        start += got[shard][1]
        top.add(got[shard][2])
    want[-1] = (sum(x[0] for x in got.values()), start, 0, top.root())
    kept = {r.shard: (r.docs, r.tokens, r.start, bytes(r.root)) for r in spark.read.parquet(f"{folder}/manifest").collect()}
    if kept != want:
        raise ValueError(f"the recipes differ from the manifest in shards {sorted(k for k in kept.keys() | want.keys() if kept.get(k) != want.get(k))}")


def read_digests(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """For each document of the store: doc_id, start, n_tokens and ids_crc32 (of its ids as 32-bit integers), from the files.

    Recipes that differ from the manifest are an error at once. A chunk that differs from its address, and a document whose chunks
    don't make up its length, end the query.
    """
    verify_manifest(spark, folder)
    kind = f"<u{width}"

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, crcs, sizes = batch.column(0).to_pylist(), [], []
            for name, data in zip(names, batch.column(1).to_pylist(), strict=True):
                if digest(data) != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
                ids = np.frombuffer(data, kind)
                sizes.append(len(ids))
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64())], ["chunk_id", "crc", "size"])

    def advanced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = crc_advance(batch.column(2).to_numpy(), batch.column(3).to_numpy() * 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crc, pa.int64()), batch.column(4)], ["shard", "at", "crc", "size"])

    chunks = chunk_rows(spark, folder).mapInArrow(checked, "chunk_id binary, crc bigint, size bigint")
    recipes = recipe_rows(spark, folder).where("root is null").withColumn("at", F.struct("before", "doc_id", "n_tokens"))
    used = recipes.select("shard", "at", F.explode(F.arrays_zip("chunk_ids", "chunk_after")).alias("c")).select("shard", "at", F.col("c.chunk_ids").alias("chunk_id"), F.col("c.chunk_after").alias("after"))
    joined = used.join(chunks, "chunk_id").select("shard", "at", "crc", "after", "size")
    whole = joined.mapInArrow(advanced, "shard int, at struct<before:bigint,doc_id:bigint,n_tokens:bigint>, crc bigint, size bigint")
    whole = whole.groupBy("shard", "at").agg(F.expr("bit_xor(crc)").alias("ids_crc32"), F.sum("size").alias("size"))
    starts = spark.read.parquet(f"{folder}/manifest").where("shard >= 0").select("shard", F.col("start").alias("shard_start"))
    whole = whole.join(F.broadcast(starts), "shard")  # a row for each task that wrote recipes
    size = F.when(F.col("size") == F.col("at.n_tokens"), F.col("size")).otherwise(F.raise_error(F.lit("a document's chunks don't make up its length")).cast("bigint"))
    return whole.select(F.col("at.doc_id").alias("doc_id"), (F.col("shard_start") + F.col("at.before")).alias("start"), size.alias("n_tokens"), "ids_crc32")


def read_ids(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """For each document of the store: doc_id, start, n_tokens and ids (little-endian unsigned 32-bit integers), from the files.

    The recipes are compared with the manifest and each chunk with its address, as in ``read_digests``.
    """
    verify_manifest(spark, folder)
    kind = f"<u{width}"

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest(data) != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
            yield batch

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x["data"] for x in sorted(parts, key=lambda x: x["k"])), kind).astype("<u4") for parts in batch.column(2).to_pylist()]
            for n, x in zip(batch.column(1).field("n_tokens").to_pylist(), ids, strict=True):
                if len(x) != n:
                    raise ValueError("a document's chunks don't make up its length")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in ids], pa.binary())], ["shard", "at", "ids"])

    chunks = chunk_rows(spark, folder).mapInArrow(checked, "chunk_id binary, data binary")
    recipes = recipe_rows(spark, folder).where("root is null").withColumn("at", F.struct("before", "doc_id", "n_tokens"))
    used = recipes.select("shard", "at", F.posexplode("chunk_ids").alias("k", "chunk_id"))
    parts = used.join(chunks, "chunk_id").groupBy("shard", "at").agg(F.collect_list(F.struct("k", "data")).alias("parts"))
    got = parts.select("shard", "at", "parts").mapInArrow(whole, "shard int, at struct<before:bigint,doc_id:bigint,n_tokens:bigint>, ids binary")
    starts = spark.read.parquet(f"{folder}/manifest").where("shard >= 0").select("shard", F.col("start").alias("shard_start"))
    got = got.join(F.broadcast(starts), "shard")  # a row for each task that wrote recipes
    return got.select(F.col("at.doc_id").alias("doc_id"), (F.col("shard_start") + F.col("at.before")).alias("start"), F.col("at.n_tokens").alias("n_tokens"), "ids")


def store_and_read(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Writes a store into a new folder of the shared folder and returns its documents as read back."""
    folder = fresh_path(df.sparkSession, "token-store")
    write_store(df, folder, id_col, text_col, vocabulary)
    return read_digests(df.sparkSession, folder)
