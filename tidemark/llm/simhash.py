"""Operator 6: SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within two bits of each other have a common neighbour within one bit of both. So every distinct
fingerprint emits its ball of radius one (itself and 64 variants), rows meet by variant, and all members of a variant
are linked. The members of a variant differ from it in one bit each, hence a bucket is one 64-bit
mask of flipped positions and a flag for the variant itself: its state is two numbers however many documents share
it, the aggregation combines before the shuffle, and no bucket holds more than 65 fingerprints. Members are
linked to the least of the bucket, verified, deduplicated, and joined to components; the pairs that
this leaves out are linked through that member.

Copies share a fingerprint and are one node, so a group of any size costs no more than one document.

Fingerprints within two bits are near copies mostly, but texts of Jaccard similarity 0.8 mostly differ in 3 to 11 bits, and balls of half of
that are beyond any size. ``keep_one`` with ``similarity`` takes the balls' links over five-word shingles as candidates, adds those that balls can't reach
(``shingles``), and decides all of them exactly by the shingle sets.

Nulls: a null text has no words and fingerprint zero, as an empty one; fingerprint zero is linked like any other. A null id is
kept, with the least non-null id of its group. Repeated rows are kept. An empty table gives an empty result. ``keep_one`` keeps one row of each
group, that of its least id; of rows with that id the one whose text, then whose other columns have the least hash, and repeated rows count once. Two
texts under one id are two documents. Rows with a null id can't be named and stay. Other columns, whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shingles
from tidemark.llm.components import components
from tidemark.llm.frames import as_bytes, maybe_among, slices, staged, unused

SEED = 42
#: Fingerprints link at this many differing bits or fewer; each emits its ball of half that radius.
RADIUS = 2
#: Fingerprints whose balls one task emits.
BALLS = 1 << 17


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """The 64-bit SimHash of a text: bit k is set if over half of its shingles' XXH64 values have it."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(words_per_shingle, len(words)) - 1
    value, hashed = SEED, xxhash.xxh64_intdigest
    got = np.fromiter((hashed(line[a:b], value) for a, b in zip((ends - size)[: len(ends) - k].tolist(), ends[k:].tolist(), strict=True)), np.uint64, len(words) - k)
    return shingles.majority(got)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, **hashes: Column) -> DataFrame:
    """(doc_id, fingerprint as a signed long) of each text of ``df``, with the bigint columns ``hashes`` between them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got = np.array([fingerprint(x, words_per_shingle) for x in as_bytes(batch.column(0))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(got)], [*batch.schema.names[1:], "fingerprint"])

    named = df.select(df[text_col].cast("string").alias("text"), df[id_col].cast("bigint").alias("doc_id"), *[x.alias(k) for k, x in hashes.items()])
    return named.mapInArrow(work, ", ".join(f"{x} bigint" for x in ("doc_id", *hashes, "fingerprint")))


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct long ``fingerprint`` values of a staged table, enough to join all within two bits."""
    flips = [1 << k if k < 63 else -(1 << 63) for k in range(64)]
    f = F.col("fingerprint")
    ball = F.array(F.struct(f.alias("variant"), F.lit(0).cast("bigint").alias("flip")), *[F.struct(f.bitwiseXOR(F.lit(x).cast("bigint")).alias("variant"), F.lit(x).cast("bigint").alias("flip")) for x in flips])
    # A fingerprint is a few bytes in its file and 65 rows here: tasks go by their number, not by the size of the files.
    tasks = max(distinct.sparkSession.sparkContext.defaultParallelism, -(-distinct.count() // BALLS))
    emitted = distinct.select("fingerprint").repartition(tasks).select(F.explode(ball).alias("x")).select("x.variant", "x.flip")
    buckets = emitted.groupBy("variant").agg(F.expr("bit_or(flip)").alias("flips"), F.max((F.col("flip") == 0).cast("int")).alias("itself"))
    buckets = buckets.where(F.expr("bit_count(flips) + itself > 1"))
    bits = F.filter(F.array(*[F.lit(x).cast("bigint") for x in flips]), lambda x: F.col("flips").bitwiseAND(x) != 0)
    members = F.concat(F.transform(bits, lambda x: F.col("variant").bitwiseXOR(x)), F.when(F.col("itself") == 1, F.array("variant")).otherwise(F.array().cast("array<bigint>")))
    found = buckets.select(members.alias("m")).select(F.array_min("m").alias("b"), F.explode("m").alias("a"))
    return found.where("a <> b").distinct().where(F.expr(f"bit_count(a ^ b) <= {RADIUS}"))


def node_links(known: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of ``known`` (``shingles.nodes``) whose fingerprints are within two bits, by ball hashing."""
    prints = staged(known.groupBy("fingerprint").agg(F.min("node").alias("first")), "distinct-fingerprints")
    same = known.join(prints, "fingerprint").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    ends = [prints.select(F.col("fingerprint").alias(x), F.col("first").alias(f"node_{x}")) for x in "ab"]
    near = near_links(prints).join(ends[0], "a").join(ends[1], "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return staged(same.union(near).distinct(), "ball-links")


def hex_digits(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """A row for each document: doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable by links."""
    known = staged(fingerprints(df, id_col, text_col, words_per_shingle), "fingerprints")
    distinct = staged(known.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    joined = components(near_links(distinct))
    rooted = distinct.join(joined, distinct["fingerprint"] == joined["node"], "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fingerprint", "component_id")
    return known.join(named, "fingerprint").select("doc_id", hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: bool = False) -> DataFrame:
    """One row of each group of near-duplicates: by fingerprints, or with ``similarity`` by five-word shingles of similarity 0.8 or more
    (``shingles.SIMILARITY``), of the pairs that balls or prefixes of the sets bring together."""
    key, row = unused(["__key", "__row"], df.columns)
    others = [df[c] for c, kind in df.dtypes if c not in (id_col, text_col) and "map<" not in kind]
    text_hash, row_hash = F.xxhash64(F.coalesce(df[text_col].cast("string"), F.lit(""))), F.xxhash64(*others) if others else F.lit(0).cast("bigint")
    if similarity:
        known = shingles.nodes(df, id_col, text_col, row_hash)
        joined = shingles.joined_nodes(df, known, text_col, node_links(known))
    else:
        known = staged(fingerprints(df, id_col, text_col, key=text_hash, row=row_hash), "fingerprints").withColumnRenamed("fingerprint", "node")
        joined = components(near_links(staged(known.select(F.col("node").alias("fingerprint")).distinct(), "distinct-fingerprints")))
    first = known.where("doc_id is not null").groupBy("node").agg(F.min(F.struct("doc_id", "key", "row")).alias("first"), F.count("*").alias("rows"))
    rooted = first.join(joined.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
    rooted = staged(rooted.select("node", F.coalesce("component", "node").alias("root"), "first", "rows"), "near-nodes")
    # Rows without a partner stay where they are; those of groups are shuffled, and the few that the bitmap takes for such.
    groups = staged(rooted.groupBy("root").agg(F.min("first").alias("first"), F.sum("rows").alias("rows")).select("root", "rows", "first.*"), "near-groups")
    several = rooted.join(groups.where("rows > 1"), "root", "left_semi")
    keys = staged(known.join(several, "node", "left_semi").select("key").distinct(), "near-keys")
    maybe, marked_id = unused(["__maybe", "__id"], [*df.columns, key, row])
    marked = maybe_among(df.withColumns({key: text_hash, row: row_hash}), key, keys, maybe).withColumn(marked_id, F.col(f"`{id_col}`").cast("bigint"))
    alone = marked.where(F.col(marked_id).isNull() | ~F.col(maybe))
    # Repeated rows are combined before the shuffle, and the join goes by the same keys.
    rows = marked.where(F.col(marked_id).isNotNull() & F.col(maybe)).dropDuplicates([marked_id, key, row])
    kept = groups.select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"), F.col("row").alias("kept_row"))
    return alone.select(*df.columns).unionByName(rows.join(kept, (F.col(marked_id) == F.col("kept_id")) & (F.col(key) == F.col("kept_key")) & (F.col(row) == F.col("kept_row")), "left_semi").select(*df.columns))
