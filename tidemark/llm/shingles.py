"""Near-duplicates by word shingles: an exact join of shingle sets at Jaccard similarity SIMILARITY or more.

A text is the set of its runs of WORDS words (all its words if it has fewer), as 64-bit hashes. Texts with equal sets are one node.
In any one order of all shingles, two sets of similarity 4/5 or more share a shingle among the first n // 5 + 1 of each (n: the
set's size), so nodes that meet in those prefixes are all the candidates there are. The order puts rare shingles first; how often
they occur is taken from a sample, which bears on the number of candidates and on nothing else.

One shuffle brings the nodes of a shingle together, and only shingles of several nodes are kept. Nodes that meet by a shingle of SMALL nodes or fewer,
as often as their sizes ask for, are candidates. Those of a more frequent one (copies with edits, mostly) are each linked to its least node.
Candidates that the caller brings (``links``) count like these. All of them are joined to groups, a group is dealt into blocks, and each two blocks of a group
are compared in a task of their own, as sparse products; only a spanning forest of the links leaves it. Every candidate is decided by its
sets. A shingle of more than HOT nodes is split into parts by node, whose least nodes are linked; no task holds all nodes of one, or a whole group.
The sample is a share of the texts, so the nodes that a shingle may have unnoticed stay as few in large tables; with a sample of fixed size
common passages enter the prefixes there, and groups grow until their blocks fill the disk.

Texts are not shuffled: those whose sets are asked for are found by a bitmap of their keys, and only sets travel.

A group of near copies is compared all with all, in blocks: its work grows with the square of its distinct members.

Nulls: a null text has no shingles, as an empty one; both are copies of each other. A null id is kept. Repeated rows are kept by
``near_duplicates``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.frames import as_bytes, give_back, maybe_among, short_shuffles, slices, staged
from tidemark.llm.metric_join import least_labels

SEED = 42
WORDS = 5
#: Least similarity, as numerator and denominator.
SIMILARITY = 4, 5
#: Nodes of a prefix shingle that are paired one by one; nodes and shingles of a block of a group; nodes of a part of a shingle.
SMALL, BLOCK, BLOCK_SHINGLES, HOT = 64, 512, 1 << 19, 20_000
#: Texts that say how frequent shingles are: at least so many, and this share. Shingles whose frequency is kept.
SAMPLE, SHARE, FREQUENT = 16_000, 1 / 16, 400_000


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text, as ascending XXH64 values."""
    import xxhash

    found = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size + 1) - 1
    k = min(words, len(found)) - 1
    value, hashed = SEED, xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(line[a:b], value) for a, b in zip((ends - size)[: len(ends) - k].tolist(), ends[k:].tolist(), strict=True)), np.uint64, len(found) - k))


def node_of(found: np.ndarray) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(found.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def similar(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of a and b shingles with ``common`` in both have the least similarity."""
    return SIMILARITY[1] * common >= SIMILARITY[0] * (a + b - common)


def prefix(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a set that a partner must share one of. ``frequent`` is ascending, with its ``counts``."""
    n = len(found)
    if not n:
        return found
    rank = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        rank = np.where(frequent[at] == found, counts[at], 0)
    most, whole = SIMILARITY
    return found[np.lexsort((found, rank))[: n - -(-most * n // whole) + 1]]


def ceil_div(a: Column, b: int) -> Column:
    return F.ceil(a / F.lit(b)).cast("bigint")


def least_meetings(a: Column, b: Column) -> Column:
    """How many shingles of both prefixes similar sets of a and b shingles have in common at least: what they share besides lies
    behind the prefix that ends first, so it is no more than is left of that set."""
    most, whole = SIMILARITY
    return ceil_div((a + b) * most, most + whole) - F.greatest(ceil_div(a * most, whole), ceil_div(b * most, whole)) + 1


def candidate_pairs(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of the nodes that share shingles of SMALL nodes or fewer as often as similar sets must. ``met``: shingle, node, size."""
    members = met.groupBy("shingle").agg(F.array_sort(F.collect_list(F.struct("node", "size"))).alias("m"))  # SMALL at most
    one = members.select("m", F.posexplode("m").alias("k", "x"))
    both = one.select("x", F.explode(F.slice("m", F.col("k") + 2, F.lit(SMALL))).alias("y"))
    most, whole = SIMILARITY
    size_a, size_b = F.col("x.size"), F.col("y.size")
    near = F.least(size_a, size_b) * whole >= F.greatest(size_a, size_b) * most
    both = both.where(near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), least_meetings(size_a, size_b).alias("need"))
    return both.groupBy("a", "b", "need").agg(F.count("*").alias("n")).where("n >= need").select("a", "b")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share."""
    g = len(sets)
    owner = np.repeat(np.arange(g), [len(x) for x in sets])
    names, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = times[column] > 1
    owner, (names, column) = owner[use], np.unique(column[use], return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((g, g), np.float32)
    for at in range(0, len(names), 4096):
        a, b = np.searchsorted(column, (at, at + 4096))
        if a < b:
            part = np.zeros((g, 4096), np.float32)
            part[owner[a:b], column[a:b] - at] = 1
            total += part @ part.T
    return total.astype(np.int32)


def near_links(docs: DataFrame, known: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between nodes, enough to join all that are similar. ``docs``: text and its key; ``known``: the rows of ``nodes``;
    ``links``: further pairs (a, b) of nodes to decide."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = known.count()
    share = min(1.0, max(SHARE, SAMPLE / max(1, total)))
    some = docs.where(F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(1 << 20)) < int(share * (1 << 20))).dropDuplicates(["key"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for x in as_bytes(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x).view(np.int64))], ["shingle"])

    times = some.select("text").mapInArrow(each, "shingle bigint").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    with short_shuffles(spark):
        got = times.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    frequent = got.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(frequent)
    shared = spark.sparkContext.broadcast((frequent[order], got.column("n").to_numpy()[order]))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = shared.value
        hot = np.flatnonzero(counts / share > HOT)
        hot, of = names[hot], np.ceil(counts[hot] / share / HOT).astype(np.int64)
        for batch in slices(batches, "text", 1 << 20):
            rows = []
            for x in as_bytes(batch.column(0)):
                found = shingles(x)
                first, node = prefix(found, names, counts), node_of(found)
                part = np.full(len(first), -1)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, first), len(hot) - 1)
                    part = np.where(hot[at] == first, node % of[at], -1)
                rows.append(np.stack([first.view(np.int64), part, np.full(len(first), node), np.full(len(first), len(found))], axis=1))
            got = np.unique(np.concatenate(rows), axis=0).T
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in got], ["shingle", "part", "node", "size"])

    postings = docs.select("text").mapInArrow(freed(prefixes), "shingle bigint, part bigint, node bigint, size bigint")
    postings = postings.repartition(tasks, "shingle", "part").dropDuplicates(["shingle", "part", "node", "size"])
    there = Window.partitionBy("shingle", "part")
    met = postings.withColumns({"n": F.count("*").over(there), "least": F.min("node").over(there)}).where("n > 1 or part >= 0")
    met = staged(met, "shingle-meetings")
    pairs = candidate_pairs(met.where((F.col("n") <= SMALL) & (F.col("part") < 0)).select("shingle", "node", "size"))
    stars = met.where((F.col("n") > SMALL) | (F.col("part") >= 0)).select(F.col("node").alias("a"), F.col("least").alias("b"))
    ends = met.where("part >= 0").select("shingle", "least").distinct()
    tops = ends.groupBy("shingle").agg(F.min("least").alias("b"))
    asked = pairs.union(stars).union(ends.join(tops, "shingle").select(F.col("least").alias("a"), "b"))
    groups = staged(components(asked if links is None else asked.union(links.select("a", "b"))), "shingle-groups")

    distinct = known.groupBy("node").agg(F.min("key").alias("key"), F.first("size").alias("size"))
    members = staged(groups.join(distinct, "node"), "shingle-members")
    sums = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("size") / F.lit(BLOCK_SHINGLES))).alias("blocks"))
    members = staged(members.join(sums, "component").select("component", "node", "key", "blocks"), "shingle-blocks")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in slices(batches, "text", 1 << 20):
            rows = [(k, shingles(x).tobytes()) for k, x in zip(batch.column(1).to_pylist(), as_bytes(batch.column(0)), strict=True) if not (k in sent or sent.add(k))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["key", "found"])

    texts = maybe_among(docs.select("text", "key"), "key", members.select("key"), "asked").where("asked").select("text", "key")
    dealt = members.join(texts.mapInArrow(freed(whole), "key bigint, found binary"), "key")
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node"), "blocks"))
    # Each two blocks of a group meet in one task.
    dealt = dealt.select("component", "node", "found", "mine", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "found")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets_ = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                size = np.array([len(x) for x in sets_])
                a, b = np.nonzero(np.triu(similar(common_counts(sets_), size[:, None], size[None, :]), 1))
                label = least_labels(len(nodes), a, b)
                name = np.array(nodes, np.int64)
                linked = label != np.arange(len(nodes))
                yield pa.RecordBatch.from_arrays([pa.array(name[linked]), pa.array(name[label[linked]])], ["a", "b"])

        for batch in batches:
            for *at, node, found in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if at != key:
                    yield from close()
                    key, nodes, sets_ = at, [], []
                if not nodes or nodes[-1] != node:  # a text that several tasks read comes more than once
                    nodes.append(node)
                    sets_.append(np.frombuffer(found, np.uint64))
        yield from close()

    together = dealt.repartition(tasks, "component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
    return staged(together.mapInArrow(freed(compared), "a bigint, b bigint"), "shingle-links")


def freed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, with memory given back at its end."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return each


def nodes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """(doc_id, key, row, node, size, fingerprint) of each row: hashes of its text, of ``row`` (0 if not given) and of its shingles, their number and
    their SimHash. Staged."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    docs = df.select(text.alias("text"), df[id_col].cast("bigint").alias("doc_id"), F.xxhash64(text).alias("key"), (F.lit(0).cast("bigint") if row is None else row).alias("row"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [(node_of(found), len(found), majority(found)) for found in map(shingles, as_bytes(batch.column(0)))]
            node, size, bits = zip(*rows, strict=True)
            made = [pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(np.array(bits, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], ["doc_id", "key", "row", "node", "size", "fingerprint"])

    return staged(docs.mapInArrow(freed(work), "doc_id bigint, key bigint, row bigint, node bigint, size bigint, fingerprint bigint"), "shingle-nodes")


def joined_nodes(df: DataFrame, known: DataFrame, text_col: str = "text", links: DataFrame | None = None) -> DataFrame:
    """(node, component) of the nodes that are similar to another; pairs of ``links`` are decided, too."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    return components(near_links(df.select(text.alias("text"), F.xxhash64(text).alias("key")), known, links))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id and component_id, the least doc_id reachable by links."""
    known = nodes(df, id_col, text_col)
    joined = joined_nodes(df, known, text_col)
    distinct = known.groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = distinct.join(joined.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    rooted = staged(rooted, "shingle-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return known.join(rooted.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
