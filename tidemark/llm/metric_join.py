"""Operator 2: exact metric range join of vectors by cosine.

On unit vectors cosine >= t is Euclidean distance <= r = sqrt(2 - 2 t). Pivots partition the vectors: a vector's home
is the cell of its nearest pivot. It is also sent to another cell c where the triangle inequality leaves room for a
partner: where d(x, p_c) - R_c <= r (R_c: the cell's radius) and x lies within r of the bisector of its own
pivot and p_c. Of two cells only the later one receives the other's vectors, so each pair meets once. A cell
with more than BLOCK home vectors is split into blocks that exchange vectors the same way. Each (cell, block) joins alone: its home
vectors are held, everything else streams past in tiles, so memory does not grow with a group.

A tile is one single-precision matrix product; pairs that it leaves undecided (``margin``) are decided in double precision. Only
counts and a spanning forest leave a block, never all pairs. Equal vectors are joined as one vector with a count.

How much is sent depends on the data: clustered vectors reach few cells, while vectors without any structure in many
dimensions reach nearly all, as no exact metric index can exclude them.

Nulls: null, empty or zero vectors and vectors with null or non-finite components link with nothing (n_links 0, their
own component). Vectors of different lengths never link. A null id is kept; it can't name a component. Repeated rows are
vectors of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.frames import staged

#: Home vectors held by one block, and vectors of a tile that streams past it.
BLOCK = 2048
#: Pivots: one for each BLOCK vectors, this many at most.
MAX_PIVOTS = 512
SLACK = 1e-9

#: What ``near_vectors`` returns for a table with unique ids, in DuckDB SQL over all pairs.
ORACLE_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where len(embedding) > 0 and list_bool_and([coalesce(isfinite(x), false) for x in embedding])
    and list_bool_or([x <> 0 for x in embedding])),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b
  on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and case when len(a.e) = len(b.e) then list_cosine_similarity(a.e, b.e) end >= 0.9),
reach as (
  select vec_id as a, vec_id as b from embeddings
  union select reach.a, links.b from reach join links on reach.b = links.a)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e
join (select a, min(b) as component_id from reach group by a) c on c.a = e.vec_id
left join (select a, count(*) as n from links group by a) n on n.a = e.vec_id
"""


def unit(vectors: list) -> np.ndarray:
    return normal(np.array(vectors, dtype=np.float64))


def matrix(column: pa.Array) -> np.ndarray:
    """The unit vectors of a column of equally long lists of numbers without nulls."""
    return normal(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def normal(x: np.ndarray) -> np.ndarray:
    """Unit vectors. Each is scaled by a power of two first, so that no square overflows or vanishes."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def margin(dim: int) -> float:
    """Single-precision cosines of unit vectors are no further than this from the true ones: the rounding of dim products and their sum."""
    return (dim + 8) * 2.0**-22


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and links a[i]-b[i], the least node of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(h: np.ndarray, x: np.ndarray, h32: np.ndarray, x32: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of h and x whose cosine is at least the threshold in double precision."""
    s = h32 @ x32.T
    near_by = margin(h.shape[1])
    i, j = np.nonzero(s >= threshold - near_by)
    near = s[i, j] < threshold + near_by
    if near.any():
        keep = ~near
        keep[near] = np.einsum("ij,ij->i", h[i[near]], x[j[near]]) >= threshold
        i, j = i[keep], j[keep]
    return i, j


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """A row for each vector: vec_id, n_links, component_id and kept (see the module's docstring)."""
    spark = df.sparkSession
    radius = math.sqrt(2 - 2 * threshold)
    rows = df.select(df[id_col].cast("bigint").alias("vec_id"), df[vector_col].cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(fine, F.col("v")))
    distinct = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    distinct = staged(distinct.withColumn("vid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vectors")

    pivots: dict[int, np.ndarray] = {}
    for dim, n in sorted((r.dim, r["count"]) for r in distinct.groupBy("dim").count().collect()):
        k = min(MAX_PIVOTS, max(1, math.ceil(n / BLOCK)))
        pivots[dim] = unit([r.v for r in distinct.where(F.col("dim") == dim).orderBy(F.xxhash64("v"), "v").select("v").limit(k).collect()])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                d = distances(matrix(part.column(1)), pivots[int(dim)])
                home = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int32)), pa.array(d.min(axis=1))], ["vid", "v", "n", "dim", "cell", "d"])

    homes = distinct.select("vid", "v", "n", "dim").mapInArrow(assign, "vid bigint, v array<double>, n bigint, dim int, cell int, d double")
    stats = {(r.dim, r.cell): (r.n, r.r) for r in homes.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect()}
    reach = {dim: np.array([stats.get((dim, c), (0, -9.0))[1] for c in range(len(p))]) for dim, p in pivots.items()}
    blocks = {dim: np.array([max(1, math.ceil(stats.get((dim, c), (0, 0))[0] / BLOCK)) for c in range(len(p))]) for dim, p in pivots.items()}
    gaps = {dim: distances(p, p) for dim, p in pivots.items()}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                p, count = pivots[int(dim)], blocks[int(dim)]
                for at in range(0, part.num_rows, BLOCK):
                    few = part.slice(at, BLOCK)
                    d = distances(matrix(few.column(1)), p)
                    home, mine = few.column(4).to_numpy(), few.column(5).to_numpy()
                    gap = gaps[int(dim)][home]
                    beyond = np.where(gap > 0, (d**2 - mine[:, None] ** 2) / np.maximum(2 * gap, SLACK), 0.0)
                    near = (d - reach[int(dim)][None, :] <= radius + SLACK) & (beyond <= radius + SLACK) & (np.arange(len(p))[None, :] > home[:, None])
                    block = few.column(0).to_numpy() % count[home]
                    # Its home block; the earlier blocks of its cell; all blocks of the later cells within reach.
                    row, cell = np.nonzero(near)
                    k = len(home)
                    out = [(np.arange(k), home, block, np.zeros(k, np.int8))]
                    out += [(r := np.flatnonzero(block > b), home[r], np.full(len(r), b), np.ones(len(r), np.int8)) for b in range(int(block.max(initial=0)))]
                    out += [(row[r], cell[r], np.full(len(r), b), np.ones(len(r), np.int8)) for b in range(int(count.max())) if len(r := np.flatnonzero(count[cell] > b))]
                    for index, c, b, kind in out:
                        if len(index):
                            sent = few.take(pa.array(index))
                            key = int(dim) * (1 << 40) + c.astype(np.int64) * (1 << 20) + b
                            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind), sent.column(0), sent.column(1), sent.column(2)], ["key", "kind", "vid", "v", "n"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: int | None = None
        ids = counts = vectors = single = found = label = np.zeros(0)

        def close() -> Iterator[pa.RecordBatch]:
            if key is not None and len(ids):
                yield result(ids, found, ids[label])

        def result(vid: np.ndarray, links: np.ndarray, to: np.ndarray) -> pa.RecordBatch:
            keep = (links > 0) | (vid != to)
            return pa.RecordBatch.from_arrays([pa.array(vid[keep]), pa.array(links[keep].astype(np.int64)), pa.array(to[keep])], ["vid", "links", "to"])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            kinds = batch.column(1).to_numpy()
            bounds = [0, *(np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                for start in range(a, b, BLOCK):
                    part = batch.slice(start, min(BLOCK, b - start))
                    if keys[start] != key:
                        yield from close()
                        key = int(keys[start])
                        ids, counts, found, label = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
                        vectors = single = None
                    x, vid, n = matrix(part.column(3)), part.column(2).to_numpy(), part.column(4).to_numpy()
                    x32 = x.astype(np.float32)
                    if kinds[start] == 0:  # home vectors: join them with those held and hold them
                        held = len(ids)
                        vectors = x if vectors is None else np.concatenate([vectors, x])
                        single = vectors.astype(np.float32)
                        ids, counts = np.concatenate([ids, vid]), np.concatenate([counts, n])
                        found = np.concatenate([found, np.zeros(len(vid))])
                        i, j = linked(vectors, x, single, x32, threshold)
                        i, j = i[i < j + held], j[i < j + held]
                        found += np.bincount(i, weights=n[j], minlength=len(ids)) + np.bincount(j + held, weights=counts[i], minlength=len(ids))
                        old = np.concatenate([label, np.arange(held, len(ids))]).astype(np.int64)
                        label = least_labels(len(ids), np.concatenate([np.arange(len(ids)), i]), np.concatenate([old, j + held]))
                    elif vectors is not None:  # vectors from other blocks: the links are to those held
                        i, j = linked(vectors, x, single, x32, threshold)
                        if not len(i):
                            continue
                        h = len(ids)
                        found += np.bincount(i, weights=n[j], minlength=h)
                        got = least_labels(h + len(vid), np.concatenate([np.arange(h), i]), np.concatenate([label, j + h]))
                        label = got[:h]
                        links = np.bincount(j, weights=counts[i], minlength=len(vid))
                        yield result(vid, links, np.where(got[h:] < h, ids[np.minimum(got[h:], h - 1)], vid))
        yield from close()

    sent = homes.mapInArrow(send, "key bigint, kind tinyint, vid bigint, v array<double>, n bigint")
    parts = sent.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(join, "vid bigint, links bigint, to bigint")
    parts = staged(parts, "vector-links")
    joined = components(parts.select(F.col("vid").alias("a"), F.col("to").alias("b")))
    links = parts.groupBy("vid").agg(F.sum("links").alias("links"))
    known = distinct.select("v", "vid", "least", "n").join(links, "vid", "left").join(joined, F.col("vid") == F.col("node"), "left")
    known = known.select("v", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "vid").alias("root"))
    known = staged(known, "vector-classes")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = known.join(least, "root").select("v", "n_links", "component_id")
    valid = rows.where("v is not null").join(classes, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return valid.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
