"""Operator 7: a quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from whole texts with numpy over their bytes and words. Trees are grown on the driver from at most
about ``max_rows`` labelled documents (chosen by a hash of the id), with statistics cut into at most 64 bins by quantiles,
logistic loss and leaf values by Newton steps. All trees are complete and flattened into three arrays (feature, threshold,
leaf), so a batch of documents walks down all levels with a few numpy gathers for each tree.

Nulls: a null text has the statistics of an empty one. Labels that are null are not learned from, nor are rows with
a null id; repeated labels count each. A null id is not held out (crc32 of the empty text is 0). Repeated rows are scored each. Without any
usable label every score is 0.5. An empty table gives an empty result. Other columns, whatever their names, are kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.frames import parts, slices, text_column
from tidemark.llm.language import fold

#: Labels are not learned from rows of this fold.
FOLDS, HELD_OUT = 4, 2
#: Scores from here on predict label 1.
CUTOFF = 0.7

_CLASS = np.zeros(256, np.int64)  # of bytes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 stop and comma, 5 other marks, 6 space, 7 line feed, 8 continuation
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASS[_c] = 5
for _c in b".,;:?'\"()-":
    _CLASS[_c] = 4
_CLASS[[32, 9, 11, 12, 13]] = 6
_CLASS[10] = 7
_CLASS[0x80:0xC0] = 8


def statistics(text: bytes) -> list[float]:
    """Statistics of one text; all are 0 for an empty one."""
    if not text:
        return [0.0] * N_STATISTICS
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=9)
    chars = len(raw) - kinds[8]
    letters = kinds[0] + kinds[1] + kinds[2]
    words = text.split()
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    distinct = len(set(words))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = text.split(b"\n")
    marks = counts[[ord(x) for x in "!|#$%&*"]].sum()
    tails = sum(w[-1] in b"!|#$%&*" for w in words)
    p = counts[counts > 0] / len(raw)
    return [
        float(np.log1p(chars)),
        float(np.log1p(len(words))),
        float(sizes.mean()) if len(words) else 0.0,
        float(sizes.std()) if len(words) else 0.0,
        float(sizes.max()) if len(words) else 0.0,
        distinct / n,
        repeats / n,
        kinds[2] / max(1.0, letters),
        kinds[3] / chars,
        kinds[4] / chars,
        kinds[5] / chars,
        kinds[6] / chars,
        kinds[0] / chars,
        marks / chars,
        tails / n,
        len(set(lines)) / len(lines),
        float(np.log1p(len(lines))),
        chars / len(lines),
        float(-(p * np.log2(p)).sum()),
        distinct / (n**0.5),
    ]


N_STATISTICS = 20


@dataclass
class Forest:
    """Complete trees of one depth: feature and threshold by tree and inner node, leaf by tree and leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(self.leaf.shape[1]).bit_length() - 1 if len(self.leaf) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Forest:
    """Gradient boosting of ``trees`` complete trees on rows x and labels y (0 or 1)."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    empty = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0)
    if not len(y):
        return empty
    weight = np.ones(len(y)) if weight is None else weight
    share = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    raw, n = np.full(len(y), base), x.shape[1]
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, threshold, split = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            local = node - first
            best = np.full(width, 1e-6)
            for f in range(n):
                at = local * bins + binned[:, f]
                sg = np.bincount(at, weights=g, minlength=width * bins).reshape(width, bins).cumsum(axis=1)
                sh = np.bincount(at, weights=h, minlength=width * bins).reshape(width, bins).cumsum(axis=1)
                sn = np.bincount(at, minlength=width * bins).reshape(width, bins).cumsum(axis=1)
                tg, th, tn = sg[:, -1:], sh[:, -1:], sn[:, -1:]
                gain = sg**2 / (sh + ridge) + (tg - sg) ** 2 / (th - sh + ridge) - tg**2 / (th + ridge)
                gain[(sn < least) | (tn - sn < least)] = -1
                gain[:, len(edges[f]) :] = -1
                k = gain.argmax(axis=1)
                for w in np.flatnonzero(gain[np.arange(width), k] > best):
                    best[w] = gain[w, k[w]]
                    feature[first + w], split[first + w], threshold[first + w] = f, k[w], edges[f][k[w]]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > split[node])
        at = node - inner
        value = rate * np.bincount(at, weights=g, minlength=leaves) / (np.bincount(at, weights=h, minlength=leaves) + ridge)
        raw += value[at]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), base)


def measured(df: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """The named columns of ``df`` and ``stats``, the statistics of the text."""
    from pyspark.sql.types import ArrayType, DoubleType, StructType

    rows = df.select(*columns, F.col(text_col).cast("binary").alias("__text"))
    schema = StructType.fromJson(rows.drop("__text").schema.jsonValue()).add("stats", ArrayType(DoubleType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            stats = [statistics(x or b"") for x in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(stats, pa.list_(pa.float64()))], [*columns, "stats"])

    return rows.mapInArrow(work, schema)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 16_000) -> Forest:
    """Fits on about ``max_rows`` labelled documents outside the held-out fold (twice as many at most). A label given n times weighs n."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(F.col(id_col), FOLDS) != HELD_OUT))
    usable = usable.groupBy(F.col(id_col).alias("__labelled"), F.col(label_col).cast("int").alias("__label")).agg(F.count("*").cast("double").alias("__times"))
    n = usable.count()
    if not n:
        return grow(np.zeros((0, N_STATISTICS)), np.zeros(0))
    share = int(min(1.0, max_rows / n) * (1 << 30))
    chosen = usable.where(F.pmod(F.xxhash64("__labelled"), F.lit(1 << 30)) < share)
    texts = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = texts.join(F.broadcast(chosen), F.col("__id") == F.col("__labelled"))  # about max_rows small rows, as ids are distinct in them
    rows = measured(rows, ["__id", "__label", "__times"], "__text")
    # An id with many texts may not flood the driver either.
    got = rows.orderBy(F.xxhash64("__id", "stats"), "__id", "__label", "stats").limit(2 * max_rows).collect()
    got.sort(key=lambda r: (r[0], r[1], r[3]))
    return grow(np.array([r[3] for r in got]).reshape(len(got), N_STATISTICS), np.array([r[1] for r in got], float), np.array([r[2] for r in got], float))


def scores(spark: SparkSession, forest: Forest, text: Column) -> Column:
    """The chance that a text has label 1."""
    shared = spark.sparkContext.broadcast(forest)

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [shared.value.score(np.array([statistics(t or b"") for t in part.cast(pa.binary()).to_pylist()]).reshape(len(part), N_STATISTICS)) for part in parts(batch)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return text_column(work, "double")(text.cast("string"))


def quality_report(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted."""
    forest = train(df, labels, id_col, text_col)
    rows = df.select(F.col(id_col).alias("doc_id"), scores(df.sparkSession, forest, F.col(text_col)).alias("score"))
    return rows.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``df`` whose score is ``cutoff`` or more."""
    forest = train(df, labels, id_col, text_col)
    return df.where(scores(df.sparkSession, forest, F.col(text_col)) >= cutoff)
