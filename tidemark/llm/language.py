r"""Operator 3: language identification with string kernels.

The kernel is the blended-spectrum presence kernel: the number of distinct 1-, 2- and 3-grams that two texts share,
over the root of the product of how many each has. Nyström landmarks (a few training texts of each language) give every text
the features K(x, L) (K(L, L) + jitter)^(-1/2), on which one ridge regression for each language is solved (targets 1 and 0).

Scoring folds the landmarks: K(x, L) A = |x|^(-1/2) P(x) (L' A), with P(x) the presence row of the text. A batch of
texts is one sparse product of presence rows and the n-gram x language matrix L' A, so each whole text is read once
whatever the number of landmarks.

N-grams run over letters alone: letters are lower-cased, each letter of the training texts has a code of its own, letters that
are in none share one, and any run of other characters is one space, which counts only beside a letter. Presence is exact, without hashing.

Training takes about ``per_language`` documents of each language by a hash of the id, and ``max_rows`` in all, from rows with a language, outside the
held-out fold; texts with more than MAX_GRAMS distinct n-grams are not learned from. Only n-gram sets reach the driver. At most ``max_languages``
languages are accepted; more are an error, never dropped.

Nulls: a null text, or one without a letter, is ``und`` with score 0. Rows with a null language are not learned from. A null
id has fold 0 (crc32 of the empty text) and is held out. Repeated rows are scored each. An empty table, or one without any usable
label, gives ``und`` with score 0 for all. Other columns, whatever their names, are kept by ``keep_known``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.frames import as_bytes, parts, slices, staged, text_column

#: Up to so many codes, a table of all n-grams finds a text's distinct ones; with more they are sorted.
DENSE = 64
#: Distinct n-grams of a training text at most.
MAX_GRAMS = 50_000
UNKNOWN = "und"


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, mod ``folds``; 0 for a null id."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


@functools.cache
def is_letter() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    table = np.zeros(0x110000, bool)
    table[0x41:0x32000] = [chr(cp).isalpha() for cp in range(0x41, 0x32000)]
    return table


class Spectrum:
    """The distinct 1- to 3-grams of texts as numbers. Codes: 0 for the space, 1 and on for ``letters``, the last for all other letters."""

    def __init__(self, letters: list[str]) -> None:
        self.codes = len(letters) + 2
        self.table = np.where(is_letter(), self.codes - 1, 0).astype(np.int32)
        self.table[[ord(x) for x in letters]] = np.arange(1, self.codes - 1)
        self.size = self.codes + self.codes**2 + self.codes**3
        self.seen = np.zeros(self.size, bool) if self.codes <= DENSE else None

    def grams(self, text: bytes) -> np.ndarray:
        """The distinct n-grams, ascending."""
        points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
        c = np.concatenate([[0], self.table[points], [0]])
        if not c.any():
            return np.zeros(0, np.int64)
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
        found, n = np.zeros(0, np.int64), self.codes
        for at in range(0, len(c) - 2, 1 << 20):  # long texts in parts
            part = c[at : at + (1 << 20) + 2].astype(np.int64)
            two = part[:-1] * n + part[1:]
            three = two[:-1] * n + part[2:] + (n + n * n)
            if self.seen is not None:
                self.seen[part] = True
                self.seen[two + n] = True
                self.seen[three] = True
            else:
                found = np.unique(np.concatenate([found, part, two + n, three]))
        if self.seen is not None:
            found = np.flatnonzero(self.seen)
            self.seen[found] = False
        return found[1:]  # the space alone says nothing


@dataclass
class LanguageModel:
    languages: list[str]
    letters: list[str]
    used: np.ndarray  # n-grams of landmarks, ascending
    weights: np.ndarray  # n-gram x language, with a last row of zeros for all others

    def score(self, texts: list[bytes], spectrum: Spectrum) -> tuple[list[str], list[float]]:
        rows = [spectrum.grams(x) for x in texts]
        sizes = np.array([len(r) for r in rows], np.int64)
        full = np.flatnonzero(sizes)
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not len(full) or not self.languages:
            return names, scores
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        found = np.concatenate([rows[k] for k in full])
        at = np.minimum(np.searchsorted(self.used, found), len(self.used) - 1)
        at[self.used[at] != found] = len(self.used)
        values = np.add.reduceat(self.weights[at], starts, axis=0, dtype=np.float64) / np.sqrt(sizes[full])[:, None]
        best = values.argmax(axis=1)
        # The regressions aim at 1 for the language and 0 for others; a text unlike all landmarks is near 0 for each.
        chance = np.clip(values[np.arange(len(full)), best], 0.0, 1.0)
        for k, b, p in zip(full.tolist(), best.tolist(), chance.tolist(), strict=True):
            names[k], scores[k] = self.languages[b], p
        return names, scores


def letters_of(texts: list[bytes]) -> set[str]:
    return {c for t in texts for c in set(t.decode("utf-8", "replace").lower()) if is_letter()[ord(c)]}


def fit(samples: list[tuple[str, bytes]], landmarks: int = 24, ridge: float = 1e-3, jitter: float = 1e-6) -> LanguageModel:
    """A model from (language, text) pairs; ``landmarks`` of each language are the first of it."""
    letters = sorted(letters_of([t for _, t in samples]))
    spectrum = Spectrum(letters)
    return solve([(x, spectrum.grams(t)) for x, t in samples], letters, landmarks, ridge, jitter)


def solve(samples: list[tuple[str, np.ndarray]], letters: list[str], landmarks: int = 24, ridge: float = 1e-3, jitter: float = 1e-6) -> LanguageModel:
    """A model from (language, n-grams) pairs."""
    known = [(x, g) for x, g in samples if len(g)]
    if not known:
        return LanguageModel([], letters, np.zeros(0, np.int64), np.zeros((1, 0), np.float32))
    languages = sorted({x for x, _ in known})
    chosen = [g for lang in languages for g in [g for x, g in known if x == lang][:landmarks]]
    used = np.unique(np.concatenate(chosen))  # n-grams of no landmark count in no product

    def place(g: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(used, g), len(used) - 1)
        return at[used[at] == g]

    lm = np.zeros((len(chosen), len(used)), np.float32)
    for k, g in enumerate(chosen):
        lm[k, place(g)] = 1 / np.sqrt(len(g))
    kernel = np.empty((len(known), len(chosen)))
    for at in range(0, len(known), 128):
        part = known[at : at + 128]
        presence = np.zeros((len(part), len(used)), np.float32)
        for k, (_, g) in enumerate(part):
            presence[k, place(g)] = 1 / np.sqrt(len(g))
        kernel[at : at + len(part)] = presence @ lm.T
    inner = (lm @ lm.T).astype(np.float64)
    e, v = np.linalg.eigh(inner + jitter * np.eye(len(inner)))
    root = v @ np.diag(1 / np.sqrt(np.maximum(e, jitter))) @ v.T
    features = kernel @ root
    names = np.array([x for x, _ in known])
    target = np.where(names[:, None] == np.array(languages)[None, :], 1.0, 0.0)
    share = np.array([1 / max(1, (names == x).sum()) for x in languages])
    weight = share[np.searchsorted(languages, names)]
    weight = weight / weight.mean()  # each language counts alike
    gram = (features * weight[:, None]).T @ features + ridge * len(known) * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, (features * weight[:, None]).T @ target)
    weights = np.zeros((len(used) + 1, len(languages)), np.float32)
    weights[:-1] = lm.T.astype(np.float64) @ (root @ solved)
    return LanguageModel(languages, letters, used, weights)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, held_out: int = 0, per_language: int = 600, max_languages: int = 500, max_rows: int = 12_000) -> LanguageModel:
    """Fits on about ``per_language`` documents of each language of ``df``, ``max_rows`` in all, outside the held-out fold."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(F.col(id_col), folds) != held_out))
    counts = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return fit([])
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    most = min(per_language, max_rows // len(counts))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, most / n) * (1 << 30)))])
    sample = rows.where(place < F.element_at(share, F.col(lang_col).cast("string")))
    sample = staged(sample.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), place.alias("place")), "language-sample")

    def alphabets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(sorted(letters_of(as_bytes(batch.column(0)))), pa.string())], ["letter"])

    letters = sorted(r.letter for r in sample.select("text").mapInArrow(alphabets, "letter string").distinct().collect())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum(letters)
        for batch in slices(batches, "text"):
            found = [g if len(g) <= MAX_GRAMS else None for g in map(spectrum.grams, as_bytes(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([None if g is None else g.astype("<i8").tobytes() for g in found], pa.binary())], ["lang", "place", "grams"])

    got = sample.select("lang", "text", "place").mapInArrow(sets, "lang string, place bigint, grams binary").where("grams is not null").limit(2 * max_rows).collect()
    got.sort(key=lambda r: (r.place, r.lang, bytes(r.grams)))
    return solve([(r.lang, np.frombuffer(bytes(r.grams), "<i8")) for r in got], letters)


def prediction(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """A struct of lang_pred and score for each text."""
    shared = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        spectrum = Spectrum(model.letters)
        for batch in batches:
            names, scores = [], []
            for part in parts(batch):
                for out, new in zip((names, scores), model.score(as_bytes(part), spectrum), strict=True):
                    out += new
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return text_column(work, "lang_pred string, score double")(text.cast("string"))


def language_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row for each document: doc_id, held_out, lang_pred, score."""
    model = train(df, id_col, text_col, lang_col)
    got = df.select(F.col(id_col).alias("doc_id"), prediction(df.sparkSession, model, F.col(text_col)).alias("got"))
    return got.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "got.lang_pred", "got.score")


def keep_known(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.1) -> DataFrame:
    """The rows of ``df`` whose language is known with a score of ``least`` or more: texts without letters and texts like no learned language go."""
    model = train(df, id_col, text_col, lang_col)
    got = prediction(df.sparkSession, model, F.col(text_col))
    return df.where(F.when(got["lang_pred"] != UNKNOWN, got["score"]) >= least)
