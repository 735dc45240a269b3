"""Helpers that the operators of this subpackage share: Arrow maps, staged tables and folders."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Arrow batches are cut into slices of about this many bytes of text before any per-document work.
SLICE_BYTES = 4 << 20

#: Rows that a Parquet scan decodes at a time where texts are whole.
SCAN_ROWS = 512

#: 64-bit words of a bitmap of keys at most.
MOST_WORDS = 1 << 18

#: White space between words, in every operator here: space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is made, but only in local mode, where driver
    and executors are one process.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    context.setCheckpointDir(folder)
    return folder


#: Paths made since the outermost ``scratch`` began; None outside of one.
_made: list[str] | None = None


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    if _made is not None:
        _made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Staged tables made inside are deleted at its end: for work whose result is written by then."""
    global _made
    before, _made = _made, []
    try:
        yield
    finally:
        made, _made = _made, before
        for path in made:
            remove(spark, path)


def staged(df: DataFrame, name: str, folder: str | None = None, compression: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: later uses neither
    recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = folder or fresh_path(spark, name)
    with short_shuffles(spark):
        df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that end inside are deleted with them, and don't wait until the driver happens to collect its garbage. Where
    the session sets this itself, that holds."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    mine = not spark.sparkContext.getConf().contains(name) and spark.conf.get(name, "false") == "false"
    if mine:
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        if mine:
            spark.conf.unset(name)


def maybe_among(df: DataFrame, column: str, keys: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean column ``name``: False only where the bigint ``column`` is none of ``keys`` (a staged table of one column). A bitmap of 16 bits
    a key, and of MOST_WORDS at most, is broadcast; a key that it holds by chance is for the join behind it to drop."""
    words = min(MOST_WORDS, 1 << max(4, (keys.count() // 4).bit_length()))
    at, bits = unused(["__at", "__bits"], [*df.columns, name])
    word = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(words).cast("bigint"))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(c, F.lit(2)), F.lit(64)).cast("int"))
    one = keys.toDF("key")
    table = one.select(word("key").alias(at), bit("key").alias(bits)).groupBy(at).agg(F.bit_or(bits).alias(bits))
    found = df.withColumn(name, word(column)).join(F.broadcast(staged(table, "bitmap")), F.col(name) == F.col(at), "left")
    return found.withColumn(name, F.coalesce(F.col(bits).bitwiseAND(bit(column)) != 0, F.lit(False))).drop(at, bits)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Bounds what a task holds of whole texts, for work of many stages on the same executors: scans decode SCAN_ROWS rows at a time and Arrow batches
    end at SLICE_BYTES. With Spark's 4096 rows and 64 MB a task's buffers are of tens of MB, which the JVM's heap does not give back
    between stages. Settings that the session or the cluster made itself stay. Results do not depend on them."""
    for name, value in (("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", SLICE_BYTES)):
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, str(value))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null texts are empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], size_by: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in consecutive slices whose column ``size_by`` holds about ``most`` bytes."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(size_by)).cast(pa.binary())), 0)
        group = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) // most
        ends = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def parts(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """A column of texts in consecutive parts of about ``most`` bytes."""
    for batch in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", most):
        yield batch.column(0)


def text_column(work: Callable[[Iterator[pa.Array]], Iterator[pa.Array]], kind: str) -> Callable[[Column], Column]:
    """A column of type ``kind`` computed in Python from a column of texts: from an iterator of texts, one array for each. Texts go to Python
    alone and don't come back; the rows' other columns stay in the JVM."""

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return arrow_udf(each, kind)


def arrow_map(df: DataFrame, columns: list[str], work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` over the Arrow batches of the named columns of ``df``."""
    return df.select(*columns).mapInArrow(work, schema)


def give_back() -> None:
    """Returns memory that this worker no longer uses to the system. Workers outlive tasks, and an executor pays for all of them."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def unused(names: list[str], taken: list[str]) -> list[str]:
    """The names, each with as many underscores behind it as it takes to differ from all of ``taken`` (in any case)."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        out.append(name)
    return out


def single_threaded() -> None:
    """Keeps libraries in Python workers from starting threads of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
