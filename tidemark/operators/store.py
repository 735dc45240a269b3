"""Versioned rows: built from update logs, read at an epoch, changed by batches, rolled back.

A version is (key columns, value columns, valid_from, valid_until); an open version ends at OPEN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import EpochError, KeyStateError

FROM, UNTIL = "valid_from", "valid_until"
OPEN = (1 << 63) - 1
INSERT, UPDATE, DELETE = "insert", "update", "delete"


def build_versions(log: DataFrame, key: Sequence[str], epoch: str = "epoch", deleted: str | None = None, last: int = OPEN) -> DataFrame:
    """Versions from a log with one row for each (key, epoch): each ends where the key's next row begins.

    Rows whose ``deleted`` is true only end the version before them. Versions that are still open end at ``last``.
    """
    w = Window.partitionBy(*key).orderBy(epoch)
    out = log.withColumn(UNTIL, F.coalesce(F.lead(epoch).over(w) - 1, F.lit(last)).cast("bigint")).withColumnRenamed(epoch, FROM)
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else out


def last_writes(events: DataFrame, key: Sequence[str], epoch: str, order: str) -> DataFrame:
    """Of all writes to a key in one epoch, the one with the greatest ``order``, which is unique among them."""
    values = [c for c in events.columns if c not in (*key, epoch)]
    # One max_by a column, not one of a struct: with numbers alone the aggregation is by hash.
    return events.groupBy(*key, epoch).agg(*[F.max_by(c, order).alias(c) for c in values])


def snapshot_at(versions: DataFrame, epoch: int) -> DataFrame:
    """The versions live at an epoch."""
    return versions.where((F.col(FROM) <= epoch) & (F.col(UNTIL) >= epoch))


def born_at(versions: DataFrame, epoch: int) -> DataFrame:
    """The versions that begin at an epoch; deletions don't show."""
    return versions.where(F.col(FROM) == epoch)


def size_at(versions: DataFrame, epoch: int) -> DataFrame:
    """One row: the number of live rows."""
    return snapshot_at(versions, epoch).agg(F.count("*").alias("size"))


def keys_at(versions: DataFrame, key: Sequence[str], epoch: int) -> DataFrame:
    return snapshot_at(versions, epoch).select(*key)


def get_at(versions: DataFrame, key: dict, epoch: int) -> DataFrame:
    """The version of one key at an epoch, if there is one."""
    out = snapshot_at(versions, epoch)
    for name, value in key.items():
        out = out.where(F.col(name) == F.lit(value))
    return out


def get_many_at(versions: DataFrame, pairs: DataFrame, key: Sequence[str], epoch: str = "epoch") -> DataFrame:
    """The versions of (key, epoch) pairs; pairs without one are absent. The smaller side is for the optimiser to find."""
    p = pairs.select(*[F.col(k).alias(f"__{k}") for k in key], F.col(epoch))
    on = [F.col(k) == F.col(f"__{k}") for k in key] + [F.col(epoch) >= F.col(FROM), F.col(epoch) <= F.col(UNTIL)]
    return versions.join(p, on).drop(*[f"__{k}" for k in key])


def contains_at(versions: DataFrame, key: dict, epoch: int) -> bool:
    return get_at(versions, key, epoch).limit(1).count() > 0


def any_key_at(versions: DataFrame, key: Sequence[str], epoch: int) -> DataFrame:
    """One key that is live at an epoch, the first by a hash of it."""
    live = keys_at(versions, key, epoch)
    return live.orderBy(F.xxhash64(*key), *key).limit(1)


def merge_cells(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``old`` with the non-null cells of ``new`` in their place; columns that ``old`` lacks are dropped."""
    shared = [c for c in old.columns if c in new.columns and c not in key]
    n = new.select(*key, *[F.col(c).alias(f"__{c}") for c in shared])
    cells = [F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in shared else F.col(c) for c in old.columns]
    return old.join(n, list(key), "left").select(*cells)


def net_changes(batch: DataFrame, key: Sequence[str], op: str = "op", order: str = "seq") -> DataFrame:
    """The last operation on each key with __first, the first one, and __bad, whether one does not follow from the one before it."""
    w = Window.partitionBy(*key).orderBy(order)
    before = F.lag(op).over(w)
    bad = before.isNotNull() & ((F.col(op) == INSERT) != (before == DELETE))
    seen = batch.withColumn("__bad", bad)
    values = [c for c in batch.columns if c not in key]
    folded = seen.groupBy(*key).agg(F.max_by(F.struct(*values), order).alias("__v"), F.min_by(op, order).alias("__first"), F.max(F.coalesce("__bad", F.lit(False))).alias("__bad"))
    return folded.select(*key, *[F.col(f"__v.{c}").alias(c) for c in values], "__first", "__bad")


def check_batch(versions: DataFrame, batch: DataFrame, key: Sequence[str], op: str = "op", order: str = "seq") -> None:
    """Raises KeyStateError where a batch inserts a live key, or updates or deletes one that is not live."""
    net = net_changes(batch, key, op, order)
    live = versions.where(F.col(UNTIL) == OPEN).select(*key, F.lit(True).alias("__live"))
    wrong = net.join(live, list(key), "left").where(F.col("__bad") | ((F.col("__first") == INSERT) == F.coalesce("__live", F.lit(False))))
    found = wrong.select(*key, "__first").limit(1).collect()
    if found:
        raise KeyStateError(f"{found[0]['__first']} of key {[found[0][k] for k in key]}")


def apply_batch(versions: DataFrame, batch: DataFrame, key: Sequence[str], epoch: int, op: str = "op", order: str = "seq") -> DataFrame:
    """The versions after a batch of operations is committed as ``epoch``: touched open versions end before it, inserted and updated
    keys begin at it, all other rows are as they were. A key that the batch both inserts and deletes leaves no trace."""
    net = net_changes(batch, key, op, order)
    touched = net.select(*[F.col(k).alias(f"__{k}") for k in key], F.lit(True).alias("__touched"))
    on = [F.col(k) == F.col(f"__{k}") for k in key] + [F.col(UNTIL) == OPEN]
    kept = versions.join(touched, on, "left").withColumn(UNTIL, F.when(F.col("__touched"), F.lit(epoch - 1)).otherwise(F.col(UNTIL)).cast("bigint"))
    opened = net.where(F.col(op) != DELETE).withColumn(FROM, F.lit(epoch).cast("bigint")).withColumn(UNTIL, F.lit(OPEN).cast("bigint"))
    return kept.select(*versions.columns).unionByName(opened.select(*versions.columns))


def rollback(versions: DataFrame, mapper: DataFrame, epoch: int) -> tuple[DataFrame, DataFrame]:
    """Versions and mapper as they were at a user epoch; rolling back to the current epoch changes nothing."""
    ends = mapper.agg(F.min("user_epoch"), F.max("user_epoch"), F.max(F.when(F.col("user_epoch") <= epoch, F.col("incremental_epoch")))).first()
    if ends[0] is None or epoch < ends[0]:
        raise EpochError(f"epoch {epoch} is before the first")
    if epoch > ends[1]:
        raise EpochError(f"epoch {epoch} is in the future")
    e = int(ends[2])
    kept = versions.where(F.col(FROM) <= e).withColumn(UNTIL, F.when(F.col(UNTIL) >= e, F.lit(OPEN)).otherwise(F.col(UNTIL)).cast("bigint"))
    return kept, mapper.where(F.col("user_epoch") <= epoch)


def to_incremental(frame: DataFrame, mapper: DataFrame, user: str = "user_epoch") -> DataFrame:
    """``frame`` with incremental_epoch for its user epochs."""
    return frame.join(mapper.select(F.col("user_epoch").alias("__u"), "incremental_epoch"), F.col(user) == F.col("__u")).drop("__u")


def neighbours_of_epochs(mapper: DataFrame) -> DataFrame:
    """(user_epoch, previous, next) of each epoch; null at the ends. Incremental epochs are dense, so neighbours meet by equality."""
    m = mapper.select("user_epoch", "incremental_epoch")
    before = m.select(F.col("user_epoch").alias("previous"), (F.col("incremental_epoch") + 1).alias("i"))
    after = m.select(F.col("user_epoch").alias("next"), (F.col("incremental_epoch") - 1).alias("i"))
    out = m.withColumnRenamed("incremental_epoch", "i").join(before, "i", "left").join(after, "i", "left")
    return out.select("user_epoch", "previous", "next")


def epoch_extremes(live: DataFrame, epoch: str, value: str) -> DataFrame:
    """Least and greatest value, and rows, of each epoch."""
    return live.groupBy(epoch).agg(F.min(value).alias("least"), F.max(value).alias("greatest"), F.count("*").alias("n_rows"))
