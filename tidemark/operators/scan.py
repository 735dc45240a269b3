"""Versions to live rows: a version is live at every epoch from valid_from to valid_until, both included.

Versions use dense incremental epochs, queries user epochs; a mapper (user_epoch, incremental_epoch) joins the two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FROM, UNTIL = "valid_from", "valid_until"
#: Epochs of a range up to this number are broadcast (16 bytes each); more are met by expansion and an equality join.
BROADCAST_EPOCHS = 100_000


def mapped_range(mapper: DataFrame, low: int, high: int) -> DataFrame:
    """The mapper's rows with user epochs from low to high."""
    return mapper.where((F.col("user_epoch") >= low) & (F.col("user_epoch") <= high)).select("user_epoch", "incremental_epoch")


def ends(mapper: DataFrame, low: int, high: int) -> tuple[int, int, int]:
    """Least and greatest incremental epoch of a user range, and how many there are. An empty range is (0, -1, 0)."""
    r = mapped_range(mapper, low, high).agg(F.min("incremental_epoch"), F.max("incremental_epoch"), F.count("*")).first()
    return (0, -1, 0) if not r[2] else (int(r[0]), int(r[1]), int(r[2]))


def overlapping(versions: DataFrame, first: int, last: int) -> DataFrame:
    """Versions live at some epoch from first to last; plain comparisons, so they reach the scan."""
    return versions.where((F.col(FROM) <= last) & (F.col(UNTIL) >= first))


def epoch_range(versions: DataFrame, mapper: DataFrame, low: int, high: int, primary: str = "epoch", keep_lifetime: bool = False) -> DataFrame:
    """One row for each live (version, user epoch) of a range, with the user epoch as column ``primary``."""
    first, last, n = ends(mapper, low, high)
    live = overlapping(versions, first, last)
    chosen = mapped_range(mapper, low, high)
    if n <= BROADCAST_EPOCHS:
        out = live.join(F.broadcast(chosen), (F.col("incremental_epoch") >= F.col(FROM)) & (F.col("incremental_epoch") <= F.col(UNTIL)))
    else:
        # Overlap is established above: sequence() would count down for versions outside the range.
        steps = live.withColumn("__e", F.explode(F.sequence(F.greatest(F.col(FROM), F.lit(first)), F.least(F.col(UNTIL), F.lit(last)))))
        out = steps.join(chosen, F.col("__e") == F.col("incremental_epoch")).drop("__e")
    out = out.drop("incremental_epoch", *([] if keep_lifetime else [FROM, UNTIL]))
    return out.withColumnRenamed("user_epoch", primary)


def weighted(versions: DataFrame, mapper: DataFrame, low: int, high: int, name: str = "n") -> DataFrame:
    """Versions live in a range with ``name``, the number of its epochs at which they are. Incremental epochs are dense, so it is a difference."""
    first, last, _ = ends(mapper, low, high)
    return overlapping(versions, first, last).withColumn(name, (F.least(F.col(UNTIL), F.lit(last)) - F.greatest(F.col(FROM), F.lit(first)) + 1).cast("bigint"))


def keys_in_range(versions: DataFrame, mapper: DataFrame, low: int, high: int, key: list[str]) -> DataFrame:
    """(key, user epoch) of all live rows of a range, by expansion over dense incremental epochs."""
    first, last, _ = ends(mapper, low, high)
    steps = overlapping(versions, first, last).select(*key, F.explode(F.sequence(F.greatest(F.col(FROM), F.lit(first)), F.least(F.col(UNTIL), F.lit(last)))).alias("__e"))
    chosen = mapped_range(mapper, low, high)
    return steps.join(chosen, F.col("__e") == F.col("incremental_epoch")).select(*key, F.col("user_epoch").alias("epoch"))
