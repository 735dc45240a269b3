"""Looking at a store: rows of an epoch with their place in its tree, and a row's surroundings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import lineage
from tidemark.operators.epochs import EpochStore


def rows_at(store: EpochStore, table: str, epoch: int, order: str) -> DataFrame:
    """The live rows of a user epoch with position, parent, left_child, right_child and depth, ordered by the column ``order`` and the key."""
    live = store.at(table, epoch)
    if live is None:
        raise ValueError(f"{table} has no rows yet")
    key = store.tables[table]
    placed = lineage.positions(live.withColumn("epoch", F.lit(epoch)), "epoch", order, key)
    tree = lineage.topology(placed, "epoch", key).drop("epoch")
    return live.drop("valid_from", "valid_until").join(tree, key)


def around(store: EpochStore, table: str, epoch: int, order: str, position: int) -> DataFrame:
    """The row at a position with its parent and children: column ``place`` says which is which."""
    rows = rows_at(store, table, epoch, order)
    one = rows.where(F.col("position") == position).select(F.col("parent").alias("__p"), F.col("left_child").alias("__l"), F.col("right_child").alias("__r"))
    near = rows.join(F.broadcast(one))  # one row
    p = F.col("position")
    place = F.when(p == position, "row").when(p == F.col("__p"), "parent").when(p == F.col("__l"), "left").when(p == F.col("__r"), "right")
    return near.withColumn("place", place).where("place is not null").drop("__p", "__l", "__r")
