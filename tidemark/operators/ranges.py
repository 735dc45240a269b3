"""Places in a total order, by ranges of the whole order: no group, however large, is sorted in one task.

Rows are range-partitioned and sorted once, numbered within their range, and kept by a reliable checkpoint, so that all uses see the same
ranges. What is then gathered is a row for each range, or for each range and group that meet.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Of a number given by ``monotonically_increasing_id``, the lower bits count rows, the upper ones partitions.
ROW_BITS = 33
RANGE, AT = "__range", "__at"


def _checkpoints(spark: SparkSession) -> None:
    """A folder for checkpoints where the session names none, which is allowed in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="tidemark-"))


def ordered(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with __range, ascending with the order, and __at, the row's place (from 0) within its range. Runs at once."""
    _checkpoints(rows.sparkSession)
    sorted_ = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id()).checkpoint(eager=True)
    return sorted_.withColumns({RANGE: F.shiftright("__id", ROW_BITS), AT: F.col("__id").bitwiseAND((1 << ROW_BITS) - 1)}).drop("__id")


def placed(rows: DataFrame, group: str, by: Sequence[str]) -> DataFrame:
    """``rows`` with __position (from 1, in its group) and __size, the group's rows. A null group is one too."""
    o = ordered(rows, [group, *by])
    met = o.groupBy(F.col(group).alias("__g"), F.col(RANGE).alias("__r")).agg(F.min(AT).alias("__first"), F.count("*").alias("__n"))
    of_group = Window.partitionBy("__g")
    met = met.withColumns({"__before": F.sum("__n").over(of_group.orderBy("__r")) - F.col("__n"), "__size": F.sum("__n").over(of_group)})
    out = o.join(met, F.col(group).eqNullSafe(F.col("__g")) & (F.col(RANGE) == F.col("__r")))
    return out.select(*rows.columns, (F.col("__before") + F.col(AT) - F.col("__first") + 1).alias("__position"), "__size")


def numbered(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with __position, from 1, in the whole table. Equal rows have different places in no certain order."""
    o = ordered(rows, by)
    counts = o.groupBy(F.col(RANGE).alias("__r")).agg(F.count("*").alias("__n"))
    # One row a range is gathered.
    before = counts.select("__r", (F.sum("__n").over(Window.orderBy("__r")) - F.col("__n")).alias("__before"))
    return o.join(before, F.col(RANGE) == F.col("__r")).select(*rows.columns, (F.col("__before") + F.col(AT) + 1).alias("__position"))


def neighbours(rows: DataFrame, group: str, by: Sequence[str], key: Sequence[str]) -> DataFrame:
    """``rows`` with __before and __after, the key columns (a struct) of the row before and after in its group; null at the ends."""
    o = ordered(rows, [group, *by])
    row = F.struct(F.col(group).alias("g"), F.struct(*key).alias("k"))
    edges = o.groupBy(F.col(RANGE).alias("__r")).agg(F.min_by(row, AT).alias("__first"), F.max_by(row, AT).alias("__last"))
    # One row a range is gathered. Groups are compared afterwards, so that window and join go by the range alone and share a shuffle.
    edges = edges.select("__r", F.lag("__last").over(Window.orderBy("__r")).alias("__left"), F.lead("__first").over(Window.orderBy("__r")).alias("__right"))
    inside = Window.partitionBy(RANGE).orderBy(AT)
    o = o.withColumns({"__before": F.lag(row).over(inside), "__after": F.lead(row).over(inside)})
    out = o.join(edges, F.col(RANGE) == F.col("__r"))
    same = lambda x: F.when(x["g"].eqNullSafe(F.col(group)), x["k"])
    return out.select(*rows.columns, same(F.coalesce("__before", "__left")).alias("__before"), same(F.coalesce("__after", "__right")).alias("__after"))
