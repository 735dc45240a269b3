"""Key queries: which rows and epochs a query touches, and the neighbours outside its ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ranges
from tidemark.operators.scan import keys_in_range
from tidemark.operators.store import snapshot_at

TOP = (1 << 256) - 1


def core_epochs(mapper: DataFrame, low: int, high: int, current: int | None = None) -> DataFrame:
    """User epochs from low to the lesser of high and the current epoch, without genesis (incremental epoch 0), in order."""
    high = high if current is None else min(high, current)
    m = mapper.where((F.col("user_epoch") >= low) & (F.col("user_epoch") <= high) & (F.col("incremental_epoch") > 0))
    return m.select(F.col("user_epoch").alias("epoch")).orderBy("epoch")


def core_rows(versions: DataFrame, mapper: DataFrame, low: int, high: int, key: Sequence[str], secondary: str, least: int | None = None, most: int | None = None) -> DataFrame:
    """(key, user epoch) of the rows in a query's index ranges; its other predicates don't count."""
    rows = versions
    if least is not None:
        rows = rows.where(F.col(secondary) >= least)
    if most is not None:
        rows = rows.where(F.col(secondary) <= most)
    return keys_in_range(rows, mapper, low, high, list(key))


def bracket_epochs(mapper: DataFrame, low: int, high: int) -> DataFrame:
    """One row: the nearest epochs below low and above high, null where there is none or where low or high is at the domain's end."""
    e = F.col("user_epoch")
    below = F.max(F.when(e < low, e)) if low > 0 else F.lit(None).cast("bigint")
    above = F.min(F.when(e > high, e)) if high < TOP else F.lit(None).cast("bigint")
    return mapper.agg(below.alias("below"), above.alias("above"))


def bracket_secondary(versions: DataFrame, epoch: int, key: Sequence[str], secondary: str, low: int, high: int) -> DataFrame:
    """Of the rows live at an (incremental) epoch, the one with the greatest secondary value below low and the one with the least
    above high (of equal values the one with the least key): side (-1 below, 1 above), secondary value and key."""
    s, live = F.col(secondary), snapshot_at(versions, epoch)
    id_ = F.struct(*key)
    names = list(dict.fromkeys([secondary, *key]))
    parts = []
    if low > 0:
        parts.append(live.where(s < low).agg(F.min_by(F.struct(*names), F.struct((-s).alias("s"), id_.alias("k"))).alias("r")).select(F.lit(-1).alias("side"), "r"))
    if high < TOP:
        parts.append(live.where(s > high).agg(F.min_by(F.struct(*names), F.struct(s.alias("s"), id_.alias("k"))).alias("r")).select(F.lit(1).alias("side"), "r"))
    if not parts:
        parts = [live.where(F.lit(False)).select(F.lit(0).alias("side"), F.struct(*names).alias("r"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.where("r is not null")
    return out.select("side", *[F.col(f"r.{c}").alias(c) for c in names])


def witness(versions: DataFrame, epoch: int, key: Sequence[str], secondary: str, low: int, high: int) -> DataFrame:
    """For an epoch without a row in [low, high], the row that shows it: the nearest below low, else the nearest above high. No row if
    the epoch has one in the range, or none at all."""
    found = snapshot_at(versions, epoch).where((F.col(secondary) >= low) & (F.col(secondary) <= high)).limit(1)
    near = bracket_secondary(versions, epoch, key, secondary, low, high)
    first = near.agg(F.min_by(F.struct(*near.columns), "side").alias("r")).where("r is not null").select("r.*")
    return first.join(found.agg(F.count("*").alias("__n")), F.col("__n") == 0).drop("__n")


def row_neighbours(live: DataFrame, epoch: str, secondary: str, key: Sequence[str]) -> DataFrame:
    """For each live row of an epoch, the key before and after it in the order of (secondary, key)."""
    names = list(dict.fromkeys([epoch, secondary, *key]))
    out = ranges.neighbours(live.select(*names), epoch, [secondary, *key], key)
    return out.select(*names, *[F.col(f"__{side}.{k}").alias(f"{side}_{k}") for k in key for side in ("before", "after")])


def chunk_plan(live: DataFrame, epoch: str, secondary: str, key: Sequence[str], size: int) -> DataFrame:
    """Rows in the order (epoch, secondary, key) cut into chunks of ``size`` consecutive ones: chunk, first and last epoch, rows."""
    placed = ranges.numbered(live.select(*dict.fromkeys([epoch, secondary, *key])), [epoch, secondary, *key])
    chunk = F.expr(f"(__position - 1) div {size:d}").alias("chunk")
    return placed.groupBy(chunk).agg(F.min(epoch).alias("first_epoch"), F.max(epoch).alias("last_epoch"), F.count("*").alias("n_rows"))


def merge_nodes(chunks: int, arity: int) -> list[tuple[int, int]]:
    """(level, position) of all nodes of the least tree that merges the chunks, ``arity`` at a time; leaves have the greatest level."""
    widths = [max(1, chunks)]
    while widths[-1] > 1:
        widths.append(-(-widths[-1] // arity))
    widths.reverse()
    return [(level, k) for level, width in enumerate(widths) for k in range(width)]
