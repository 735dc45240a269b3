"""Paths to the root in the balanced tree over positions 1 to n, in closed form.

Position k with z trailing zero bits has level z. In a full tree its ancestor at level j > z is the position whose bits
above j are k's, whose bit j is one, and the rest zero; with n positions the ancestors are those of them up to n. Children
follow in the same way. So lineages need no recursion: each is one expansion of at most log2(n) rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ranges


def parent(k: int, n: int) -> int | None:
    z = (k & -k).bit_length() - 1
    for j in range(z + 1, n.bit_length()):
        up = (k >> (j + 1) << (j + 1)) | (1 << j)
        if up <= n:
            return up
    return None


def children(k: int, n: int) -> tuple[int | None, int | None]:
    z = (k & -k).bit_length() - 1
    left = k - (1 << (z - 1)) if z else None
    for j in reversed(range(z)):
        if k + (1 << j) <= n:
            return left, k + (1 << j)
    return left, None


def positions(live: DataFrame, epoch: str, secondary: str, key: Sequence[str]) -> DataFrame:
    """``live`` with __position (1 to the epoch's rows, by secondary and key) and __size, the epoch's rows."""
    return ranges.placed(live, epoch, [secondary, *key])


def _level(k: Column) -> Column:
    """Trailing zero bits of a positive number."""
    return F.bit_count(k.bitwiseAND(-k) - 1).cast("int")


def ancestors(k: Column, n: Column) -> Column:
    """Array of a position's ancestors, nearest first."""
    levels = F.sequence(F.lit(0), F.lit(61))
    two = F.lit(2).cast("bigint")
    at = lambda j: k - F.pmod(k, _power(j) * two) + _power(j)
    inside = F.filter(levels, lambda j: (j > _level(k)) & (_power(j) <= n))
    return F.filter(F.transform(inside, at), lambda x: x <= n)


def _power(j: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), j.cast("int"))


def left_child(k: Column) -> Column:
    """Null for a leaf's level."""
    z = _level(k)
    return F.when(z > 0, k - _power(F.greatest(z - 1, F.lit(0))))


def right_child(k: Column, n: Column) -> Column:
    """The highest position right of k below its own ancestors that is still in the tree; null without one."""
    z = _level(k)
    reach = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(z - 1, F.lit(0))), lambda j: k + _power(j)), lambda x: x <= n)
    return F.when(z > 0, F.array_max(reach))


def topology(placed: DataFrame, epoch: str, key: Sequence[str]) -> DataFrame:
    """For each row its position, parent, children and depth in its epoch's tree; the root has no parent."""
    k, n = F.col("__position"), F.col("__size")
    up = ancestors(k, n)
    return placed.select(epoch, *key, k.alias("position"), F.get(up, F.lit(0)).alias("parent"), left_child(k).alias("left_child"), right_child(k, n).alias("right_child"), F.size(up).cast("bigint").alias("depth"))


def wide_lineage(placed: DataFrame, core: Column, epoch: str, key: Sequence[str], depth: int = 2) -> DataFrame:
    """(epoch, key, is_core): the rows chosen by ``core``, all on their paths to the root, and their descendants ``depth`` levels down."""
    start = placed.where(core).select(F.col(epoch).alias("__e"), F.col("__position").alias("__p"), F.col("__size").alias("__n"))
    paths = start.select("__e", "__n", F.explode(F.array_append(ancestors(F.col("__p"), F.col("__n")), F.col("__p"))).alias("__p")).distinct()
    found, front = paths.select("__e", "__p"), paths
    for _ in range(depth):
        both = F.array(left_child(F.col("__p")), right_child(F.col("__p"), F.col("__n")))
        front = front.select("__e", "__n", F.explode(F.array_compact(both)).alias("__p")).distinct()
        found = found.unionByName(front.select("__e", "__p"))
    found = found.distinct()
    rows = placed.join(found, (F.col(epoch) == F.col("__e")) & (F.col("__position") == F.col("__p")))
    return rows.select(epoch, *key, F.coalesce(core, F.lit(False)).cast("bigint").alias("is_core"))
