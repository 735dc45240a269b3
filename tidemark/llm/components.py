"""Connected components of a links table, by alternating large-star and small-star steps.

Each step is an aggregation with partial results, so a node's links are combined before they are shuffled, followed by a join with one row
a node. There the links of a node do meet: adaptive execution splits such a partition (``spark.sql.adaptive.skewJoin``, on by default), as the
other side is unique. Every round is cut by a reliable checkpoint and only two numbers reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import cut


def _print(links: DataFrame) -> tuple:
    """Number of links and an order-free sum over them, to see whether a round changed anything."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links`` that has a link to another; component is the least node reachable.

    Links with a null end are ignored, repeated and reversed links count once. No links: no rows.
    """
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    links = cut(links)
    before = _print(links)
    while before[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a > b").distinct()
        links = cut(small)
        after = _print(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
