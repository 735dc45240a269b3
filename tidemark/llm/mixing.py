"""Operator 9 (DataFrame functions only): mixing sources to target weights by capped water-filling.

Sources are aggregated once. A source's target is its weight's share of the volume, at most ``max_epochs`` times its
size; what is cut off is shared again by weight. The fixed point of that loop is found in one pass over the sources in order
of cap / weight: a source is capped exactly if its cap is at most the level that the rest would have.

A source with e = target / size epochs takes each document floor(e) times and, of the fraction left, the documents first
in a seeded order (the MD5 of seed and id) until their words come nearest to it. Where that order
stops is searched in histograms by the digest's leading digits: a histogram of 16^3 cells a source, one of 16^3 cells
within the cell where the source stops, and then the few documents of one cell of 16^6. So no source is sorted,
however large. The rest of the work is one scan, joined with one row a source.

Nulls: a null text has size 0; documents with a null source form a source of their own, last; a null id is ordered as an empty
one. Rows that repeat an id and source fall on one place of the order and are taken together. Sources of size 0 have target 0.
An empty table gives an empty result. Other columns, whatever their names, are kept by ``mix``.

The fill's windows run over one row a source in one task: fine for millions of sources, and sources are no more than that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import WORD_PATTERN, staged, unused

#: Weights by rank of the source, repeating; share of all sizes that the mix takes; most repetitions.
WEIGHTS, SHARE, MAX_EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix-0"
#: Sources up to this number are broadcast (under 100 bytes each); more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of runs of other characters than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def order_key(id_col: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))


def water_fill(sources: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """``sources`` (source, source_size) with target. Its windows run over one row a source."""
    n = len(weights)
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(n)) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    everything = Window.partitionBy(F.lit(0))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("volume", F.lit(float(share)) * F.sum("source_size").over(everything))
    s = s.withColumn("caps", F.sum("cap").over(upto)).withColumn("left", F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight"))
    level = (F.col("volume") - (F.col("caps") - F.col("cap"))) / F.col("left")  # the level if all before are capped, and no more
    s = s.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    first_free = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.coalesce("source", F.lit("")), F.col("level")))).over(everything)
    s = s.withColumn("common", first_free["level"])
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("common")).alias("target"))


#: What ``mix_report`` returns for the production parameters, in DuckDB SQL: here every source is sorted whole.
ORACLE_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('mix-0:' || coalesce(cast(doc_id as varchar), '')) as key
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         ([3.0, 1.0, 2.0]::double[])[(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from d group by source),
c as (select *, source_size * 2.0::double as cap, 1.5::double * (sum(source_size) over ())::double as volume from s),
r as (
  select *, sum(cap) over o as caps, sum(weight) over () - sum(weight) over o + weight as rest
  from c window o as (order by cap / weight, source nulls last rows unbounded preceding)),
l as (select *, (volume - (caps - cap)) / rest as level from r),
t as (
  select source, source_size,
         case when cap <= weight * level then cap
              else weight * (select arg_min(level, caps) from l where not cap <= weight * level) end as target
  from l),
g as (
  select *, floor(case when source_size > 0 then target / source_size else 0 end + 1e-12)::bigint as whole
  from t),
k as (
  select source, key, sum(size)::bigint as words from d group by source, key),
u as (
  select source, key, words, sum(words) over (partition by source order by key rows unbounded preceding)::bigint as upto from k),
e as (
  select u.source, u.key, greatest(target - whole * source_size, 0) as goal, words, upto
  from u join g on u.source is not distinct from g.source),
again as (
  select source, key from e
  where goal > 0 and (upto <= goal or upto - goal < goal - (upto - words)))
select d.doc_id, d.size, g.source_size, g.target,
       (d.size * (g.whole + case when again.key is not null then 1 else 0 end))::bigint as taken
from d join g on d.source is not distinct from g.source
left join again on d.source is not distinct from again.source and d.key = again.key
"""


def nearest_stop(cells: DataFrame, key: str) -> DataFrame:
    """Of ``cells`` (source, ``key``, words, goal), those of the source up to goal: (source, below, stop): the words of all
    whole cells before the one in which goal is reached, and that cell (null if all cells are below goal)."""
    run = Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = cells.withColumn("upto", F.sum("words").over(run))
    over = F.col("upto") > F.col("goal")
    return c.groupBy("source").agg(F.max(F.when(~over, F.col("upto"))).alias("below"), F.min(F.when(over, F.col(key))).alias("stop"))


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    return df.select(F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), order_key(F.col(id_col), seed).alias("key"))


def plan_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """A row for each source: source, source_size, target, whole (times every document is taken) and stop (the last key
    of the seeded order that is taken once more; null: none)."""
    known = staged(sized(df, id_col, text_col, source_col, seed), "document-sizes")
    sources = water_fill(known.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.withColumn("whole", F.floor(epochs + 1e-12).cast("bigint")).withColumn("goal", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    sources = staged(sources, "source-targets")
    small = F.broadcast if sources.count() <= BROADCAST_SOURCES else (lambda x: x)

    def cells(rows: DataFrame, digits: int) -> DataFrame:
        return rows.groupBy("source", F.substring("key", 1, digits).alias("cell")).agg(F.sum("size").alias("words"))

    def within(rows: DataFrame, stops: DataFrame, digits: int) -> DataFrame:
        s = stops.select(F.col("source").alias("s"), F.col("stop"))
        return rows.join(small(s), rows["source"].eqNullSafe(s["s"]) & (F.substring("key", 1, digits) == F.col("stop")), "left_semi")

    goals = sources.select(F.col("source").alias("s"), "goal")
    with_goal = lambda rows, g: rows.join(small(g), rows["source"].eqNullSafe(g["s"])).drop("s")
    first = nearest_stop(with_goal(cells(known, DIGITS), goals), "cell")
    left = first.join(goals, first["source"].eqNullSafe(goals["s"])).where("stop is not null").select("source", "stop", (F.col("goal") - F.coalesce("below", F.lit(0))).alias("goal"))
    left = staged(left, "source-stops")
    second = nearest_stop(with_goal(cells(within(known, left, DIGITS), 2 * DIGITS), left.select(F.col("source").alias("s"), "goal")), "cell")
    more = left.select(F.col("source").alias("s"), "goal")
    last = second.join(more, second["source"].eqNullSafe(more["s"])).where("stop is not null").select("source", "stop", (F.col("goal") - F.coalesce("below", F.lit(0))).alias("goal"))
    last = staged(last, "source-last-stops")
    ends = within(known, last, 2 * DIGITS).groupBy("source", "key").agg(F.sum("size").alias("words"))
    ends = with_goal(ends, last.select(F.col("source").alias("s"), "goal"))
    run = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.withColumn("upto", F.sum("words").over(run))
    # The key whose words bring the source nearest to its goal; the cell's start if even its first key goes too far.
    over, before = F.col("upto") > F.col("goal"), F.col("upto") - F.col("words")
    ends = ends.where(~over | (F.col("upto") - F.col("goal") < F.col("goal") - before))
    ends = ends.groupBy("source").agg(F.max("key").alias("stop"))
    l, e = last.select(F.col("source").alias("s"), F.col("stop").alias("cell")), ends.select(F.col("source").alias("t"), F.col("stop").alias("end"))
    stops = l.join(e, l["s"].eqNullSafe(e["t"]), "left").select("s", F.coalesce("end", "cell").alias("stop"))
    return sources.join(stops, sources["source"].eqNullSafe(stops["s"]), "left").select("source", "source_size", "target", "whole", F.when(F.col("goal") > 0, F.col("stop")).alias("stop"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> tuple[DataFrame, list[str]]:
    """``df`` with four more columns, and their names: source_size, target, whether its key is taken once more, and how often the mix takes
    the row (0: not at all)."""
    names = unused(["__source_size", "__target", "__again", "__times"], df.columns)
    size, target, more, times = names
    plan = staged(plan_mix(df, id_col, text_col, source_col, weights, share, max_epochs, seed), "mix-plan")
    small = F.broadcast if plan.count() <= BROADCAST_SOURCES else (lambda x: x)
    key, whole, stop = unused(["__s", "__whole", "__stop"], [*df.columns, *names])
    plan = plan.select(F.col("source").alias(key), F.col("source_size").alias(size), F.col("target").alias(target), F.col("whole").alias(whole), F.col("stop").alias(stop))
    out = df.join(small(plan), df[source_col].cast("string").eqNullSafe(plan[key]))
    out = out.withColumn(more, F.coalesce(order_key(df[id_col], seed) <= F.col(stop), F.lit(False)))
    return out.withColumn(times, F.col(whole) + F.col(more).cast("bigint")).drop(key, whole, stop), names


def mix_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken."""
    got, (source_size, target, _, times) = mixed(df, id_col, text_col, source_col)
    got = got.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"), F.col(source_size).alias("source_size"), F.col(target).alias("target"), F.col(times).alias("times"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed rows themselves, each as often as it is taken, with the columns of ``df``. Texts are not counted again."""
    got, (_, _, _, times) = mixed(df, id_col, text_col, source_col)
    (again,) = unused(["__n"], got.columns)
    return got.where(F.col(times) > 0).withColumn(again, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times)))).select(*df.columns)
