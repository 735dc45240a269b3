"""Queries of the dialect over registered tables.

A table is either a DataFrame with one row for each (row, epoch), or a versioned DataFrame (``valid_from`` and
``valid_until`` in dense incremental epochs) with a mapper to user epochs. A query is parsed, checked, bound to an inclusive range
of user epochs, and declared as one DataFrame; filters on the indexes stand alone, so that they reach the scan.

Over a versioned table an aggregate that does not look at the epoch needs no expansion: each version counts as many times as it has
live epochs in range. All other queries join versions with the mapper's epochs, which are few and broadcast if their
number is small.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import Catalog, TableDef
from tidemark.errors import InvalidArgument, LimitExceeded, NeedsWideArithmetic
from tidemark.functions import u256
from tidemark.functions.columns import LONG, WIDE_MARK, Native, Value, Wide, either, whole
from tidemark.plans import bounds, rules
from tidemark.plans.parser import parse
from tidemark.plans.rules import BoundNames, Checked, Output
from tidemark.plans.tree import Binary, Expr, Name, Param, walk


@dataclass(frozen=True)
class Source:
    """A registered table. ``order``: columns that order its rows within an epoch beyond the secondary index. ``most``: greatest
    values of columns, where they are known to be less than 2^63 - 1. ``binary``: columns of 32-byte integers."""

    table: TableDef
    frame: DataFrame
    mapper: DataFrame | None = None
    order: tuple[str, ...] = ()
    most: Mapping[str, int] = field(default_factory=dict)
    binary: frozenset[str] = frozenset()


@dataclass
class QueryResult:
    """``frame``: the result's rows, sorted by their values, the last output first; LIMIT and OFFSET have chosen them before that.
    ``error()``: whether any operation on any processed row, or a sum, left the domain. ``matched()``: how many rows match WHERE, before DISTINCT,
    LIMIT and OFFSET. ``checks``: both, as one row."""

    frame: DataFrame
    checks: DataFrame
    checked: Checked
    wide: bool

    def matched(self) -> int:
        return int(self.checks.select("matched").first()[0])

    def error(self) -> bool:
        return bool(self.checks.select("error").first()[0])

    def rows(self) -> list[dict[str, int]]:
        """The result's rows as Python integers, for results that LIMIT bounds or that are known to be small; ``frame`` serves all others."""
        out = []
        for r in self.frame.collect():
            out.append({k: u256.decode(bytes(v)) if isinstance(v, (bytes, bytearray)) else None if v is None else int(v) for k, v in r.asDict().items()})
        return out


@dataclass(frozen=True)
class Answer:
    """A result that has run: its rows (``frame`` can't fail any more for want of width), how many they are, how many rows matched WHERE, and the
    error flag."""

    frame: DataFrame
    n_rows: int
    matched: int
    error: bool
    wide: bool


def leaves_native(e: PySparkException) -> bool:
    """Whether a query failed since a value does not fit the native types."""
    return any(x in str(e) for x in (WIDE_MARK, "ARITHMETIC_OVERFLOW", "NUMERIC_VALUE_OUT_OF_RANGE"))


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, names: BoundNames = BoundNames()) -> None:
        self.spark, self.catalog, self.names = spark, catalog or Catalog(), names
        self.sources: dict[str, Source] = {}

    def register(self, table: TableDef, frame: DataFrame, mapper: DataFrame | None = None, **more) -> Source:
        self.catalog.add(table)
        self.sources[table.name] = Source(table, frame, mapper, **more)
        return self.sources[table.name]

    # -- checking
    def prepare(self, text: str) -> Checked:
        """Parses and checks a query without values for its placeholders."""
        checked = rules.check(parse(text), self.catalog, self.names)
        bounds.check_primary(checked, self.names)
        return checked

    def query(self, text: str, low: int, high: int, params: Mapping[str, int] | None = None, limit: int | None = None, offset: int = 0, wide: bool = False) -> QueryResult:
        """The query's result over user epochs low to high. ``params`` has the values of $1, $2 ..."""
        checked = self.prepare(text)
        values = {**(params or {}), self.names.low: low, self.names.high: high}
        rules.check_values(checked, values, self.names)
        most = self.catalog.limits.outputs
        if limit is not None and (limit < 0 or most is not None and limit > most):
            raise LimitExceeded(f"LIMIT {limit}; the limit is {most}")
        if offset < 0:
            raise InvalidArgument(f"OFFSET {offset}")
        plan = Plan(self.sources[checked.table.name], checked, values, self.names, most if limit is None else limit, offset)
        if not wide:
            try:
                return plan.result(False)
            except NeedsWideArithmetic:
                pass
        return plan.result(True)

    def rows(self, text: str, low: int, high: int, params: Mapping[str, int] | None = None, limit: int | None = None, offset: int = 0) -> tuple[list[dict[str, int]], bool]:
        """Rows and error flag, in the wide form if a value leaves the native types."""
        got = self.query(text, low, high, params, limit, offset)
        try:
            return got.rows(), got.error()
        except PySparkException as e:
            if got.wide or not leaves_native(e):
                raise
        got = self.query(text, low, high, params, limit, offset, wide=True)
        return got.rows(), got.error()

    def answer(self, text: str, low: int, high: int, params: Mapping[str, int] | None = None, limit: int | None = None, offset: int = 0) -> Answer:
        """Rows, their number, the matched rows and the error flag in one object, in the wide form if a value leaves the native types. Nothing but
        numbers reaches the driver."""
        got = self.query(text, low, high, params, limit, offset)
        try:
            return self._run(got)
        except PySparkException as e:
            if got.wide or not leaves_native(e):
                raise
        return self._run(self.query(text, low, high, params, limit, offset, wide=True))

    @staticmethod
    def _run(got: QueryResult) -> Answer:
        # The hash makes every value be computed, so that none fails later.
        n = got.frame.agg(F.count("*"), F.expr("bit_xor(xxhash64(*))")).first()[0]
        checks = got.checks.first()
        return Answer(got.frame, int(n), int(checks["matched"]), bool(checks["error"]), got.wide)


@dataclass
class Plan:
    source: Source
    checked: Checked
    values: Mapping[str, int]
    names: BoundNames
    limit: int | None
    offset: int

    @property
    def primary(self) -> str:
        return self.checked.table.primary.name

    @cached_property
    def where(self) -> Expr | None:
        return None if self.checked.where is None else rules.fold(rules.bind(self.checked.where, self.values))

    @cached_property
    def outputs(self) -> list[Output]:
        return [replace(o, expr=rules.fold(rules.bind(o.expr, self.values))) for o in self.checked.outputs]

    @cached_property
    def range(self) -> bounds.SecondaryRange:
        return bounds.secondary_range(self.checked, self.values)

    def uses_epoch(self) -> bool:
        """Whether outputs, or the predicate beyond the bounds, look at the primary column."""
        if any(Name(self.primary) in walk(o.expr) for o in self.outputs):
            return True
        rest = [e for e in bounds.conjuncts(self.checked.where) if not self._is_bound(e)]
        return any(Name(self.primary) in walk(e) for e in rest)

    def _is_bound(self, e: Expr) -> bool:
        found = bounds.about(self.primary, e)
        return found in ((">=", Param(self.names.low)), ("<=", Param(self.names.high)))

    def rest(self) -> Expr | None:
        """WHERE without the primary bounds, which the scan applies."""
        out: Expr | None = None
        for e in bounds.conjuncts(self.checked.where):
            if not self._is_bound(e):
                out = e if out is None else Binary("AND", out, e)
        return None if out is None else rules.fold(rules.bind(out, self.values))

    # -- scans
    def indexed(self, frame: DataFrame) -> DataFrame:
        """The rows inside the secondary range."""
        s = self.checked.table.secondary
        if s is None:
            return frame
        c, low, high = F.col(s.name), self.range.low, self.range.high
        if self.range.empty or high is not None and high < 0:
            return frame.where(F.lit(False))
        if s.name in self.source.binary:
            frame = frame if low is None else frame.where(c >= u256.literal(low))
            return frame if high is None else frame.where(c <= u256.literal(high))
        if low is not None:
            frame = frame.where(c >= F.lit(low)) if low < LONG else frame.where(F.lit(False))
        if high is not None and high < LONG:
            frame = frame.where(c <= F.lit(high))
        return frame

    def epochs(self) -> tuple[int, int]:
        clip = lambda x: max(min(int(x), LONG - 1), -LONG)
        return clip(self.values[self.names.low]), clip(self.values[self.names.high])

    def scan(self, weighted: bool) -> DataFrame:
        """The processed rows, with the column __n, how many times a row counts, if ``weighted``."""
        from tidemark.operators import scan

        low, high = self.epochs()
        frame = self.indexed(self.source.frame)
        if self.source.mapper is None:
            c = F.col(self.primary)
            out = frame.where((c >= F.lit(low)) & (c <= F.lit(high)))
            return out.withColumn("__n", F.lit(1).cast("bigint")) if weighted else out
        if weighted:
            return scan.weighted(frame, self.source.mapper, low, high, "__n")
        return scan.epoch_range(frame, self.source.mapper, low, high, self.primary)

    # -- results
    def compiler(self, frame: DataFrame, wide: bool) -> Native | Wide:
        columns = {c: F.col(c) for c in frame.columns}
        if wide:
            return Wide(columns, self.source.binary)
        if self.source.binary & {x.column for e in [*(o.expr for o in self.outputs), *([self.where] if self.where is not None else [])] for x in walk(e) if isinstance(x, Name)}:
            raise NeedsWideArithmetic("256-bit columns")
        return Native(columns, self.source.most)

    def result(self, wide: bool) -> QueryResult:
        weighted = self.checked.aggregates and self.source.mapper is not None and not self.uses_epoch()
        frame = self.scan(weighted)
        compiler = self.compiler(frame, wide)
        rest = self.rest()
        keep = Value(F.lit(True), truth=True) if rest is None else compiler.truth(rest)
        values = [compiler.compile(o.expr) for o in self.outputs]
        flag = either(keep.flag, *[v.flag for v in values], F.lit(True) if self.range.flag else None)
        if self.checked.aggregates:
            return self.aggregated(frame, keep, values, flag, wide, weighted)
        return self.tabular(frame, keep, values, flag, wide)

    def tabular(self, frame: DataFrame, keep: Value, values: list[Value], flag: Column | None, wide: bool) -> QueryResult:
        shown = [whole(v) if not v.truth else whole(v).cast("bigint") for v in values]
        if wide:
            shown = [u256.widen(v.column.cast("bigint")) if v.truth else v.column for v in values]
        names = [o.name for o in self.outputs]
        secondary = self.checked.table.secondary
        order = list(dict.fromkeys([self.primary, *([secondary.name] if secondary else []), *self.source.order]))
        order = [c for c in order if c in frame.columns]
        rows = frame.where(whole(keep))
        if self.checked.distinct:
            rows = rows.select(*[c.alias(n) for c, n in zip(shown, names, strict=True)]).distinct()
            keys = [F.col(f"`{n}`") for n in reversed(names)]
        else:
            rows = rows.select(*[c.alias(n) for c, n in zip(shown, names, strict=True)], *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)])
            keys = [F.col(f"__o{k}") for k in range(len(order))] + [F.col(f"`{n}`") for n in reversed(names)]
        if self.limit is not None or self.offset:
            # The order in which rows are enumerated decides which of them LIMIT and OFFSET keep.
            rows = rows.orderBy(*keys)
            rows = rows.offset(self.offset) if self.offset else rows
            rows = rows.limit(self.limit) if self.limit is not None else rows
        shown_names = [F.col(f"`{n}`") for n in names]
        rows = rows.select(*shown_names).orderBy(*reversed(shown_names))
        any_flag = F.coalesce(F.bool_or(flag if flag is not None else F.lit(False)), F.lit(False))
        checks = frame.agg(any_flag.alias("error"), F.count_if(whole(keep)).alias("matched"))
        return QueryResult(rows, checks, self.checked, wide)

    def aggregated(self, frame: DataFrame, keep: Value, values: list[Value], flag: Column | None, wide: bool, weighted: bool) -> QueryResult:
        match = whole(keep)
        if flag is None:
            # No operation can set the flag, so rows that don't match need not be looked at.
            frame, match = frame.where(match), None
        matching = lambda c: c if match is None else F.when(match, c)
        n = F.col("__n") if weighted else F.lit(1).cast("bigint")
        aggs: list[Column] = [F.coalesce(F.sum(matching(n)), F.lit(0).cast("bigint")).alias("__count"), F.coalesce(F.bool_or(flag if flag is not None else F.lit(False)), F.lit(False)).alias("__flag")]
        for k, (o, v) in enumerate(zip(self.outputs, values, strict=True)):
            if wide:
                c = u256.widen(v.column.cast("bigint")) if v.truth else v.column
                if o.aggregate in ("SUM", "AVG"):
                    if weighted:
                        c = u256.arithmetic("*", c, u256.widen(n))[0]
                    aggs += [s.alias(f"__{k}_{j}") for j, s in enumerate(u256.limb_sums(matching(c)))]
                elif o.aggregate in ("MIN", "MAX"):
                    aggs.append((F.min if o.aggregate == "MIN" else F.max)(matching(c)).alias(f"__{k}"))
                continue
            c = whole(v).cast("bigint") if v.truth else whole(v)
            if o.aggregate in ("SUM", "AVG"):
                if (v.most or 1) >= 10**28:
                    raise NeedsWideArithmetic("sums of large numbers")
                aggs.append(F.sum(matching(c.cast("decimal(28,0)") * n.cast("decimal(10,0)") if weighted else c.cast("decimal(28,0)"))).alias(f"__{k}"))
            elif o.aggregate in ("MIN", "MAX"):
                aggs.append((F.min if o.aggregate == "MIN" else F.max)(matching(c)).alias(f"__{k}"))
        one = frame.agg(*aggs)
        shown, wraps = [], [F.col("__flag")]
        for k, o in enumerate(self.outputs):
            if o.aggregate == "COUNT":
                c = u256.widen(F.col("__count")) if wide else F.col("__count")
            elif wide and o.aggregate in ("SUM", "AVG"):
                total = u256.carry(F.array(*[F.col(f"__{k}_{j}") for j in range(8)]))
                wraps.append(F.coalesce(total["err"], F.lit(False)))
                c = u256.divide(total["v"], F.col("__count")) if o.aggregate == "AVG" else total["v"]
            elif o.aggregate == "AVG":
                total, count = F.col(f"__{k}"), F.col("__count")
                c = F.when(count > 0, ((total - total % count) / F.when(count > 0, count)).cast("decimal(38,0)"))
            else:
                c = F.col(f"__{k}")
            shown.append(c.alias(o.name))
        checks = one.select(either(*wraps).alias("error"), F.col("__count").alias("matched"))
        rows = one.where("__count > 0").select(*shown)  # no matching rows: no result row
        if self.offset:
            rows = rows.where(F.lit(False))
        if self.limit is not None:
            rows = rows.limit(self.limit)
        return QueryResult(rows, checks, self.checked, wide)


def isolated(engine: Engine, text: str, low: int | None = None, high: int | None = None) -> str:
    """The query that keeps a query's index bounds alone, as text."""
    checked = rules.check(parse(text), engine.catalog, engine.names)
    return bounds.isolated_text(checked, engine.names, low, high)

