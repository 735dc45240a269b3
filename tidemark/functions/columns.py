"""Expressions of the dialect as Columns.

Native form. Every subexpression has bounds on its values from the bounds of its columns; below 2^63 it is a BIGINT, below
10^38 a DECIMAL(38,0), and above that the query needs the wide form. A difference may also be negative; it is null
then, and if such a value is used the query stops with WIDE_MARK and is run again in the wide form.

Wide form. Numbers are 32-byte binaries (see ``u256``).

In both forms an expression carries a second Column, the error flag of all its operations. It is
computed for every row, as AND and OR do not short-circuit.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import NeedsWideArithmetic
from tidemark.functions import u256
from tidemark.plans.tree import COMPARE, LOGIC, Binary, Expr, Literal, Name, Unary

LONG, DECIMAL = 1 << 63, 10**38
WIDE_MARK = "TIDEMARK_NEEDS_WIDE"


@dataclass(frozen=True)
class Value:
    """A compiled expression: its Column, error flag (None: never set), and greatest value if it is a native number."""

    column: Column
    flag: Column | None = None
    most: int | None = None
    truth: bool = False
    partial: bool = False  # null where the native form has no value


def either(*flags: Column | None) -> Column | None:
    out: Column | None = None
    for f in flags:
        if f is not None:
            out = f if out is None else out | f
    return out


def _stop(kind: str) -> Column:
    return F.raise_error(F.lit(WIDE_MARK)).cast(kind)


def _kind(most: int) -> str:
    return "bigint" if most < LONG else "decimal(38,0)"


def whole(v: Value) -> Column:
    """The value where the native form has it; elsewhere the query stops."""
    return F.coalesce(v.column, _stop("boolean" if v.truth else _kind(v.most or 0))) if v.partial else v.column


def compare(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def logic(op: str, a: Column, b: Column) -> Column:
    return {"AND": a & b, "OR": a | b, "XOR": a != b}[op]


class Native:
    """Compiles for BIGINT and DECIMAL columns; ``most``: greatest value of each column."""

    def __init__(self, columns: Mapping[str, Column], most: Mapping[str, int]) -> None:
        self.columns, self.most = columns, most

    def truth(self, e: Expr) -> Value:
        if isinstance(e, Literal):
            return Value(F.lit(bool(e.value)), truth=True)
        return self.compile(e)

    def compile(self, e: Expr) -> Value:
        match e:
            case Literal(value, truth):
                if truth:
                    return Value(F.lit(bool(value)), truth=True)
                if value >= DECIMAL:
                    raise NeedsWideArithmetic(str(value))
                return Value(F.lit(str(value)).cast(_kind(value)) if value >= LONG else F.lit(value).cast("bigint"), most=value)
            case Name(column, _):
                return Value(self.columns[column], most=self.most.get(column, LONG - 1))
            case Unary("NOT", x):
                v = self.truth(x)
                return Value(~v.column, v.flag, truth=True, partial=v.partial)
            case Binary(op, left, right) if op in LOGIC:
                a, b = self.truth(left), self.truth(right)
                return Value(logic(op, whole(a), whole(b)), either(a.flag, b.flag), truth=True)
            case Binary(op, left, right):
                a, b = self.number(self.compile(left)), self.number(self.compile(right))
                flag, partial = either(a.flag, b.flag), a.partial or b.partial
                if op in COMPARE:
                    return Value(compare(op, whole(a), whole(b)), flag, truth=True)
                return self.arithmetic(op, a, b, flag, partial)
        raise TypeError(e)

    def number(self, v: Value) -> Value:
        return Value(whole(v).cast("bigint"), v.flag, 1) if v.truth else v

    def arithmetic(self, op: str, a: Value, b: Value, flag: Column | None, partial: bool) -> Value:
        most = {"+": a.most + b.most, "-": a.most, "*": a.most * b.most, "/": a.most, "%": max(a.most, b.most)}[op]
        if most >= DECIMAL:
            raise NeedsWideArithmetic(op)
        kind = _kind(max(most, a.most, b.most))
        x, y = a.column.cast(kind), b.column.cast(kind)
        if op == "+":
            return Value((x + y).cast(_kind(most)), flag, most, partial=partial)
        if op == "*":
            return Value((x * y).cast(_kind(most)), flag, most, partial=partial)
        if op == "-":
            low = x < y
            return Value(F.when(~low, x - y).cast(_kind(most)), either(flag, F.coalesce(low, F.lit(False))), most, partial=True)
        none = y == 0
        safe = F.when(none, F.lit(1).cast(kind)).otherwise(y)
        rest = x % safe
        if op == "%":
            got = F.when(none, x).otherwise(rest)
        elif kind == "bigint":
            got = F.when(none, F.lit(0).cast(kind)).otherwise(F.call_function("div", x, safe))
        else:
            got = F.when(none, F.lit(0).cast(kind)).otherwise(((x - rest) / safe).cast(kind))
        return Value(got.cast(_kind(most)), either(flag, F.coalesce(none, F.lit(False))), most, partial=partial)


class Wide:
    """Compiles for 256-bit integers; the columns are native or 32-byte binaries (``binary`` names the latter)."""

    def __init__(self, columns: Mapping[str, Column], binary: frozenset[str] = frozenset()) -> None:
        self.columns, self.binary = columns, binary

    def truth(self, e: Expr) -> Value:
        return Value(F.lit(bool(e.value)), truth=True) if isinstance(e, Literal) else self.compile(e)

    def compile(self, e: Expr) -> Value:
        match e:
            case Literal(value, truth):
                return Value(F.lit(bool(value)), truth=True) if truth else Value(u256.literal(value))
            case Name(column, _):
                c = self.columns[column]
                return Value(c if column in self.binary else u256.widen(c))
            case Unary("NOT", x):
                v = self.truth(x)
                return Value(~v.column, v.flag, truth=True)
            case Binary(op, left, right) if op in LOGIC:
                a, b = self.truth(left), self.truth(right)
                return Value(logic(op, a.column, b.column), either(a.flag, b.flag), truth=True)
            case Binary(op, left, right):
                a, b = self.number(self.compile(left)), self.number(self.compile(right))
                flag = either(a.flag, b.flag)
                if op in COMPARE:
                    return Value(compare(op, a.column, b.column), flag, truth=True)
                value, own = u256.arithmetic(op, a.column, b.column)
                return Value(value, either(flag, own))
        raise TypeError(e)

    def number(self, v: Value) -> Value:
        return Value(u256.widen(v.column.cast("bigint")), v.flag) if v.truth else v
