"""Expressions and queries as plain values: equal subtrees compare and hash as equal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass


class Expr:
    """An expression of the dialect."""


@dataclass(frozen=True)
class Name(Expr):
    column: str
    table: str | None = None


@dataclass(frozen=True)
class Literal(Expr):
    value: int
    truth: bool = False  # written as TRUE or FALSE


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    arg: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class InList(Expr):
    arg: Expr
    items: tuple[Expr, ...]
    negated: bool = False


@dataclass(frozen=True)
class Between(Expr):
    arg: Expr
    low: Expr
    high: Expr
    negated: bool = False


@dataclass(frozen=True)
class IsTruth(Expr):
    arg: Expr
    truth: bool


@dataclass(frozen=True)
class Star(Expr):
    pass


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: str
    alias: str | None = None
    renames: tuple[str, ...] = ()
    where: Expr | None = None
    distinct: bool = False


COMPARE = ("=", "<>", "<", "<=", ">", ">=")
LOGIC = ("AND", "OR", "XOR")
ARITHMETIC = ("+", "-", "*", "/", "%")
AGGREGATES = ("SUM", "COUNT", "AVG", "MIN", "MAX")


def children(e: Expr) -> tuple[Expr, ...]:
    match e:
        case Unary(_, x):
            return (x,)
        case Binary(_, a, b):
            return (a, b)
        case Call(_, args):
            return args
        case InList(x, items):
            return (x, *items)
        case Between(x, a, b):
            return (x, a, b)
        case IsTruth(x, _):
            return (x,)
    return ()


def walk(e: Expr) -> Iterator[Expr]:
    """The expression and all below it, from the top."""
    yield e
    for x in children(e):
        yield from walk(x)


def conjuncts(e: Expr | None) -> list[Expr]:
    """Parts of ``e`` that AND joins."""
    if isinstance(e, Binary) and e.op == "AND":
        return conjuncts(e.left) + conjuncts(e.right)
    return [] if e is None else [e]


def text(e: Expr) -> str:
    """The expression as SQL, with parentheses around nested operations."""

    def inner(x: Expr) -> str:
        return f"({text(x)})" if isinstance(x, (Binary, Between, InList, IsTruth)) else text(x)

    match e:
        case Name(column, table):
            return f"{table}.{column}" if table else column
        case Literal(value, truth):
            return str(bool(value)).upper() if truth else str(value)
        case Param(name):
            return name
        case Unary(op, x):
            return f"{op} {inner(x)}"
        case Binary(op, a, b):
            keep = lambda x: text(x) if op == "AND" and isinstance(x, Binary) and x.op in (*COMPARE, "AND") else inner(x)
            return f"{keep(a)} {op} {keep(b)}"
        case Call(name, args):
            return f"{name}({', '.join(map(text, args))})"
        case InList(x, items, negated):
            return f"{inner(x)} {'NOT ' * negated}IN ({', '.join(map(text, items))})"
        case Between(x, a, b, negated):
            return f"{inner(x)} {'NOT ' * negated}BETWEEN {inner(a)} AND {inner(b)}"
        case IsTruth(x, truth):
            return f"{inner(x)} IS {str(truth).upper()}"
        case Star():
            return "*"
    raise TypeError(e)
