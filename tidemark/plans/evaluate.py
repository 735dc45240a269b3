"""Unsigned 256-bit arithmetic on Python integers: the rule for constants, and the check of every other evaluation.

Every operation returns a value and whether it left the domain: sums, differences and products wrap modulo 2^256,
x / 0 is 0 and x % 0 is x, each with the flag. AND and OR do not short-circuit: both sides' flags count.
"""

from __future__ import annotations

from collections.abc import Mapping

from tidemark.plans.tree import Binary, Expr, Literal, Name, Param, Unary

TOP = 1 << 256


def apply(op: str, a: int, b: int) -> tuple[int, bool]:
    match op:
        case "+":
            return (a + b) % TOP, a + b >= TOP
        case "-":
            return (a - b) % TOP, a < b
        case "*":
            return a * b % TOP, a * b >= TOP
        case "/":
            return (a // b if b else 0), not b
        case "%":
            return (a % b if b else a), not b
        case "=":
            return int(a == b), False
        case "<>":
            return int(a != b), False
        case "<":
            return int(a < b), False
        case "<=":
            return int(a <= b), False
        case ">":
            return int(a > b), False
        case ">=":
            return int(a >= b), False
        case "AND":
            return int(a and b), False
        case "OR":
            return int(a or b), False
        case "XOR":
            return int(bool(a) != bool(b)), False
    raise ValueError(op)


def evaluate(e: Expr, row: Mapping[str, int], params: Mapping[str, int] | None = None) -> tuple[int, bool]:
    """Value of an expanded expression for one row, and whether any of its operations set the flag."""
    match e:
        case Literal(value, _):
            return value, False
        case Param(name):
            return (params or {})[name], False
        case Name(column, _):
            return row[column], False
        case Unary("NOT", x):
            value, flag = evaluate(x, row, params)
            return int(not value), flag
        case Binary(op, left, right):
            a, f = evaluate(left, row, params)
            b, g = evaluate(right, row, params)
            value, flag = apply(op, a, b)
            return value, f or g or flag
    raise TypeError(e)


def aggregate(name: str, values: list[int]) -> tuple[int | None, bool]:
    """An aggregate of the matching rows' values, and whether the sum wrapped. No rows: no result."""
    if not values:
        return None, False
    total = sum(values)
    match name:
        case "SUM":
            return total % TOP, total >= TOP
        case "AVG":
            return total % TOP // len(values), total >= TOP
        case "COUNT":
            return len(values), False
        case "MIN":
            return min(values), False
        case "MAX":
            return max(values), False
    raise ValueError(name)
