"""What a WHERE clause says of the indexes: bounds of the primary, a range of the secondary, and the rest dropped."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from tidemark.errors import MissingPrimaryBounds
from tidemark.plans.evaluate import evaluate
from tidemark.plans.rules import BoundNames, Checked
from tidemark.plans.tree import Binary, Expr, Literal, Name, Param, conjuncts, text, walk

_TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}


def about(column: str, e: Expr) -> tuple[str, Expr] | None:
    """(operator, other side) of a comparison of the column, whichever side it is on."""
    if isinstance(e, Binary) and e.op in _TURNED:
        if e.left == Name(column):
            return e.op, e.right
        if e.right == Name(column):
            return _TURNED[e.op], e.left
    return None


def check_primary(checked: Checked, names: BoundNames) -> None:
    """A WHERE clause holds both inclusive bounds, by their placeholders, in its conjunction. Without WHERE none are needed."""
    if checked.where is None:
        return
    found = [about(checked.table.primary.name, e) for e in conjuncts(checked.where)]
    if (">=", Param(names.low)) not in found or ("<=", Param(names.high)) not in found:
        raise MissingPrimaryBounds(f"{checked.table.primary.name} needs to be between {names.low} and {names.high}")


def _static(e: Expr) -> bool:
    return not any(isinstance(x, Name) for x in walk(e))


def _depth(e: Expr) -> int:
    return 1 + max(_depth(e.left), _depth(e.right)) if isinstance(e, Binary) else 1 if not isinstance(e, (Literal, Param, Name)) else 0


@dataclass(frozen=True)
class SecondaryRange:
    """Inclusive ends, None where open. ``flag``: computing an end left the domain."""

    low: int | None = None
    high: int | None = None
    flag: bool = False

    @property
    def empty(self) -> bool:
        return self.low is not None and self.high is not None and self.low > self.high


def secondary_range(checked: Checked, values: Mapping[str, int]) -> SecondaryRange:
    """The range that AND-joined comparisons of the secondary index with constants (of at most one operation) allow.

    It is only narrowed where it can be, so all rows that match WHERE are in it.
    """
    if checked.table.secondary is None:
        return SecondaryRange()
    low: int | None = None
    high: int | None = None
    flag = False
    for e in conjuncts(checked.where):
        got = about(checked.table.secondary.name, e)
        if got is None or not _static(got[1]) or _depth(got[1]) > 1:
            continue
        op, side = got
        value, wrapped = evaluate(side, {}, values)
        flag |= wrapped
        lows = {">": value + 1, ">=": value, "=": value}
        highs = {"<": value - 1, "<=": value, "=": value}
        if op in lows:
            low = lows[op] if low is None else max(low, lows[op])
        if op in highs:
            high = highs[op] if high is None else min(high, highs[op])
    return SecondaryRange(low, high, flag)


def isolate(checked: Checked, names: BoundNames, low: int | None = None, high: int | None = None) -> Expr | None:
    """WHERE with the primary bounds and the given ends of the secondary range alone: a predicate for key queries."""
    primary = Name(checked.table.primary.name, checked.table.name)
    parts: list[Expr] = [] if checked.where is None else [Binary(">=", primary, Param(names.low)), Binary("<=", primary, Param(names.high))]
    if checked.table.secondary is not None:
        secondary = Name(checked.table.secondary.name, checked.table.name)
        parts += [Binary(">=", secondary, Literal(low))] * (low is not None) + [Binary("<=", secondary, Literal(high))] * (high is not None)
    out: Expr | None = None
    for p in parts:
        out = p if out is None else Binary("AND", out, p)
    return out


def isolated_text(checked: Checked, names: BoundNames, low: int | None = None, high: int | None = None) -> str:
    where = isolate(checked, names, low, high)
    return f"SELECT * FROM {checked.table.name}" + (f" WHERE {text(where)}" if where is not None else "")
