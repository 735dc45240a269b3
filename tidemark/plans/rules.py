"""Checks and rewrites between the parser and the plan: expansion, name resolution, kinds, folding, limits."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from tidemark.catalog import Catalog, Limits, TableDef, check_name
from tidemark.errors import (
    AmbiguousSymbol,
    InvalidArgument,
    InvalidArity,
    LimitExceeded,
    MissingPlaceholder,
    MixedQuery,
    TooManyParameters,
    UnknownFunction,
    UnknownPlaceholder,
    UnknownSymbol,
    UnsupportedFeature,
)
from tidemark.plans.evaluate import apply
from tidemark.plans.tree import AGGREGATES, ARITHMETIC, COMPARE, LOGIC, Between, Binary, Call, Expr, InList, IsTruth, Item, Literal, Name, Param, Select, Star, Unary, text, walk

#: Names of the placeholders for the bounds of the primary index.
MIN_BOUND, MAX_BOUND = "$MIN_BLOCK", "$MAX_BLOCK"


@dataclass(frozen=True)
class BoundNames:
    low: str = MIN_BOUND
    high: str = MAX_BOUND

    def __post_init__(self) -> None:
        if not (self.low.startswith("$") and self.high.startswith("$")):
            raise UnknownPlaceholder("names of bounds begin with $")


@dataclass(frozen=True)
class Output:
    """One column of the result: an expression, or an aggregate of one."""

    name: str
    expr: Expr
    aggregate: str | None = None


@dataclass(frozen=True)
class Checked:
    """A query with its names resolved to column names of the table, its forms expanded and its kinds checked."""

    table: TableDef
    outputs: tuple[Output, ...]
    where: Expr | None
    distinct: bool
    placeholders: tuple[str, ...]

    @property
    def aggregates(self) -> bool:
        return self.outputs[0].aggregate is not None


def expand(e: Expr) -> Expr:
    """IN, BETWEEN and IS in terms of comparisons. An empty list matches nothing."""
    match e:
        case InList(arg, items, negated):
            arg, parts = expand(arg), [expand(x) for x in items]
            if not parts:
                return Literal(int(negated), True)
            out: Expr | None = None
            for x in parts:
                one = Binary("<>" if negated else "=", arg, x)
                out = one if out is None else Binary("AND" if negated else "OR", out, one)
            return out
        case Between(arg, low, high, negated):
            arg, low, high = expand(arg), expand(low), expand(high)
            if negated:
                return Binary("OR", Binary("<", arg, low), Binary(">", arg, high))
            return Binary("AND", Binary(">=", arg, low), Binary("<=", arg, high))
        case IsTruth(arg, truth):
            return Binary("<>" if truth else "=", expand(arg), Literal(0))
        case Unary(op, arg):
            return Unary(op, expand(arg))
        case Binary(op, a, b):
            return Binary(op, expand(a), expand(b))
        case Call(name, args):
            return Call(name, tuple(map(expand, args)))
    return e


def is_truth(e: Expr) -> bool:
    """Whether the expression is a truth value rather than a number."""
    return isinstance(e, Literal) and e.truth or isinstance(e, Unary) and e.op == "NOT" or isinstance(e, Binary) and e.op in (*COMPARE, *LOGIC)


def check_kinds(e: Expr) -> None:
    """Operands of AND, OR, XOR and NOT are truth values or the literals 0 and 1."""

    def truth(x: Expr) -> None:
        if not is_truth(x) and not (isinstance(x, Literal) and x.value in (0, 1)):
            raise InvalidArgument(f"{text(x)} is no truth value")

    for x in walk(e):
        if isinstance(x, Binary) and x.op in LOGIC:
            truth(x.left)
            truth(x.right)
        elif isinstance(x, Unary):
            truth(x.arg)


class Scope:
    """The columns that a query's names can mean."""

    def __init__(self, table: TableDef, query: Select) -> None:
        for name in (query.alias, *query.renames):
            if name:
                check_name(name)
        if query.renames and len(query.renames) != len(table.columns):
            raise UnknownSymbol(f"{query.alias} names {len(query.renames)} of {len(table.columns)} columns")
        self.known_as = query.alias or query.table
        self.shown = list(query.renames or table.names)
        self.actual = dict(zip(self.shown, table.names, strict=True))
        if len(self.actual) != len(self.shown):
            raise AmbiguousSymbol(f"{query.alias} repeats a column name")

    def resolve(self, e: Expr) -> Expr:
        match e:
            case Name(column, table):
                if table is not None and table != self.known_as:
                    raise UnknownSymbol(f"{table}.{column}")
                if column not in self.actual:
                    raise UnknownSymbol(column)
                return Name(self.actual[column])
            case Unary(op, arg):
                return Unary(op, self.resolve(arg))
            case Binary(op, a, b):
                return Binary(op, self.resolve(a), self.resolve(b))
            case Call(name, args):
                return Call(name, tuple(map(self.resolve, args)))
        return e


def fold(e: Expr) -> Expr:
    """Constant parts as literals, unless computing them sets the error flag: then they stay, and the rows report it."""
    match e:
        case Unary(op, arg):
            arg = fold(arg)
            return Literal(int(not arg.value), True) if isinstance(arg, Literal) else Unary(op, arg)
        case Binary(op, a, b):
            a, b = fold(a), fold(b)
            if isinstance(a, Literal) and isinstance(b, Literal):
                value, flag = apply(op, a.value, b.value)
                if not flag:
                    return Literal(value, op not in ARITHMETIC)
            return Binary(op, a, b)
    return e


def bind(e: Expr, values: Mapping[str, int]) -> Expr:
    """The expression with values for its placeholders."""
    match e:
        case Param(name):
            if name not in values:
                raise UnknownPlaceholder(name)
            return Literal(int(values[name]))
        case Unary(op, arg):
            return Unary(op, bind(arg, values))
        case Binary(op, a, b):
            return Binary(op, bind(a, values), bind(b, values))
    return e


def operations(roots: list[Expr]) -> int:
    """Distinct operations of the expressions: equal ones count once."""
    return len({x for e in roots for x in walk(e) if isinstance(x, (Unary, Binary))})


def check_placeholders(roots: list[Expr], names: BoundNames, limits: Limits) -> tuple[str, ...]:
    """The placeholders in use: the bounds, and $1, $2 ... without gaps."""
    used = {x.name for e in roots for x in walk(e) if isinstance(x, Param)}
    numbered = sorted(int(x[1:]) for x in used - {names.low, names.high} if x[1:].isdigit())
    for x in used - {names.low, names.high}:
        if not x[1:].isdigit() or int(x[1:]) < 1 or x[1:] != str(int(x[1:])):
            raise UnknownPlaceholder(x)
    if limits.placeholders is not None and numbered and numbered[-1] > limits.placeholders:
        raise UnknownPlaceholder(f"${numbered[-1]}")
    for k in range(1, (numbered[-1] if numbered else 0) + 1):
        if k not in numbered:
            raise MissingPlaceholder(f"${k}")
    return tuple(sorted(used & {names.low, names.high}) + [f"${k}" for k in numbered])


def check_values(checked: Checked, values: Mapping[str, int], names: BoundNames) -> None:
    """There is a value for each placeholder in use, and none for others but the bounds."""
    for name in checked.placeholders:
        if name not in values:
            raise UnknownPlaceholder(f"no value for {name}")
    extra = set(values) - set(checked.placeholders) - {names.low, names.high}
    if extra:
        raise TooManyParameters(", ".join(sorted(extra)))
    for name, value in values.items():
        if not 0 <= int(value) < 1 << 256:
            raise InvalidArgument(f"{name} = {value} is no unsigned 256-bit integer")


def over(limit: int | None, found: int, what: str) -> None:
    if limit is not None and found > limit:
        raise LimitExceeded(f"{found} {what}; the limit is {limit}")


def check(query: Select, catalog: Catalog, names: BoundNames = BoundNames()) -> Checked:
    """Resolves and checks a parsed query."""
    table, limits = catalog.get(query.table), catalog.limits
    over(limits.columns, len(table.columns), "columns")
    scope = Scope(table, query)
    outputs: list[Output] = []
    for n, item in enumerate(query.items):
        if isinstance(item.expr, Star):
            outputs += [Output(shown, Name(actual)) for shown, actual in scope.actual.items()]
            continue
        outputs.append(output(item, n, scope))
    kinds = {o.aggregate is not None for o in outputs}
    if len(kinds) > 1:
        raise MixedQuery("aggregates and row values in one query")
    where = None
    if query.where is not None:
        if any(isinstance(x, Call) for x in walk(query.where)):
            raise InvalidArgument("a function in WHERE")
        where = scope.resolve(expand(query.where))
        check_kinds(where)
        if not is_truth(where) and not (isinstance(where, Literal) and where.value in (0, 1)):
            raise InvalidArgument(f"{text(where)} is no truth value")
    seen: dict[str, int] = {}
    unique = []
    for o in outputs:  # repeated names get a number, so that every result column can be addressed
        seen[o.name] = seen.get(o.name, 0) + 1
        unique.append(o if seen[o.name] == 1 else replace(o, name=f"{o.name}_{seen[o.name]}"))
    roots = [o.expr for o in unique] + ([where] if where is not None else [])
    used = check_placeholders(roots, names, limits)
    over(limits.items, len(unique), "items")
    over(limits.predicate_ops, operations([where] if where is not None else []), "operations in WHERE")
    over(limits.result_ops, operations([o.expr for o in unique]), "operations in SELECT")
    return Checked(table, tuple(unique), where, query.distinct, used)


def output(item: Item, n: int, scope: Scope) -> Output:
    expr = expand(item.expr)
    if item.alias:
        check_name(item.alias)
    if isinstance(expr, Call):
        if expr.name not in AGGREGATES:
            raise UnknownFunction(expr.name)
        if len(expr.args) != 1:
            raise InvalidArity(f"{expr.name} takes one argument, found {len(expr.args)}")
        arg = scope.resolve(expr.args[0])
        if any(isinstance(x, Call) for x in walk(arg)):
            raise InvalidArgument(f"an aggregate in {expr.name}")
        if isinstance(arg, (Literal, Param)):
            raise InvalidArgument(f"{expr.name} of a constant")
        check_kinds(arg)
        shown = expr.args[0].column if isinstance(expr.args[0], Name) else f"{n + 1}"
        return Output(item.alias or f"{expr.name.lower()}_{shown}", arg, expr.name)
    if any(isinstance(x, Call) for x in walk(expr)):
        raise UnsupportedFeature("an aggregate inside an expression")
    if isinstance(expr, (Literal, Param)):
        raise InvalidArgument("a constant in SELECT")
    check_kinds(expr)
    name = item.alias or (expr.column if isinstance(expr, Name) else f"expr_{n + 1}")
    return Output(name, scope.resolve(expr))
