"""Query text to a :class:`Select`.

The grammar knows more than the dialect allows, so that a refused clause is named in its error. Precedence, from loose to
tight: OR, AND, XOR, NOT, comparisons with IS, IN, BETWEEN and LIKE, bitwise operators, + and -, * / and %, signs.
"""

from __future__ import annotations

import re

from tidemark.errors import (
    InvalidArity,
    NestedSelect,
    NotASelect,
    ReservedIdentifier,
    SetOperation,
    SyntaxProblem,
    UnsupportedFeature,
    UnsupportedJoin,
    UnsupportedLiteral,
    UnsupportedOperator,
    UseInvocationParameter,
)
from tidemark.plans.tree import Between, Binary, Call, Expr, InList, IsTruth, Item, Literal, Name, Param, Select, Star, Unary

TOP = 1 << 256

_TOKEN = re.compile(
    r"""\s+|--[^\n]*|/\*.*?\*/
    |(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)
    |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
    |"(?P<quoted>[^"]+)"
    |(?P<string>'(?:[^']|'')*')
    |(?P<param>\$[A-Za-z0-9_]+)
    |(?P<mark>->>|->|\|\||::|==|<=|>=|<>|!=|<=>|[-+*/%=<>(),.;&|^\[\]{}?:!~@\#])""",
    re.X | re.S,
)
_PREFIX = {"0x": 16, "0b": 2, "0o": 8}
#: Words that end an expression or an alias.
_RESERVED = frozenset("SELECT FROM WHERE GROUP HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT AND OR XOR NOT IN BETWEEN IS LIKE ILIKE RLIKE SIMILAR AS ON JOIN INNER LEFT RIGHT FULL CROSS NATURAL WINDOW QUALIFY FETCH FOR TOP LATERAL SORT CLUSTER DISTRIBUTE PREWHERE USING".split())
_AFTER_FROM = {
    "GROUP": "GROUP BY",
    "HAVING": "HAVING",
    "ORDER": "ORDER BY",
    "WINDOW": "WINDOW",
    "QUALIFY": "QUALIFY",
    "FETCH": "FETCH",
    "FOR": "FOR",
    "SORT": "SORT BY",
    "CLUSTER": "CLUSTER BY",
    "DISTRIBUTE": "DISTRIBUTE BY",
    "PREWHERE": "PREWHERE",
    "LATERAL": "LATERAL VIEW",
}


def parse_integer(text: str) -> int:
    """An unsigned 256-bit integer from decimal digits, or from digits after 0x, 0b or 0o in either case."""
    low = text.lower()
    base = _PREFIX.get(low[:2], 10)
    digits = low[2:] if base != 10 else low
    try:
        if not re.fullmatch("[0-9a-f]*", digits) or (base == 10 and not digits):
            raise ValueError
        value = int(digits or "0", base)
    except ValueError:
        raise UnsupportedLiteral(text) from None
    if value >= TOP:
        raise UnsupportedLiteral(f"{text} needs more than 256 bits")
    return value


class Parser:
    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise SyntaxProblem(f"unexpected {source[at]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    # -- tokens
    def peek(self, ahead: int = 0) -> tuple[str, str]:
        k = self.at + ahead
        return self.tokens[k] if k < len(self.tokens) else ("end", "")

    def word(self, ahead: int = 0) -> str:
        kind, value = self.peek(ahead)
        return value.upper() if kind == "word" else ""

    def take(self, *words: str) -> bool:
        """Skips the given words if they come next."""
        if all(self.word(k) == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def mark(self, value: str) -> bool:
        if self.peek() == ("mark", value):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.mark(value):
            raise SyntaxProblem(f"expected {value!r}, found {self.peek()[1]!r}")

    def identifier(self) -> str:
        kind, value = self.peek()
        if kind not in ("word", "quoted") or (kind == "word" and value.upper() in _RESERVED):
            raise SyntaxProblem(f"expected a name, found {value!r}")
        if value.startswith("__"):
            raise ReservedIdentifier(value)
        self.at += 1
        return value

    # -- statements
    def statement(self) -> Select:
        if self.peek()[0] == "end":
            raise SyntaxProblem("empty query")
        if self.word() in ("WITH",):
            raise NestedSelect("WITH")
        if self.word() in ("VALUES", "TABLE"):
            raise NotASelect(self.word())
        if self.peek() == ("mark", "("):
            raise NestedSelect("parentheses around a query")
        if not self.take("SELECT"):
            raise NotASelect(self.peek()[1])
        query = self.select()
        self.mark(";")
        if self.peek()[0] != "end":
            raise SyntaxProblem(f"unexpected {self.peek()[1]!r}")
        return query

    def select(self) -> Select:
        distinct = self.take("DISTINCT")
        if distinct and self.word() == "ON":
            raise UnsupportedFeature("DISTINCT ON")
        if not distinct:
            self.take("ALL")
        if self.word() == "TOP":
            raise UnsupportedFeature("TOP")
        items = [self.item()]
        while self.mark(","):
            items.append(self.item())
        if self.word() == "INTO":
            raise NotASelect("SELECT INTO")
        if not self.take("FROM"):
            raise UnsupportedFeature("SELECT without FROM")
        table, alias, renames = self.source()
        where = self.expression() if self.take("WHERE") else None
        self.rest()
        return Select(tuple(items), table, alias, tuple(renames), where, distinct)

    def item(self) -> Item:
        if self.mark("*"):
            if self.word() in ("EXCLUDE", "EXCEPT", "REPLACE", "RENAME", "ILIKE"):
                raise UnsupportedFeature(f"* {self.word()}")
            return Item(Star())
        if self.peek()[0] in ("word", "quoted") and self.peek(1) == ("mark", ".") and self.peek(2) == ("mark", "*"):
            raise UnsupportedFeature(f"{self.peek()[1]}.*")
        expr = self.expression()
        if self.take("AS"):
            return Item(expr, self.identifier())
        if self.peek()[0] in ("word", "quoted") and self.word() not in (*_RESERVED, "INTO"):
            return Item(expr, self.identifier())
        return Item(expr)

    def source(self) -> tuple[str, str | None, list[str]]:
        if self.peek() == ("mark", "("):
            raise NestedSelect("a query in FROM")
        if self.word() in ("LATERAL", "UNNEST", "JSON_TABLE"):
            raise UnsupportedFeature(self.word())
        table = self.identifier()
        if self.peek() == ("mark", "."):
            raise UnsupportedFeature("compound table names")
        if self.peek() == ("mark", "("):
            raise UnsupportedFeature("table functions")
        alias, renames = None, []
        if self.take("AS") or (self.peek()[0] in ("word", "quoted") and self.word() not in _RESERVED and self.word() not in ("PIVOT", "UNPIVOT", "MATCH_RECOGNIZE", "ASOF", "SEMI", "ANTI", "TABLESAMPLE", "WITH", "OUTER")):
            alias = self.identifier()
            if self.mark("("):
                renames = [self.identifier()]
                while self.mark(","):
                    renames.append(self.identifier())
                self.need(")")
        if self.mark(",") or self.word() in ("JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "ASOF", "SEMI", "ANTI", "OUTER"):
            raise UnsupportedJoin("one table is supported in FROM")
        if self.word() in ("PIVOT", "UNPIVOT", "MATCH_RECOGNIZE", "TABLESAMPLE", "WITH"):
            raise UnsupportedFeature(self.word())
        return table, alias, renames

    def rest(self) -> None:
        """What may follow WHERE in other dialects."""
        word = self.word()
        if word in ("LIMIT", "OFFSET"):
            raise UseInvocationParameter(word)
        if word in ("UNION", "INTERSECT", "EXCEPT"):
            raise SetOperation(word)
        if word in _AFTER_FROM:
            raise UnsupportedFeature(_AFTER_FROM[word])

    # -- expressions
    def expression(self) -> Expr:
        left = self.conjunction()
        while self.take("OR"):
            left = Binary("OR", left, self.conjunction())
        return left

    def conjunction(self) -> Expr:
        left = self.exclusive()
        while self.take("AND"):
            left = Binary("AND", left, self.exclusive())
        return left

    def exclusive(self) -> Expr:
        left = self.negation()
        while self.take("XOR"):
            left = Binary("XOR", left, self.negation())
        return left

    def negation(self) -> Expr:
        if self.take("NOT"):
            return Unary("NOT", self.negation())
        return self.comparison()

    def comparison(self) -> Expr:
        left = self.bitwise()
        while True:
            kind, value = self.peek()
            if kind == "mark" and value in ("=", "==", "<>", "!=", "<", "<=", ">", ">="):
                self.at += 1
                if self.word() in ("ANY", "ALL", "SOME"):
                    raise UnsupportedFeature(self.word())
                left = Binary({"==": "=", "!=": "<>"}.get(value, value), left, self.bitwise())
                continue
            if kind == "mark" and value == "<=>":
                raise UnsupportedOperator(value)
            negated = self.word() == "NOT" and self.word(1) in ("IN", "BETWEEN", "LIKE", "ILIKE", "RLIKE", "SIMILAR")
            word = self.word(1) if negated else self.word()
            if word in ("LIKE", "ILIKE", "RLIKE", "SIMILAR"):
                raise UnsupportedOperator(word)
            if word == "IN":
                self.at += 1 + negated
                left = self.in_list(left, negated)
            elif word == "BETWEEN":
                self.at += 1 + negated
                low = self.bitwise()
                if not self.take("AND"):
                    raise SyntaxProblem("BETWEEN without AND")
                left = Between(left, low, self.bitwise(), negated)
            elif word == "IS":
                self.at += 1
                left = self.is_what(left)
            else:
                return left

    def in_list(self, arg: Expr, negated: bool) -> Expr:
        if self.word() == "UNNEST":
            raise UnsupportedFeature("IN UNNEST")
        self.need("(")
        if self.word() in ("SELECT", "WITH"):
            raise NestedSelect("IN (SELECT)")
        items: list[Expr] = []
        if not self.mark(")"):
            items.append(self.expression())
            while self.mark(","):
                items.append(self.expression())
            self.need(")")
        return InList(arg, tuple(items), negated)

    def is_what(self, arg: Expr) -> Expr:
        negated = self.take("NOT")
        for word in ("TRUE", "FALSE"):
            if self.take(word):
                return IsTruth(arg, (word == "TRUE") != negated)
        raise UnsupportedOperator(f"IS {self.word()}")

    def bitwise(self) -> Expr:
        left = self.sum()
        kind, value = self.peek()
        if kind == "mark" and value in ("&", "|", "^", "||", "->", "->>", "::", "~", "@", "#", "["):
            raise UnsupportedOperator(value)
        return left

    def sum(self) -> Expr:
        left = self.product()
        while self.peek()[0] == "mark" and self.peek()[1] in "+-" and self.peek()[1]:
            op = self.peek()[1]
            self.at += 1
            left = Binary(op, left, self.product())
        return left

    def product(self) -> Expr:
        left = self.sign()
        while self.peek()[0] == "mark" and self.peek()[1] in ("*", "/", "%"):
            op = self.peek()[1]
            self.at += 1
            left = Binary(op, left, self.sign())
        return left

    def sign(self) -> Expr:
        if self.mark("+"):
            return self.sign()
        if self.peek() in (("mark", "-"), ("mark", "~"), ("mark", "!")):
            raise UnsupportedOperator(self.peek()[1])
        return self.atom()

    def atom(self) -> Expr:
        kind, value = self.peek()
        word = self.word()
        if kind == "mark" and value == "(":
            self.at += 1
            if self.word() in ("SELECT", "WITH"):
                raise NestedSelect("a scalar query")
            inner = self.expression()
            if self.peek() == ("mark", ","):
                raise UnsupportedFeature("tuples")
            self.need(")")
            return inner
        if kind == "number":
            self.at += 1
            if not value.isdigit():
                raise UnsupportedLiteral(value)
            return Literal(parse_integer(value))
        if kind == "string":
            self.at += 1
            return Literal(parse_integer(value[1:-1]))
        if kind == "param":
            self.at += 1
            return Param(value)
        if word in ("TRUE", "FALSE"):
            self.at += 1
            return Literal(int(word == "TRUE"), True)
        if word == "NULL":
            raise UnsupportedLiteral("NULL")
        if word in ("CASE", "CAST", "TRY_CAST", "EXTRACT", "INTERVAL", "ARRAY", "EXISTS", "STRUCT", "MAP", "SUBSTRING", "TRIM", "POSITION", "OVERLAY", "CEIL", "FLOOR", "DATE", "TIMESTAMP") and (word == "CASE" or self.peek(1)[1] in ("(", "[") or self.peek(1)[0] == "string"):
            raise UnsupportedFeature(word)
        if kind in ("word", "quoted"):
            name = self.identifier()
            if self.mark("("):
                return self.call(name)
            if self.mark("."):
                column = self.identifier()
                if self.peek() == ("mark", "."):
                    raise UnsupportedFeature("names of more than two parts")
                return Name(column, name)
            return Name(name)
        raise SyntaxProblem(f"unexpected {value!r}" if kind != "end" else "unexpected end")

    def call(self, name: str) -> Expr:
        if self.word() in ("DISTINCT", "ALL"):
            raise UnsupportedFeature(f"{name}({self.word()} ...)")
        if self.mark("*"):
            raise InvalidArity(f"{name}(*): the argument must be an expression")
        args: list[Expr] = []
        if not self.mark(")"):
            if self.word() in ("SELECT", "WITH"):
                raise NestedSelect(name)
            args.append(self.expression())
            while self.mark(","):
                args.append(self.expression())
            if self.word() == "ORDER":
                raise UnsupportedFeature(f"ORDER BY in {name}")
            self.need(")")
        if self.word() in ("FILTER", "OVER", "WITHIN") and (self.peek(1) == ("mark", "(") or self.word() == "WITHIN" or self.word() == "OVER"):
            raise UnsupportedFeature(self.word())
        return Call(name.upper(), tuple(args))


def parse(source: str) -> Select:
    """One SELECT of the dialect's grammar."""
    return Parser(source).statement()
