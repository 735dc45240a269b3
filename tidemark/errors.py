"""Errors of the SQL dialect, one class for each reason to refuse a query."""

from __future__ import annotations


class QueryError(ValueError):
    """A query that the dialect refuses."""


class SyntaxProblem(QueryError):
    """The text is not one statement of the dialect's grammar."""


class NotASelect(QueryError):
    """The statement is no SELECT, or changes data."""


class MixedQuery(QueryError):
    """Aggregates and row values in one SELECT list."""


class UnsupportedOperator(QueryError):
    """An operator outside the dialect."""


class UnknownFunction(QueryError):
    """A function other than SUM, COUNT, AVG, MIN and MAX."""


class InvalidArity(QueryError):
    """An aggregate without exactly one argument."""


class InvalidArgument(QueryError):
    """An argument or operand of a kind that the place does not take."""


class UnknownPlaceholder(QueryError):
    """A placeholder that is not declared, or for which no value is given."""


class MissingPlaceholder(QueryError):
    """A placeholder that must be used and is not."""


class TooManyParameters(QueryError):
    """More values than placeholders."""


class UnsupportedLiteral(QueryError):
    """A literal that is no unsigned 256-bit integer or truth value."""


class NestedSelect(QueryError):
    """A SELECT inside another."""


class SetOperation(QueryError):
    """UNION, INTERSECT or EXCEPT."""


class UnsupportedFeature(QueryError):
    """A clause or form outside the dialect."""


class UnsupportedJoin(QueryError):
    """More than one table in FROM."""


class ReservedIdentifier(QueryError):
    """A name that begins with two underscores."""


class InvalidName(QueryError):
    """A table or column name that is not a letter followed by letters, digits and underscores."""


class UnknownSymbol(QueryError):
    """A table or column that does not exist."""


class AmbiguousSymbol(QueryError):
    """A name that more than one column has."""


class UseInvocationParameter(QueryError):
    """LIMIT or OFFSET in the text; they are parameters of the call."""


class MissingPrimaryBounds(QueryError):
    """A WHERE clause without both inclusive bounds of the primary index in its conjunction."""


class LimitExceeded(QueryError):
    """More columns, operations, items, rows or placeholders than the limits allow."""


class NeedsWideArithmetic(QueryError):
    """A value left the range of the native types; the query is to run on 256-bit integers."""


class EpochError(ValueError):
    """An epoch out of order, in the future, or before the first."""


class KeyStateError(ValueError):
    """An operation on a key that is not there, or an insertion of one that is."""


class IngestError(ValueError):
    """Rows that a table can't take."""
