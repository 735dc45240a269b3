"""Tables of the dialect: columns with a role, and limits on queries."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from enum import Enum
from pathlib import Path

from tidemark.errors import InvalidName, ReservedIdentifier, UnknownSymbol

_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]*")


class ColumnKind(Enum):
    PRIMARY = "PrimaryIndex"
    SECONDARY = "SecondaryIndex"
    STANDARD = "Standard"


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: ColumnKind = ColumnKind.STANDARD
    id: int = 0


def check_name(name: str) -> str:
    if name.startswith("__"):
        raise ReservedIdentifier(name)
    if not _NAME.fullmatch(name):
        raise InvalidName(name)
    return name


@dataclass(frozen=True)
class TableDef:
    """A logical table. It has one primary (epoch) column and at most one secondary index."""

    name: str
    columns: tuple[ColumnDef, ...]
    physical: str = ""
    repeated_ids: bool = False

    def __post_init__(self) -> None:
        check_name(self.name)
        names = [check_name(c.name) for c in self.columns]
        if len(set(names)) != len(names):
            raise InvalidName(f"{self.name}: repeated column names")
        if sum(c.kind is ColumnKind.PRIMARY for c in self.columns) != 1:
            raise InvalidName(f"{self.name}: there must be one primary index")
        if sum(c.kind is ColumnKind.SECONDARY for c in self.columns) > 1:
            raise InvalidName(f"{self.name}: there can be one secondary index")
        ids = [c.id for c in self.columns if c.id]
        if not self.repeated_ids and len(set(ids)) != len(ids):
            raise InvalidName(f"{self.name}: repeated column ids")

    @property
    def primary(self) -> ColumnDef:
        return next(c for c in self.columns if c.kind is ColumnKind.PRIMARY)

    @property
    def secondary(self) -> ColumnDef | None:
        return next((c for c in self.columns if c.kind is ColumnKind.SECONDARY), None)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]


def table_def(name: str, primary: str, secondary: str | None, *standard: str, physical: str = "") -> TableDef:
    """A table with ids by position."""
    kinds = [(primary, ColumnKind.PRIMARY)] + [(secondary, ColumnKind.SECONDARY)] * bool(secondary) + [(c, ColumnKind.STANDARD) for c in standard]
    return TableDef(name, tuple(ColumnDef(c, k, n) for n, (c, k) in enumerate(kinds, 1)), physical or name)


@dataclass(frozen=True)
class Limits:
    """Bounds on a query; None: unbounded."""

    columns: int | None = None
    predicate_ops: int | None = None
    result_ops: int | None = None
    items: int | None = None
    outputs: int | None = None
    placeholders: int | None = None


@dataclass
class Catalog:
    tables: dict[str, TableDef] = field(default_factory=dict)
    limits: Limits = Limits()

    def add(self, table: TableDef) -> TableDef:
        self.tables[table.name] = table
        return table

    def get(self, name: str) -> TableDef:
        if name not in self.tables:
            raise UnknownSymbol(f"table {name}")
        return self.tables[name]

    @classmethod
    def from_json(cls, source: str | Path, limits: Limits = Limits()) -> "Catalog":
        """A catalog from a JSON array of tables (a path or the text): user_facing_name, zktable_name and columns, each with
        name, id and kind. Column ids may repeat in such files."""
        text = source if isinstance(source, str) and source.lstrip().startswith("[") else Path(source).read_text()
        out = cls(limits=limits)
        for t in json.loads(text):
            columns = tuple(ColumnDef(c["name"], ColumnKind(c["kind"]), int(c["id"])) for c in t["columns"])
            out.add(TableDef(t["user_facing_name"], columns, t["zktable_name"], repeated_ids=True))
        return out
