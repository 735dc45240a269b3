"""Tables from ordinary rows and from JSON cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import TableDef
from tidemark.errors import IngestError


def ingest_rows(rows: DataFrame, table: TableDef, renames: Mapping[str, str] | None = None, unique: Sequence[str] = ()) -> DataFrame:
    """The table's columns of ``rows``, checked in one pass: there are rows, and no null, negative or (in ``unique``) repeated values."""
    names = {c: (renames or {}).get(c, c) for c in table.names}
    missing = [n for n in names.values() if n not in rows.columns]
    if missing:
        raise IngestError(f"{table.name}: no column {', '.join(missing)}")
    out = rows.select(*[F.col(n).cast("bigint").alias(c) for c, n in names.items()])
    bad = F.lit(False)
    for c in table.names:
        bad = bad | F.col(c).isNull() | (F.col(c) < 0)
    n, wrong = out.agg(F.count("*"), F.count_if(bad)).first()
    if not n:
        raise IngestError(f"{table.name}: no rows")
    if wrong:
        raise IngestError(f"{table.name}: {wrong} rows with null or negative values")
    if unique and out.groupBy(*unique).count().where("count > 1").limit(1).count():
        raise IngestError(f"{table.name}: repeated {', '.join(unique)}")
    return out


def cells_from_json(rows: DataFrame, column: str, cells: Mapping[str, str]) -> DataFrame:
    """``rows`` with a BIGINT for each of ``cells`` (name: JSON path) in the JSON text ``column``."""
    return rows.withColumns({name: F.get_json_object(column, path).cast("bigint") for name, path in cells.items()})
