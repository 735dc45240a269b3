"""Command line. Against a catalog file: check a query, show its isolated form, its secondary range or its fingerprint. With data as well: run it
(query), or show the rows and epochs that it touches (core) and their neighbours outside its ranges (bracket)."""

from __future__ import annotations

import argparse
import json

from tidemark.catalog import Catalog, Limits
from tidemark.operators.digest import query_fingerprint
from tidemark.plans import bounds, rules
from tidemark.plans.parser import parse
from tidemark.plans.rules import BoundNames, Checked
from tidemark.plans.tree import text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("command", choices=("check", "isolate", "range", "fingerprint", "query", "bracket", "core"))
    p.add_argument("query")
    p.add_argument("--catalog", required=True, help="JSON array of tables")
    p.add_argument("--low", type=int, help="lower end of the secondary range to keep")
    p.add_argument("--high", type=int, help="upper end")
    p.add_argument("--param", action="append", default=[], metavar="NAME=VALUE", help="value of a placeholder, such as $1=5")
    p.add_argument("--data", help="Parquet of the table: a row for each (row, epoch), or versions if there is a mapper")
    p.add_argument("--mapper", help="Parquet of user_epoch and incremental_epoch")
    p.add_argument("--from", dest="first", type=int, help="first user epoch")
    p.add_argument("--to", dest="last", type=int, help="last user epoch")
    p.add_argument("--limit", type=int)
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--key", action="append", default=[], help="key column of the table's rows")
    return p


def with_data(a: argparse.Namespace, checked: Checked, catalog: Catalog, values: dict[str, int], names: BoundNames) -> list[dict]:
    """What query, bracket and core print, a JSON object a line."""
    from tidemark.engine import Engine
    from tidemark.operators import keys
    from tidemark.session import session

    if a.data is None or a.first is None or a.last is None:
        raise SystemExit("--data, --from and --to are needed")
    spark = session("local[*]", "tidemark")
    frame = spark.read.parquet(a.data)
    mapper = spark.read.parquet(a.mapper) if a.mapper else None
    if a.command == "query":
        engine = Engine(spark, Catalog(limits=catalog.limits), names)
        engine.register(checked.table, frame, mapper)
        rows, error = engine.rows(a.query, a.first, a.last, values, a.limit, a.offset)
        return [*rows, {"rows": len(rows), "error": error}]
    if mapper is None or not a.key or checked.table.secondary is None:
        raise SystemExit("--mapper, --key and a secondary index are needed")
    secondary, r = checked.table.secondary.name, bounds.secondary_range(checked, values)
    shown = lambda rows: [x.asDict() for x in rows.collect()]
    if a.command == "core":
        rows = keys.core_rows(frame, mapper, a.first, a.last, a.key, secondary, r.low, r.high)
        return [*shown(keys.core_epochs(mapper, a.first, a.last)), *shown(rows.orderBy(*rows.columns))]
    out = shown(keys.bracket_epochs(mapper, a.first, a.last))
    at = mapper.where(f"user_epoch <= {a.last}").agg({"incremental_epoch": "max"}).first()[0]
    if at is not None:
        near = keys.bracket_secondary(frame, at, a.key, secondary, 0 if r.low is None else r.low, keys.TOP if r.high is None else r.high)
        out += shown(near.orderBy("side"))
    return out


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    names, catalog = BoundNames(), Catalog.from_json(a.catalog, Limits())
    checked = rules.check(parse(a.query), catalog, names)
    bounds.check_primary(checked, names)
    values = {k: int(v, 0) for k, v in (x.split("=", 1) for x in a.param)}
    if a.command == "check":
        shown = {"table": checked.table.physical, "outputs": {o.name: f"{o.aggregate}({text(o.expr)})" if o.aggregate else text(o.expr) for o in checked.outputs}, "where": text(checked.where) if checked.where else None, "placeholders": checked.placeholders}
        print(json.dumps(shown, indent=2))
    elif a.command == "isolate":
        print(bounds.isolated_text(checked, names, a.low, a.high))
    elif a.command == "range":
        r = bounds.secondary_range(checked, values)
        print(json.dumps({"low": r.low, "high": r.high, "error": r.flag}))
    elif a.command == "fingerprint":
        print(query_fingerprint(checked))
    else:
        for x in with_data(a, checked, catalog, values, names):
            print(json.dumps(x))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
