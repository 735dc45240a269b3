"""Every registered query of the engine with its DuckDB SQL, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

from tidemark.queries import registry

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")


def plain(table):
    table = table.select(sorted(table.column_names))
    return table.column_names, sorted(repr(tuple(r.values())) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    assert name in registry.ORACLE_SQL
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name]).to_arrow_table()
    assert plain(registry.QUERIES[name](spark, SF).toArrow()) == plain(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
