"""Results and error flags of queries, against the evaluator on Python integers."""

import random

import pytest

from tidemark import errors
from tidemark.catalog import Catalog, Limits, table_def
from tidemark.engine import Engine
from tidemark.functions import u256
from tidemark.plans import rules
from tidemark.plans.evaluate import TOP, aggregate, evaluate
from tidemark.plans.parser import parse

IN = "block BETWEEN $MIN_BLOCK AND $MAX_BLOCK"
T = table_def("t", "block", "s", "a", "b")


def rows_of(n=60, seed=1):
    r = random.Random(seed)
    return [(k % 12 + 1, r.randrange(8), r.choice([0, 1, 2, 7, 100, r.randrange(1 << 40)]), r.choice([0, 1, 3, 50, r.randrange(1 << 40)])) for k in range(n)]


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark, Catalog())
    e.register(T, spark.createDataFrame(rows_of(), "block bigint, s bigint, a bigint, b bigint"), order=("a", "b"))
    return e


def expected(query, low, high, params=None):
    checked = rules.check(parse(query), Catalog({"t": T}))
    values = {**(params or {}), "$MIN_BLOCK": low, "$MAX_BLOCK": high}
    out, flag = [], False
    for block, s, a, b in rows_of():
        if not low <= block <= high:
            continue
        row = dict(block=block, s=s, a=a, b=b)
        keep, f = evaluate(checked.where, row, values)
        got = [evaluate(o.expr, row, values) for o in checked.outputs]
        flag |= f or any(x for _, x in got)
        if keep:
            out.append(tuple(v for v, _ in got))
    if checked.aggregates:
        pairs = [aggregate(o.aggregate, [r[k] for r in out]) for k, o in enumerate(checked.outputs)]
        return ([tuple(v for v, _ in pairs)] if out else []), flag or any(w for _, w in pairs)
    return (sorted(set(out)) if checked.distinct else sorted(out)), flag


@pytest.mark.parametrize(
    "query",
    [
        f"SELECT a + b AS x, a * b AS y, a / b AS z, a % b AS w FROM t WHERE {IN}",
        f"SELECT a - b AS x FROM t WHERE {IN}",
        f"SELECT a - b AS x FROM t WHERE {IN} AND a >= b",
        f"SELECT (a - b) * (b - a) AS x, a < b AS y FROM t WHERE {IN} AND s <> 3",
        f"SELECT a * b * a AS x FROM t WHERE {IN}",
        f"SELECT a FROM t WHERE {IN} AND a / (b - b) = 0",
        f"SELECT DISTINCT s, a > 5 AS big FROM t WHERE {IN}",
        f"SELECT SUM(a), AVG(b), MIN(a + b), MAX(a * 3), COUNT(a) FROM t WHERE {IN} AND s > 1",
        f"SELECT SUM(a - b), MAX(b - a), AVG(a - b) FROM t WHERE {IN}",
        f"SELECT SUM(a * a * a * a * a * a * a) FROM t WHERE {IN}",
        f"SELECT AVG(a) FROM t WHERE {IN} AND s = 99",
        f"SELECT COUNT(a) FROM t WHERE {IN} AND (a = 1) XOR (b = 1) AND NOT s IN (1, 2)",
        f"SELECT a + '0x{'f' * 64}' AS x FROM t WHERE {IN} AND s < 3",
        f"SELECT a FROM t WHERE {IN} AND a - 5 < 3",
    ],
)
def test_against_integers(engine, query):
    got, flag = engine.rows(query, 2, 9)
    want, want_flag = expected(query, 2, 9)
    assert sorted(tuple(r.values()) for r in got) == want
    assert flag == want_flag


def test_matched_rows(engine):
    want, _ = expected(f"SELECT a FROM t WHERE {IN} AND s < 4", 2, 9)
    assert engine.query(f"SELECT DISTINCT a FROM t WHERE {IN} AND s < 4", 2, 9, limit=2).matched() == len(want)
    assert engine.query(f"SELECT SUM(a) FROM t WHERE {IN} AND s < 4", 2, 9).matched() == len(want)
    assert engine.query(f"SELECT SUM(a) FROM t WHERE {IN} AND s = 99", 2, 9).matched() == 0


def test_flag_counts_rows_that_where_drops(engine):
    _, flag = engine.rows(f"SELECT a / b AS x FROM t WHERE {IN} AND b > 0", 1, 12)
    assert flag


def test_wide_columns(spark):
    e = Engine(spark, Catalog())
    values = [(1, TOP - 1, 2), (2, 1 << 255, 1 << 255), (3, 10, 4)]
    frame = spark.createDataFrame([(k, bytearray(u256.encode(a)), bytearray(u256.encode(b))) for k, a, b in values], "block bigint, a binary, b binary")
    e.register(table_def("w", "block", None, "a", "b"), frame, binary=frozenset({"a", "b"}))
    got, flag = e.rows(f"SELECT a + b AS p, a - b AS m, a > b AS g FROM w WHERE {IN}", 0, 9)
    assert sorted(tuple(r.values()) for r in got) == sorted(((a + b) % TOP, (a - b) % TOP, int(a > b)) for _, a, b in values)
    assert flag
    got, flag = e.rows(f"SELECT SUM(a), AVG(a), MIN(a), MAX(b), COUNT(a) FROM w WHERE {IN}", 0, 9)
    total = sum(a for _, a, _ in values)
    assert list(got[0].values()) == [total % TOP, total % TOP // 3, 10, 1 << 255, 3]
    assert flag
    assert u256.decode(bytes(spark.range(1).select(u256.widen(u256.F.lit("98765432109876543210987654321").cast("decimal(38,0)")).alias("x")).first()[0])) == 98765432109876543210987654321


def test_limits_and_offsets(spark, engine):
    last_first = lambda rows: sorted(rows, key=lambda x: x[::-1])  # noqa: E731  the order of results; LIMIT and OFFSET go by block, s and a
    every = [tuple(r.values()) for r in engine.query(f"SELECT block, s, a FROM t WHERE {IN}", 1, 12, limit=1000).rows()]
    assert every == last_first(every)
    assert [tuple(r.values()) for r in engine.query(f"SELECT block, s, a FROM t WHERE {IN}", 1, 12, limit=5, offset=7).rows()] == last_first(sorted(every)[7:12])
    assert engine.query(f"SELECT a FROM t WHERE {IN}", 1, 12, limit=5, offset=1000).rows() == []
    e = Engine(spark, Catalog(limits=Limits(outputs=3)))
    e.register(T, spark.createDataFrame(rows_of(), "block bigint, s bigint, a bigint, b bigint"))
    assert len(e.query(f"SELECT a FROM t WHERE {IN}", 1, 12).rows()) == 3
    with pytest.raises(errors.LimitExceeded):
        e.query(f"SELECT a FROM t WHERE {IN}", 1, 12, limit=4)


def test_versions_weighted_and_expanded_agree(spark):
    e = Engine(spark, Catalog())
    r = random.Random(3)
    versions = [(k % 9, r.randrange(100), f, f + r.randrange(6)) for k, f in enumerate(r.randrange(1, 20) for _ in range(50))]
    mapper = spark.createDataFrame([(7 * k, k) for k in range(1, 26)], "user_epoch bigint, incremental_epoch bigint")
    e.register(table_def("v", "block", "id", "x"), spark.createDataFrame(versions, "id bigint, x bigint, valid_from bigint, valid_until bigint"), mapper)
    live = [(7 * t, i, x) for i, x, f, u in versions for t in range(f, u + 1) if t <= 25 and 30 <= 7 * t <= 100]
    got = e.query(f"SELECT SUM(x), COUNT(x), MIN(x), MAX(x) FROM v WHERE {IN} AND id < 7", 30, 100)
    xs = [x for _, i, x in live if i < 7]
    assert list(got.rows()[0].values()) == [sum(xs), len(xs), min(xs), max(xs)]
    assert "NestedLoop" not in got.frame._jdf.queryExecution().toString()
    got = e.query(f"SELECT block, id, x FROM v WHERE {IN}", 30, 100)
    assert sorted(tuple(r.values()) for r in got.rows()) == sorted(live)
    assert e.query(f"SELECT SUM(x) FROM v WHERE {IN}", 31, 34).rows() == []  # inside a gap


def test_index_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(rows_of(), "block bigint, s bigint, a bigint, b bigint").write.parquet(path)
    e = Engine(spark, Catalog())
    e.register(T, spark.read.parquet(path))
    plan = e.query(f"SELECT SUM(a) FROM t WHERE {IN} AND s > 2 AND s <= 5", 2, 9).frame._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(block,2)" in plan and "GreaterThanOrEqual(s,3)" in plan and "LessThanOrEqual(s,5)" in plan
    assert "b#" not in plan.split("ReadSchema")[1]


def test_empty_table(spark):
    e = Engine(spark, Catalog())
    e.register(T, spark.createDataFrame([], "block bigint, s bigint, a bigint, b bigint"))
    assert e.rows(f"SELECT SUM(a), COUNT(a) FROM t WHERE {IN}", 1, 9) == ([], False)
    assert e.rows(f"SELECT a FROM t WHERE {IN}", 1, 9) == ([], False)


def test_results_are_sorted_by_value(spark):
    """By the last output first, after LIMIT has chosen rows by their place in the table; equal rows stay."""
    e = Engine(spark)
    rows = [(1, 4, 9), (1, 2, 9), (2, 7, 1), (2, 7, 1), (3, 1, 5)]
    e.register(table_def("t", "epoch", "a", "b"), spark.createDataFrame(rows, "epoch bigint, a bigint, b bigint").repartition(3))
    assert [(r["a"], r["b"]) for r in e.query("SELECT a, b FROM t", 1, 3).rows()] == [(7, 1), (7, 1), (1, 5), (2, 9), (4, 9)]
    assert [(r["a"], r["b"]) for r in e.query("SELECT a, b FROM t", 1, 3, limit=3).rows()] == [(7, 1), (2, 9), (4, 9)]
    assert [r["x"] for r in e.query("SELECT DISTINCT b * 2 AS x FROM t", 1, 3).rows()] == [2, 10, 18]
    assert [r["x"] for r in e.query("SELECT a * b AS x FROM t", 1, 3, wide=True).rows()] == [5, 7, 7, 18, 36]


def test_answers_are_whole(spark):
    """One object, computed, in the wide form where a value leaves the native types."""
    e = Engine(spark)
    e.register(table_def("t", "epoch", "a", "b"), spark.createDataFrame([(1, 4, 9), (2, 7, 1), (2, 3, 3)], "epoch bigint, a bigint, b bigint"))
    got = e.answer("SELECT a + b AS x FROM t WHERE epoch >= $MIN_BLOCK AND epoch <= $MAX_BLOCK AND a > 3", 1, 2, limit=1)
    assert (got.n_rows, got.matched, got.error, got.wide) == (1, 2, False, False) and got.frame.collect()[0].x == 13
    got = e.answer("SELECT a - b AS x FROM t", 1, 2)
    assert (got.n_rows, got.matched, got.error, got.wide) == (3, 3, True, True) and got.frame.count() == 3
    rows, error = e.rows("SELECT a - b AS x FROM t", 1, 2)
    assert [r["x"] for r in rows] == [0, 6, (1 << 256) - 5] and error
    got = e.answer("SELECT MAX(a), COUNT(b) FROM t WHERE epoch >= $MIN_BLOCK AND epoch <= $MAX_BLOCK AND a > 100", 1, 2)
    assert (got.n_rows, got.matched, got.error) == (0, 0, False)
