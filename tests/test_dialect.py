"""What the dialect accepts and refuses, and what it reads out of WHERE: cases made from its rules, each operator in each place and each limit at
its edge."""

import itertools
import json

import pytest

from tidemark import errors
from tidemark.catalog import Catalog, ColumnKind, Limits, table_def
from tidemark.cli import main
from tidemark.operators.digest import query_fingerprint
from tidemark.plans import bounds, rules
from tidemark.plans.evaluate import TOP, apply, evaluate
from tidemark.plans.parser import parse
from tidemark.plans.rules import BoundNames
from tidemark.plans.tree import text

#: A ledger of stock: days, warehouses as the secondary index, and four measures.
STOCK = ("stock", "day", "depot", "units", "price", "weight", "shelf")
LIMITS = Limits(columns=7, predicate_ops=6, result_ops=4, items=3, outputs=3, placeholders=2)
RANGE = "day >= $MIN_BLOCK AND day <= $MAX_BLOCK"
ARITHMETIC, COMPARISONS, LOGIC = ("+", "-", "*", "/", "%"), ("=", "<>", "!=", "<", "<=", ">", ">="), ("AND", "OR", "XOR")


def ledger(limits=LIMITS):
    catalog = Catalog(limits=limits)
    catalog.add(table_def(*STOCK))
    catalog.add(table_def("plain", "day", None, "units"))
    return catalog


def check(query, limits=LIMITS):
    out = rules.check(parse(query), ledger(limits))
    bounds.check_primary(out, BoundNames())
    return out


def refused(query, error, limits=LIMITS):
    with pytest.raises(error):
        check(query, limits)


# -- operators by place


@pytest.mark.parametrize("op", ARITHMETIC)
def test_arithmetic_in_every_place(op):
    e = f"units {op} price"
    assert [text(o.expr) for o in check(f"SELECT {e} FROM stock").outputs] == [e]
    assert check(f"SELECT SUM({e}) FROM stock").outputs[0].aggregate == "SUM"
    assert text(check(f"SELECT units FROM stock WHERE {RANGE} AND {e} = 3").where).endswith(f"({e}) = 3")
    refused(f"SELECT units FROM stock WHERE {RANGE} AND ({e})", errors.InvalidArgument)
    refused(f"SELECT units FROM stock WHERE {RANGE} AND ({e}) OR units = 1", errors.InvalidArgument)


@pytest.mark.parametrize("op", COMPARISONS)
def test_comparisons_in_every_place(op):
    check(f"SELECT units {op} price FROM stock")
    check(f"SELECT MAX(units {op} 3) FROM stock")
    check(f"SELECT units FROM stock WHERE {RANGE} AND NOT units {op} price")
    check(f"SELECT units FROM stock WHERE {RANGE} AND $1 {op} price")


@pytest.mark.parametrize(("a", "b"), list(itertools.product(LOGIC, LOGIC)))
def test_logic_binds_by_rank(a, b):
    """NOT binds tightest, then XOR, AND, OR; equal ones from the left."""
    rank = {"XOR": 0, "AND": 1, "OR": 2}
    got = check(f"SELECT units FROM stock WHERE ({RANGE}) AND (units = 1 {a} price = 2 {b} shelf = 3)", Limits()).where
    left = f"((units = 1) {a} (price = 2)) {b} (shelf = 3)"
    right = f"(units = 1) {a} ((price = 2) {b} (shelf = 3))"
    want = check(f"SELECT units FROM stock WHERE ({RANGE}) AND ({left if rank[a] <= rank[b] else right})", Limits()).where
    assert got == want


@pytest.mark.parametrize("op", ["&", "|", "^", "||", "->", "->>", "LIKE", "ILIKE", "NOT LIKE", "SIMILAR TO", "RLIKE"])
def test_other_operators_are_refused(op):
    refused(f"SELECT units {op} price FROM stock", errors.QueryError)
    refused(f"SELECT units FROM stock WHERE {RANGE} AND units {op} price", errors.QueryError)


@pytest.mark.parametrize("name", ["SUM", "COUNT", "AVG", "MIN", "MAX"])
def test_aggregates(name):
    check(f"SELECT {name}(units) FROM stock")
    check(f"SELECT {name.lower()}(units * 2) AS total FROM stock WHERE {RANGE}")
    refused(f"SELECT {name}() FROM stock", errors.InvalidArity)
    refused(f"SELECT {name}(*) FROM stock", errors.InvalidArity)
    refused(f"SELECT {name}(units, price) FROM stock", errors.InvalidArity)
    refused(f"SELECT {name}(DISTINCT units) FROM stock", errors.UnsupportedFeature)
    refused(f"SELECT {name}({name}(units)) FROM stock", errors.InvalidArgument)
    refused(f"SELECT {name}(units) + 1 FROM stock", errors.UnsupportedFeature)
    refused(f"SELECT {name}(units), price FROM stock", errors.MixedQuery)
    refused(f"SELECT price, {name}(units) FROM stock", errors.MixedQuery)
    refused(f"SELECT {name}(units) OVER () FROM stock", errors.UnsupportedFeature)
    refused(f"SELECT {name}(units) FILTER (WHERE price = 1) FROM stock", errors.UnsupportedFeature)


@pytest.mark.parametrize("name", ["STDDEV", "FIRST", "ABS", "COALESCE"])
def test_other_functions_are_unknown(name):
    refused(f"SELECT {name}(units) FROM stock", errors.UnknownFunction)


# -- sugar: each form and what it stands for


@pytest.mark.parametrize(
    ("short", "long"),
    [
        ("units BETWEEN 4 AND 9", "units >= 4 AND units <= 9"),
        ("NOT units BETWEEN 4 AND 9", "NOT (units >= 4 AND units <= 9)"),
        ("units IN (4)", "units = 4"),
        ("units IN (4, 6, price)", "units = 4 OR units = 6 OR units = price"),
        ("units NOT IN (4, 6)", "units <> 4 AND units <> 6"),
        ("(units > 3) IS TRUE", "(units > 3) <> 0"),
        ("(units > 3) IS FALSE", "(units > 3) = 0"),
        ("units == 3", "units = 3"),
        ("units = '0x1F'", "units = 31"),
        ("units = '0b101'", "units = 5"),
        ("units = '0o17'", "units = 15"),
        ("stock.units = stock.price", "units = price"),
    ],
)
def test_sugar(short, long):
    open_ = Limits()
    assert check(f"SELECT units FROM stock WHERE ({RANGE}) AND ({short})", open_).where == check(f"SELECT units FROM stock WHERE ({RANGE}) AND ({long})", open_).where


@pytest.mark.parametrize("literal", ["2.5", "NULL", "'abc'", "'0q12'", "'0b2'", "'0o9'", f"'{hex(TOP)}'"])
def test_literals_outside_the_domain(literal):
    refused(f"SELECT units + {literal} FROM stock", errors.UnsupportedLiteral)


def test_the_greatest_literal_is_inside():
    check(f"SELECT units + '{hex(TOP - 1)}' FROM stock")


# -- limits at their edges


def chain(n, op="+"):
    return f" {op} ".join(["units"] * (n + 1))


def test_operations_of_results():
    check(f"SELECT {chain(4)} FROM stock")
    check(f"SELECT {chain(2)}, {chain(2, '*')} FROM stock")
    refused(f"SELECT {chain(5)} FROM stock", errors.LimitExceeded)
    refused(f"SELECT {chain(2)}, {chain(3, '*')} FROM stock", errors.LimitExceeded)


def test_operations_of_predicates():
    # What is left of 6 once the two bounds and their AND are counted decides how long a chain may be.
    sizes = [n for n in range(8) if _fits(f"SELECT units FROM stock WHERE {RANGE} AND {chain(n)} = 1")]
    assert sizes == list(range(len(sizes))) and 0 < len(sizes) < 7


def _fits(query):
    try:
        check(query)
    except errors.LimitExceeded:
        return False
    return True


def test_outputs_and_placeholders():
    check("SELECT units, price, weight FROM stock")
    refused("SELECT units, price, weight, shelf FROM stock", errors.LimitExceeded)
    check("SELECT units + $1, price + $2 FROM stock")
    refused("SELECT units + $1, price + $2, weight + $3 FROM stock", errors.UnknownPlaceholder)
    refused("SELECT units + $2 FROM stock", errors.MissingPlaceholder)
    for name in ("$0", "$Y", "$3"):
        refused(f"SELECT units + {name} FROM stock", errors.UnknownPlaceholder)


def test_without_limits_all_of_them_pass():
    check(f"SELECT {chain(40)}, {', '.join(STOCK[1:])} FROM stock", Limits())


# -- names


def test_names():
    assert [o.name for o in check("SELECT units AS a, price FROM stock").outputs] == ["a", "price"]
    assert len(check("SELECT * FROM stock", Limits()).outputs) == 6
    got = check("SELECT s.b FROM stock AS s (a, b, c, d, e, f) WHERE s.a >= $MIN_BLOCK AND a <= $MAX_BLOCK")
    assert [text(o.expr) for o in got.outputs] == [text(o.expr) for o in check(f"SELECT depot FROM stock WHERE {RANGE}").outputs]
    check(f"SELECT s.units FROM stock AS s WHERE {RANGE}")
    for query in ("SELECT colour FROM stock", "SELECT plain.units FROM stock", "SELECT units FROM depot", "SELECT a FROM stock AS s (a, b)", "SELECT units FROM stock AS s (a, b, c, d, e, f)"):
        refused(query, errors.UnknownSymbol)
    for query in ("SELECT __units FROM stock", "SELECT units AS __u FROM stock"):
        refused(query, errors.ReservedIdentifier)
    for query in ("SELECT 7 FROM stock", "SELECT $1 FROM stock", f"SELECT units FROM stock WHERE {RANGE} AND price"):
        refused(query, errors.InvalidArgument)


# -- clauses outside the dialect, one for each


@pytest.mark.parametrize(
    ("tail", "error"),
    [
        ("GROUP BY depot", errors.UnsupportedFeature),
        ("HAVING units > 1", errors.UnsupportedFeature),
        ("ORDER BY price DESC", errors.UnsupportedFeature),
        ("LIMIT 5", errors.UseInvocationParameter),
        ("LIMIT $1", errors.UseInvocationParameter),
        ("OFFSET 5", errors.UseInvocationParameter),
        ("OFFSET units", errors.UseInvocationParameter),
        ("UNION ALL SELECT units FROM plain", errors.SetOperation),
        ("INTERSECT SELECT units FROM plain", errors.SetOperation),
        ("EXCEPT SELECT units FROM plain", errors.SetOperation),
        (", plain", errors.UnsupportedJoin),
        ("CROSS JOIN plain", errors.UnsupportedJoin),
        ("LEFT JOIN plain ON stock.day = plain.day", errors.UnsupportedJoin),
        ("WHERE units = (SELECT units FROM plain)", errors.QueryError),
        ("WHERE units IN (SELECT units FROM plain)", errors.NestedSelect),
        ("WHERE EXISTS (SELECT units FROM plain)", errors.UnsupportedFeature),
        ("WHERE units >= ANY (SELECT units FROM plain)", errors.UnsupportedFeature),
        ("WHERE units >= ALL (SELECT units FROM plain)", errors.UnsupportedFeature),
        ("WHERE units IS NOT NULL", errors.UnsupportedOperator),
        ("WHERE", errors.SyntaxProblem),
        ("WHERE units =", errors.SyntaxProblem),
        ("WHERE (units = 1", errors.SyntaxProblem),
    ],
)
def test_clauses(tail, error):
    refused(f"SELECT units FROM stock {tail}", error)


@pytest.mark.parametrize(
    ("query", "error"),
    [
        ("DELETE FROM stock", errors.NotASelect),
        ("UPDATE stock SET units = 1", errors.NotASelect),
        ("DROP TABLE stock", errors.NotASelect),
        ("WITH x AS (SELECT units FROM stock) SELECT units FROM x", errors.NestedSelect),
        ("SELECT units FROM (SELECT units FROM stock)", errors.NestedSelect),
        ("SELECT DISTINCT ON (units) price FROM stock", errors.UnsupportedFeature),
        ("SELECT stock.* FROM stock", errors.UnsupportedFeature),
        ("SELECT * EXCEPT (units) FROM stock", errors.UnsupportedFeature),
        ("SELECT TOP 9 units FROM stock", errors.UnsupportedFeature),
        ("SELECT units FROM depots.stock", errors.UnsupportedFeature),
        ("SELECT depots.stock.units FROM stock", errors.UnsupportedFeature),
        ("SELECT CASE units WHEN 1 THEN 2 END FROM stock", errors.UnsupportedFeature),
        ("SELECT CAST(units AS BIGINT) FROM stock", errors.UnsupportedFeature),
        ("SELECT -units FROM stock", errors.UnsupportedOperator),
        ("   ", errors.SyntaxProblem),
        ("SELECT units FROM stock; SELECT price FROM stock", errors.QueryError),
    ],
)
def test_statements(query, error):
    refused(query, error)


# -- primary bounds: every way to write each bound, joined by each connective

LOWS = {"day >= $MIN_BLOCK": True, "$MIN_BLOCK <= day": True, "day > $MIN_BLOCK": False, "day >= 5": False, "day >= $1": False, "day = $MIN_BLOCK": False}
HIGHS = {"day <= $MAX_BLOCK": True, "$MAX_BLOCK >= day": True, "day < $MAX_BLOCK": False, "day <= $1": False, "day <= $MIN_BLOCK": False}


@pytest.mark.parametrize(("low", "high"), list(itertools.product(LOWS, HIGHS)))
def test_primary_bounds(low, high):
    open_ = Limits(placeholders=2)
    for where, fine in ((f"{low} AND {high}", True), (f"{high} AND units = 3 AND ({low})", True), (f"{low} OR {high}", False), (f"units = 1 OR ({low} AND {high})", False), (f"NOT ({low} AND {high})", False)):
        query = f"SELECT units FROM stock WHERE {where}"
        if fine and LOWS[low] and HIGHS[high]:
            check(query, open_)
        else:
            refused(query, errors.MissingPrimaryBounds, open_)


def test_between_gives_both_bounds():
    check("SELECT units FROM stock WHERE day BETWEEN $MIN_BLOCK AND $MAX_BLOCK")
    check("SELECT units FROM stock")
    refused("SELECT units FROM stock WHERE day BETWEEN $MAX_BLOCK AND $MIN_BLOCK", errors.MissingPrimaryBounds)
    refused("SELECT units FROM stock WHERE NOT day BETWEEN $MIN_BLOCK AND $MAX_BLOCK", errors.MissingPrimaryBounds)


# -- the secondary range


@pytest.mark.parametrize(
    ("op", "low", "high"),
    [("=", 20, 20), ("<", None, 19), ("<=", None, 20), (">", 21, None), (">=", 20, None), ("<>", None, None)],
)
def test_secondary_range_of_each_comparison(op, low, high):
    turned = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
    for where in (f"depot {op} 20", f"20 {turned} depot", f"depot {op} $1", f"depot {op} $1 AND units = 4"):
        got = rules.check(parse(f"SELECT units FROM stock WHERE {RANGE} AND {where}"), ledger(Limits()))
        r = bounds.secondary_range(got, {"$1": 20})
        assert (r.low, r.high) == (low, high)
        assert ("stock.depot" in bounds.isolated_text(got, BoundNames(), low, high)) == (low is not None or high is not None)


def test_secondary_ranges_together():
    def ends(where):
        r = bounds.secondary_range(rules.check(parse(f"SELECT units FROM stock WHERE {RANGE} AND ({where})"), ledger(Limits())), {"$1": 6})
        return r.low, r.high, r.empty

    assert ends("depot > 3 AND depot < 30 AND depot > 8") == (9, 29, False)
    assert ends("depot >= 2 * $1 AND depot <= 40") == (12, 40, False)
    assert ends("depot > 30 AND depot < 3") == (31, 2, True)
    assert ends("depot > 3 OR depot < 2") == ends("depot > units") == ends("units = 4") == (None, None, False)


# -- values, arithmetic, folding, fingerprints


def test_values_for_placeholders():
    got, ends = check(f"SELECT units * $1 FROM stock WHERE {RANGE}"), {"$MIN_BLOCK": 1, "$MAX_BLOCK": 2}
    rules.check_values(got, {**ends, "$1": TOP - 1}, BoundNames())
    for values, error in (({}, errors.UnknownPlaceholder), ({"$1": 1, "$2": 1}, errors.TooManyParameters), ({"$1": TOP}, errors.InvalidArgument), ({"$1": -5}, errors.InvalidArgument)):
        with pytest.raises(error):
            rules.check_values(got, {**ends, **values}, BoundNames())


@pytest.mark.parametrize(("x", "y"), list(itertools.product((0, 1, 6, TOP - 1, 1 << 200), (0, 1, 4, TOP - 1, 1 << 130))))
def test_arithmetic_wraps_and_tells(x, y):
    for op, exact in (("+", x + y), ("-", x - y), ("*", x * y)):
        assert apply(op, x, y) == (exact % TOP, not 0 <= exact < TOP)
    assert apply("/", x, y) == ((x // y, False) if y else (0, True))
    assert apply("%", x, y) == ((x % y, False) if y else (x, True))


def test_folding():
    def where(source):
        return rules.fold(rules.expand(parse(f"SELECT units FROM stock WHERE {source}").where))

    assert text(where("units = 2 + 3 * 4")) == "units = 14"
    for source in ("units = 1 - 2", "units = 5 / 0"):  # what would lose the flag stays as it is
        kept = where(source)
        assert text(kept) != "units = 0" and evaluate(kept, {"units": 0})[1]


def test_fingerprint_is_of_the_meaning():
    print_ = lambda tail: query_fingerprint(check(f"SELECT units FROM stock WHERE {RANGE} AND {tail}", Limits()))
    assert print_("price IN (4, 6)") == print_("(price = 4   or stock.price = 6)") != print_("price IN (4, 7)")


def test_catalog_rules():
    for args, error in ((("t", "a", "b", "b"), errors.InvalidName), (("9t", "a", None), errors.InvalidName), (("t", "a b", None), errors.InvalidName), (("t", "a", None, "__c"), errors.ReservedIdentifier), (("__t", "a", None), errors.ReservedIdentifier)):
        with pytest.raises(error):
            table_def(*args)
    t = table_def(*STOCK)
    assert [c.kind for c in t.columns] == [ColumnKind.PRIMARY, ColumnKind.SECONDARY] + [ColumnKind.STANDARD] * 4 and t.names == list(STOCK[1:])


# -- the command line


@pytest.fixture
def catalog_file(tmp_path):
    columns = [{"name": c, "kind": k, "id": n} for n, (c, k) in enumerate((("day", "PrimaryIndex"), ("depot", "SecondaryIndex"), ("units", "Standard")))]
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps([{"user_facing_name": "stock", "zktable_name": "stock_1", "columns": columns}]))
    return str(path)


def run(capsys, *args):
    assert main(list(args)) == 0
    return capsys.readouterr().out.strip().splitlines()


def test_command_line(catalog_file, capsys):
    query = f"SELECT units FROM stock WHERE {RANGE} AND depot <= $1"
    catalog = ["--catalog", catalog_file]
    assert json.loads("".join(run(capsys, "check", query, *catalog)))["outputs"] == {"units": "units"}
    assert json.loads(run(capsys, "range", query, *catalog, "--param", "$1=0x1E")[0]) == {"low": None, "high": 30, "error": False}
    assert run(capsys, "isolate", query, *catalog, "--high", "30")[0].endswith("AND stock.depot <= 30")
    assert run(capsys, "fingerprint", query, *catalog) == run(capsys, "fingerprint", query.lower().replace("$min_block", "$MIN_BLOCK").replace("$max_block", "$MAX_BLOCK"), *catalog)


def test_command_line_with_data(spark, tmp_path, catalog_file, capsys):
    rows = [(1, 10, 5, 1, 2), (2, 20, 6, 1, 9), (3, 30, 7, 2, 9)]
    spark.createDataFrame(rows, "id bigint, depot bigint, units bigint, valid_from bigint, valid_until bigint").write.parquet(str(tmp_path / "v"))
    spark.createDataFrame([(100, 1), (105, 2), (110, 3)], "user_epoch bigint, incremental_epoch bigint").write.parquet(str(tmp_path / "m"))
    query, data = f"SELECT depot, units FROM stock WHERE {RANGE} AND depot >= $1 AND depot <= 25", ["--catalog", catalog_file, "--data", str(tmp_path / "v"), "--mapper", str(tmp_path / "m"), "--param", "$1=15", "--from", "100", "--to", "105", "--key", "id"]
    got = [[json.loads(x) for x in run(capsys, c, query, *data)] for c in ("query", "core", "bracket")]
    assert got[0] == [{"depot": 20, "units": 6}, {"depot": 20, "units": 6}, {"rows": 2, "error": False}]
    assert got[1] == [{"epoch": 100}, {"epoch": 105}, {"id": 2, "epoch": 100}, {"id": 2, "epoch": 105}]
    assert got[2] == [{"below": None, "above": 110}, {"side": -1, "depot": 10, "id": 1}, {"side": 1, "depot": 30, "id": 3}]
    with pytest.raises(SystemExit):
        main(["query", query, "--catalog", catalog_file])
