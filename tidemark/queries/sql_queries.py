"""Queries in the dialect, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import u256
from tidemark.queries.tables import engine, with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The range's two bounds, as every WHERE clause of the dialect needs them.
IN_RANGE = "block BETWEEN $MIN_BLOCK AND $MAX_BLOCK"


def longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("bigint").alias(c) for c in df.columns])


def add(name: str, text: str, low: int, high: int, oracle: str, tables: str, params: Mapping[str, int] | None = None, limit: int | None = None, offset: int = 0) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return longs(engine(spark, sf_dir).query(text, low, high, params, limit, offset).frame)

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = with_tables(tables) + oracle


def average(e: str) -> str:
    return f"cast(sum({e}) // count(*) as bigint)"


def total(e: str) -> str:
    return f"cast(sum({e}) as bigint)"


O, L, U = "orders_epoch", "lineitem_epoch", "live"

# Aggregates.
add("agg_sum", f"SELECT SUM(price) AS v FROM orders_epoch WHERE {IN_RANGE} AND status <> 70", 300, 900, f"select {total('price')} as v from orders_epoch where block between 300 and 900 and status <> 70 having count(*) > 0", O)
add("agg_count", f"SELECT COUNT(price) AS v FROM orders_epoch WHERE {IN_RANGE} AND custkey < 500", 1, 2405, "select count(*)::bigint as v from orders_epoch where block between 1 and 2405 and custkey < 500 having count(*) > 0", O)
add("agg_avg", f"SELECT AVG(price / 3) AS v FROM orders_epoch WHERE {IN_RANGE}", 100, 2000, f"select {average('price // 3')} as v from orders_epoch where block between 100 and 2000 having count(*) > 0", O)
add("agg_min", f"SELECT MIN(price) AS v FROM orders_epoch WHERE {IN_RANGE}", 100, 400, "select min(price) as v from orders_epoch where block between 100 and 400 having count(*) > 0", O)
add("agg_max", f"SELECT MAX(price % 1000) AS v FROM orders_epoch WHERE {IN_RANGE}", 100, 400, "select max(price % 1000) as v from orders_epoch where block between 100 and 400 having count(*) > 0", O)
add("agg_multi", f"SELECT SUM(qty * price) AS total, AVG(price) AS mean, MIN(price - disc) AS least, MAX(price + tax) AS most, COUNT(qty) AS n FROM lineitem_epoch WHERE {IN_RANGE} AND (qty > 10 AND disc <= 5 OR tax = 0) AND partkey >= 75", 365, 1460,
    f"select {total('qty * price')} as total, {average('price')} as mean, min(price - disc) as least, max(price + tax) as most, count(*)::bigint as n from lineitem_epoch where block between 365 and 1460 and (qty > 10 and disc <= 5 or tax = 0) and partkey >= 75 having count(*) > 0", L)
add("agg_empty", f"SELECT COUNT(price) AS n, SUM(price) AS v FROM orders_epoch WHERE {IN_RANGE}", 5000, 6000, f"select count(*)::bigint as n, {total('price')} as v from orders_epoch where block between 5000 and 6000 having count(*) > 0", O)
add("agg_distinct", f"SELECT DISTINCT SUM(price) AS v FROM orders_epoch WHERE {IN_RANGE}", 1, 800, f"select {total('price')} as v from orders_epoch where block between 1 and 800 having count(*) > 0", O)
add("agg_truth", f"SELECT SUM(price > 20000000) AS high, MAX(status = 80 XOR custkey > 9) AS either FROM orders_epoch WHERE {IN_RANGE}", 1, 2405, f"select {total('(price > 20000000)::bigint')} as high, max(((status = 80) <> (custkey > 9))::bigint) as either from orders_epoch where block between 1 and 2405 having count(*) > 0", O)
add("agg_versions", f"SELECT SUM(value) AS total, AVG(value) AS mean, MIN(value) AS least, MAX(k) AS most, COUNT(k) AS n FROM user_state WHERE {IN_RANGE} AND kind <> 2", 21, 150, f"select {total('value')} as total, {average('value')} as mean, min(value) as least, max(k) as most, count(*)::bigint as n from live where block between 21 and 150 and kind <> 2 having count(*) > 0", U)
add("agg_versions_by_epoch", f"SELECT SUM(value * block) AS total, COUNT(k) AS n FROM user_state WHERE {IN_RANGE} AND (block < 70 OR block > 100)", 21, 150, f"select {total('value * block')} as total, count(*)::bigint as n from live where block between 21 and 150 and (block < 70 or block > 100) having count(*) > 0", U)

# Projection.
add("project_columns", f"SELECT orderkey, custkey, price FROM orders_epoch WHERE {IN_RANGE}", 100, 130, "select orderkey, custkey, price from orders_epoch where block between 100 and 130", O)
add("project_exprs", f"SELECT orderkey, price / 100 AS whole, price % 100 AS rest, (price + custkey) * 2 AS twice FROM orders_epoch WHERE {IN_RANGE}", 100, 130, "select orderkey, price // 100 as whole, price % 100 as rest, (price + custkey) * 2 as twice from orders_epoch where block between 100 and 130", O)
add("project_star", f"SELECT orderkey, * FROM orders_epoch WHERE {IN_RANGE}", 100, 110, "select orderkey, block, custkey, price, status, orderkey as orderkey_2 from orders_epoch where block between 100 and 110", O)
add("alias_columns", f"SELECT e, p + 1 AS q FROM orders_epoch AS t (e, c, p, s, k) WHERE e BETWEEN $MIN_BLOCK AND $MAX_BLOCK AND t.s = 79", 100, 200, "select block as e, price + 1 as q from orders_epoch where block between 100 and 200 and status = 79", O)
add("alias_table", f"SELECT t.orderkey, t.price FROM orders_epoch AS t WHERE t.{IN_RANGE}", 100, 110, "select orderkey, price from orders_epoch where block between 100 and 110", O)

# Operators and predicates.
add("cmp_ops", f"SELECT orderkey, price = 5000000 AS eq, price <> 5000000 AS ne, price < custkey * 10000 AS lt, price <= 9000000 AS le, price > 9000000 AS gt, custkey >= 700 AS ge FROM orders_epoch WHERE {IN_RANGE}", 200, 230,
    "select orderkey, (price = 5000000)::bigint as eq, (price <> 5000000)::bigint as ne, (price < custkey * 10000)::bigint as lt, (price <= 9000000)::bigint as le, (price > 9000000)::bigint as gt, (custkey >= 700)::bigint as ge from orders_epoch where block between 200 and 230", O)
add("bool_ops", f"SELECT orderkey, (price > 9000000 AND custkey < 300) AS both, (price > 9000000 OR custkey < 300) AS any, (price > 9000000) XOR (custkey < 300) AS one, NOT (price > 9000000) AS none FROM orders_epoch WHERE {IN_RANGE}", 200, 230,
    'select orderkey, (price > 9000000 and custkey < 300)::bigint as both, (price > 9000000 or custkey < 300)::bigint as "any", ((price > 9000000) <> (custkey < 300))::bigint as one, (price <= 9000000)::bigint as none from orders_epoch where block between 200 and 230', O)
for op, key, sql in (("+", "add", "price + custkey"), ("*", "mul", "price * custkey"), ("/", "div", "case when disc = 0 then 0 else price // disc end"), ("%", "mod", "case when disc = 0 then price else price % disc end")):
    if key in ("div", "mod"):
        add(f"arith_{key}", f"SELECT partkey, price {op} disc AS v FROM lineitem_epoch WHERE {IN_RANGE}", 300, 320, f"select partkey, {sql} as v from lineitem_epoch where block between 300 and 320", L)
    else:
        add(f"arith_{key}", f"SELECT orderkey, price {op} custkey AS v FROM orders_epoch WHERE {IN_RANGE}", 300, 330, f"select orderkey, {sql} as v from orders_epoch where block between 300 and 330", O)
add("arith_sub", f"SELECT orderkey, price - 200000 AS v FROM orders_epoch WHERE {IN_RANGE} AND price >= 300000 AND custkey - 0 >= 0", 300, 330, "select orderkey, price - 200000 as v from orders_epoch where block between 300 and 330 and price >= 300000 and price >= 200000", O)
add("where_basic", f"SELECT orderkey FROM orders_epoch WHERE {IN_RANGE} AND price > 10000000 AND NOT status = 70", 300, 400, "select orderkey from orders_epoch where block between 300 and 400 and price > 10000000 and status <> 70", O)
add("in_list", f"SELECT orderkey, status FROM orders_epoch WHERE {IN_RANGE} AND status IN (70, 80) AND custkey NOT IN (1, 2, 3)", 300, 400, "select orderkey, status from orders_epoch where block between 300 and 400 and status in (70, 80) and custkey not in (1, 2, 3)", O)
add("in_empty_list", f"SELECT orderkey FROM orders_epoch WHERE {IN_RANGE} AND status NOT IN () AND NOT custkey IN ()", 300, 310, "select orderkey from orders_epoch where block between 300 and 310", O)
add("between", f"SELECT orderkey FROM orders_epoch WHERE {IN_RANGE} AND price BETWEEN 5000000 AND 9000000 AND custkey NOT BETWEEN 100 AND 900", 300, 500, "select orderkey from orders_epoch where block between 300 and 500 and price between 5000000 and 9000000 and custkey not between 100 and 900", O)
add("is_true", f"SELECT orderkey FROM orders_epoch WHERE {IN_RANGE} AND (price > 9000000) IS TRUE AND (status = 70) IS NOT TRUE", 300, 500, "select orderkey from orders_epoch where block between 300 and 500 and price > 9000000 and status <> 70", O)
add("primary_bounds", "SELECT orderkey FROM orders_epoch WHERE $MIN_BLOCK <= block AND block <= $MAX_BLOCK AND block = custkey + 5", 1, 2405, "select orderkey from orders_epoch where block between 1 and 2405 and block = custkey + 5", O)
add("no_where", "SELECT orderkey, price FROM orders_epoch", 40, 50, "select orderkey, price from orders_epoch where block between 40 and 50", O)
add("secondary_range", f"SELECT orderkey FROM orders_epoch WHERE {IN_RANGE} AND custkey > 100 + 20 AND custkey <= $1", 1, 2405, "select orderkey from orders_epoch where block between 1 and 2405 and custkey > 120 and custkey <= 180", O, {"$1": 180})
add("placeholders", f"SELECT orderkey, price + $1 AS v FROM orders_epoch WHERE {IN_RANGE} AND custkey >= $2 AND price > $1 * 10", 100, 300, "select orderkey, price + 777 as v from orders_epoch where block between 100 and 300 and custkey >= 350 and price > 7770", O, {"$1": 777, "$2": 350})

# Distinct, limit, offset.
add("distinct_expr", f"SELECT DISTINCT qty + 1 AS q, disc FROM lineitem_epoch WHERE {IN_RANGE} AND tax <> 3", 300, 700, "select distinct qty + 1 as q, disc from lineitem_epoch where block between 300 and 700 and tax <> 3", L)
add("distinct_star", f"SELECT DISTINCT * FROM lineitem_epoch WHERE {IN_RANGE}", 300, 320, "select distinct * from lineitem_epoch where block between 300 and 320", L)
add("bag_rows", f"SELECT qty, disc FROM lineitem_epoch WHERE {IN_RANGE}", 300, 330, "select qty, disc from lineitem_epoch where block between 300 and 330", L)
add("limit_param", f"SELECT orderkey, price FROM orders_epoch WHERE {IN_RANGE} AND price > 1000000", 300, 900, "select orderkey, price from (select * from orders_epoch where block between 300 and 900 and price > 1000000 order by block, custkey, orderkey limit 25)", O, limit=25)
add("offset_param", f"SELECT orderkey, price FROM orders_epoch WHERE {IN_RANGE}", 300, 900, "select orderkey, price from (select * from orders_epoch where block between 300 and 900 order by block, custkey, orderkey limit 10 offset 15)", O, limit=10, offset=15)
add("offset_past_end", f"SELECT orderkey FROM orders_epoch WHERE {IN_RANGE}", 300, 310, "select orderkey from orders_epoch where block between 300 and 310 order by block, custkey, orderkey limit 10 offset 100000000", O, limit=10, offset=100_000_000)
add("distinct_limit", f"SELECT DISTINCT qty, disc FROM lineitem_epoch WHERE {IN_RANGE}", 300, 900, "select qty, disc from (select distinct qty, disc from lineitem_epoch where block between 300 and 900) order by disc, qty limit 12 offset 3", L, limit=12, offset=3)
add("versions_rows", f"SELECT block, user_id, value + $1 AS v FROM user_state WHERE {IN_RANGE} AND user_id < 40", 10, 60, "select block, user_id, value + 5 as v from live where block between 10 and 60 and user_id < 40", U, {"$1": 5})
add("versions_limit", f"SELECT block, user_id, value FROM user_state WHERE {IN_RANGE} AND kind = 5", 10, 150, "select block, user_id, value from (select * from live where block between 10 and 150 and kind = 5 order by block, user_id limit 20 offset 4)", U, limit=20, offset=4)

# The integration scenarios: secondary values, ranges before the first epoch, gaps.
add("scenario_unique_secondary", f"SELECT AVG(value) AS v FROM user_state WHERE {IN_RANGE} AND user_id = 7", 70, 77, f"select {average('value')} as v from live where block between 70 and 77 and user_id = 7 having count(*) > 0", U)
add("scenario_secondary_placeholder", f"SELECT AVG(value) AS v FROM user_state WHERE {IN_RANGE} AND user_id = $1 AND value >= $2", 14, 210, f"select {average('value')} as v from live where block between 14 and 210 and user_id = 9 and value >= 500 having count(*) > 0", U, {"$1": 9, "$2": 500})
add("scenario_absent_secondary", f"SELECT AVG(value) AS v FROM user_state WHERE {IN_RANGE} AND user_id = $1 AND value >= $2", 14, 210, f"select {average('value')} as v from live where user_id = 99999999 and value >= 5 having count(*) > 0", U, {"$1": 99_999_999, "$2": 5})
add("scenario_key_not_always_live", f"SELECT AVG(value) AS v FROM user_state WHERE {IN_RANGE} AND user_id = 3", 0, 1000, f"select {average('value')} as v from live where user_id = 3 having count(*) > 0", U)
add("scenario_before_first", f"SELECT SUM(value) AS v FROM user_state WHERE {IN_RANGE}", 0, 6, f"select {total('value')} as v from live where block between 0 and 6 having count(*) > 0", U)
add("scenario_partly_before_first", f"SELECT AVG(value) AS v FROM user_state WHERE {IN_RANGE} AND user_id < 5", 0, 21, f"select {average('value')} as v from live where block between 0 and 21 and user_id < 5 having count(*) > 0", U)
add("scenario_gap", f"SELECT AVG(value) AS v FROM user_state WHERE {IN_RANGE}", 71, 76, f"select {average('value')} as v from live where block between 71 and 76 having count(*) > 0", U)
add("scenario_star_expr", f"SELECT *, value + $1 AS v FROM user_state WHERE {IN_RANGE} AND user_id = 5", 70, 120, "select block, user_id, value, kind, k, value + 3 as v from live where block between 70 and 120 and user_id = 5", U, {"$1": 3})


# 256-bit arithmetic: the same dialect in the wide form, shown as decimal text.


def add_wide(name: str, text: str, low: int, high: int, oracle: str, tables: str, limit: int | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = engine(spark, sf_dir).query(text, low, high, limit=limit, wide=True).frame
        return got.select(*[u256.narrow(F.col(c)).cast("string").alias(c) for c in got.columns])

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = with_tables(tables) + oracle


add_wide("wide_sums", f"SELECT SUM(price * price * qty) AS total, AVG(price * price) AS mean, MIN(price * qty) AS least, MAX(price - disc) AS most, COUNT(tax) AS n FROM lineitem_epoch WHERE {IN_RANGE} AND price * 7 > 1000", 300, 400,
    "select sum(price::hugeint * price * qty)::varchar as total, (sum(price::hugeint * price) // count(*))::varchar as mean, min(price * qty)::varchar as least, max(price - disc)::varchar as most, count(*)::varchar as n from lineitem_epoch where block between 300 and 400 and price * 7 > 1000", L)
add_wide("wide_rows", f"SELECT orderkey, price * price * custkey / (custkey + 1) AS v, price * price % 1000003 AS w FROM orders_epoch WHERE {IN_RANGE} AND price * price > custkey", 300, 330,
    "select orderkey::varchar as orderkey, (price::hugeint * price * custkey // (custkey + 1))::varchar as v, (price::hugeint * price % 1000003)::varchar as w from orders_epoch where block between 300 and 330 and price::hugeint * price > custkey", O)
add_wide("wide_versions", f"SELECT SUM(value * value * value) AS total, COUNT(k) AS n FROM user_state WHERE {IN_RANGE}", 7, 210, "select sum(value::hugeint * value * value)::varchar as total, count(*)::varchar as n from live", U)
