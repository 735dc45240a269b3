"""The engine's tables over the driver's Parquet files, and the same tables as DuckDB SQL.

Money is in cents and epochs are day numbers, so that both engines compute on whole numbers alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import Catalog, table_def
from tidemark.engine import Engine
from tidemark.operators import store
from tidemark.sources.rows import cells_from_json
from tidemark.sources.words import pack

LAST_EPOCH, STEP = 30, 7
#: Declared greatest values of columns (money: below 2^40 cents), so that products and their sums stay in native types.
MOST = {"block": 1 << 20, "qty": 1 << 16, "price": 1 << 40, "disc": 100, "tax": 100, "status": 127, "value": 1 << 40, "kind": 5, "k": 1 << 20}

ORDERS = table_def("orders_epoch", "block", "custkey", "price", "status", "orderkey")
LINES = table_def("lineitem_epoch", "block", "partkey", "qty", "price", "disc", "tax", "suppkey")
USERS = table_def("user_state", "block", "user_id", "value", "kind", "k")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


def orders_epoch(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    return o.select(
        (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) + 1).cast("bigint").alias("block"),
        F.col("o_custkey").cast("bigint").alias("custkey"),
        cents("o_totalprice").alias("price"),
        F.ascii("o_orderstatus").cast("bigint").alias("status"),
        F.col("o_orderkey").cast("bigint").alias("orderkey"),
    )


def lineitem_epoch(spark: SparkSession, sf: str) -> DataFrame:
    l = read(spark, sf, "lineitem")
    return l.select(
        (F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")) + 1).cast("bigint").alias("block"),
        F.col("l_partkey").cast("bigint").alias("partkey"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        cents("l_extendedprice").alias("price"),
        cents("l_discount").alias("disc"),
        cents("l_tax").alias("tax"),
        F.col("l_suppkey").cast("bigint").alias("suppkey"),
    )


def user_log(spark: SparkSession, sf: str) -> DataFrame:
    """Last write of each (user, day) of the events."""
    rows = read(spark, sf, "events").select(
        F.col("user_id").cast("bigint"),
        (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1).cast("bigint").alias("epoch"),
        cents("value").alias("value"),
        F.array_position(F.array(*[F.lit(x) for x in EVENT_TYPES]), F.col("event_type")).cast("bigint").alias("kind"),
        "props",
        F.col("event_id").cast("bigint"),
    )
    rows = cells_from_json(rows, "props", {"k": "$.k"}).drop("props")
    return store.last_writes(rows, ["user_id"], "epoch", "event_id").drop("event_id")


def user_state(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of the users in incremental epochs 1 to 30."""
    return store.build_versions(user_log(spark, sf), ["user_id"], last=LAST_EPOCH).select("user_id", "value", "kind", "k", "valid_from", "valid_until")


def mapper(spark: SparkSession) -> DataFrame:
    """User epochs are seven times the incremental ones, so there are gaps."""
    return spark.range(1, LAST_EPOCH + 1).select((F.col("id") * STEP).alias("user_epoch"), F.col("id").alias("incremental_epoch"))


def engine(spark: SparkSession, sf: str) -> Engine:
    e = Engine(spark, Catalog())
    e.register(ORDERS, orders_epoch(spark, sf), order=("orderkey",), most=MOST)
    e.register(LINES, lineitem_epoch(spark, sf), order=("qty", "price", "disc", "tax", "suppkey"), most=MOST)
    e.register(USERS, user_state(spark, sf), mapper(spark), order=("user_id",), most=MOST)
    return e


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Packed words: slot 0 holds three constants, slot 1 the length of slot 2, slot 2 maps part keys to two words, and slot 3 maps
    (region, nation) to a word."""
    null = F.lit(None).cast("bigint")
    row = lambda slot, k1, k2, index, word: [F.lit(slot).alias("slot"), k1.alias("key1"), k2.alias("key2"), F.lit(index).alias("word_index"), word.alias("word")]
    p, n = read(spark, sf, "part"), read(spark, sf, "nation")
    one = spark.range(1)
    simple = one.select(*row(0, null, null, 0, pack((F.lit(1234567), 4), (F.lit(89), 2), (F.lit(5), 1))))
    length = p.agg(F.count("*").alias("n")).select(*row(1, null, null, 0, pack((F.col("n"), 32))))
    first = p.select(*row(2, F.col("p_partkey").cast("bigint"), null, 0, pack((cents("p_retailprice"), 8), (F.col("p_size"), 2), (F.col("p_partkey"), 7))))
    second = p.select(*row(2, F.col("p_partkey").cast("bigint"), null, 1, pack((F.col("p_partkey") * 3 + 1, 32))))
    nested = n.select(*row(3, F.col("n_regionkey").cast("bigint"), F.col("n_nationkey").cast("bigint"), 0, pack((F.col("n_nationkey") * 1000 + F.col("n_regionkey"), 6))))
    return simple.unionByName(length).unionByName(first).unionByName(second).unionByName(nested)


# The same tables in DuckDB SQL, to stand after WITH.
SQL = {
    "orders_epoch": "orders_epoch as (select datediff('day', date '1995-01-01', o_orderdate::date) + 1 as block, o_custkey as custkey, round(o_totalprice * 100)::bigint as price, ascii(o_orderstatus)::bigint as status, o_orderkey as orderkey from orders)",
    "lineitem_epoch": "lineitem_epoch as (select datediff('day', date '1995-01-01', l_shipdate::date) + 1 as block, l_partkey as partkey, l_quantity::bigint as qty, round(l_extendedprice * 100)::bigint as price, round(l_discount * 100)::bigint as disc, round(l_tax * 100)::bigint as tax, l_suppkey as suppkey from lineitem)",
    "user_log": """user_log as (
        select user_id, epoch, value, kind, k from (
            select user_id, datediff('day', date '2024-01-01', ts::date) + 1 as epoch, round(value * 100)::bigint as value,
                   list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)::bigint as kind,
                   json_extract_string(props, '$.k')::bigint as k,
                   row_number() over (partition by user_id, ts::date order by event_id desc) as r
            from events) where r = 1)""",
    "user_state": """user_state as (
        select user_id, value, kind, k, epoch as valid_from,
               coalesce(lead(epoch) over (partition by user_id order by epoch) - 1, 30)::bigint as valid_until
        from user_log)""",
    "live": "live as (select e * 7 as block, user_id, value, kind, k from user_state, range(1, 31) t(e) where e between valid_from and valid_until)",
}


def with_tables(*names: str) -> str:
    need = {"user_state": ["user_log"], "live": ["user_log", "user_state"]}
    order = list(dict.fromkeys(x for n in names for x in [*need.get(n, []), n]))
    return "with " + ",\n".join(SQL[n] for n in order) + "\n"
