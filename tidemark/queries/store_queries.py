"""Queries on versions, keys, lineage, extraction and digests, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import digest, keys, lineage, ranges, scan, store
from tidemark.queries.sql_queries import longs
from tidemark.queries.tables import ORDERS, lineitem_epoch, mapper, orders_epoch, read, user_log, user_state, with_tables, words
from tidemark.sources import rows as row_source
from tidemark.sources.words import Slice, extract_mapping, extract_simple, extract_with_length, merge_single_mapping

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None, *tables: str, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLE_SQL[name or f.__name__] = (with_tables(*tables) if tables else "") + oracle
        return f

    return put


# -- versions


@query("select user_id, value, kind, k, valid_from, valid_until from user_state", "user_state")
def scd2_build(spark: SparkSession, sf: str) -> DataFrame:
    return user_state(spark, sf)


@query(
    """, m as (select kind, user_id, value, epoch as valid_from, lead(epoch) over w - 1 as next_any, lag(kind) over w as was from user_log window w as (partition by user_id order by epoch))
    select user_id, kind, value, valid_from, coalesce(next_any, 30)::bigint as valid_until from m""",
    "user_log",
)
def scd2_rekey(spark: SparkSession, sf: str) -> DataFrame:
    """The key holds the secondary value (kind): a change of it ends the row under the old key and begins one under the new."""
    log = user_log(spark, sf)
    w = Window.partitionBy("user_id").orderBy("epoch")
    moved = log.withColumn("old", F.lag("kind").over(w)).where("old is not null and old <> kind").select("user_id", F.col("old").alias("kind"), "epoch", F.lit(None).cast("bigint").alias("value"), F.lit(True).alias("deleted"))
    changes = log.select("user_id", "kind", "epoch", "value", F.lit(False).alias("deleted")).unionByName(moved)
    return store.build_versions(changes, ["user_id", "kind"], deleted="deleted", last=30).select("user_id", "kind", "value", "valid_from", "valid_until")


def _batch(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Open versions of users as of epoch 20, and a batch: users divisible by 5 are deleted, by 3 updated, absent ones inserted."""
    log = user_log(spark, sf)
    versions = store.build_versions(log.where("epoch <= 20"), ["user_id"]).select("user_id", "value", "valid_from", "valid_until")
    live = versions.where(F.col("valid_until") == store.OPEN)
    old = live.where("user_id % 5 = 0 or user_id % 3 = 0").select(F.when(F.col("user_id") % 5 == 0, "delete").otherwise("update").alias("op"), F.lit(0).alias("seq"), "user_id", (F.col("value") + 1).alias("value"))
    new = live.where("user_id < 10").select(F.lit("insert").alias("op"), F.lit(0).alias("seq"), (F.col("user_id") + 1_000_000).alias("user_id"), "value")
    return versions, old.unionByName(new)


@query(
    """, v as (select user_id, value, epoch as valid_from, lead(epoch) over (partition by user_id order by epoch) - 1 as u from user_log where epoch <= 20),
    o as (select * from v where u is null)
    select user_id, value, valid_from, coalesce(u, case when user_id % 5 = 0 or user_id % 3 = 0 then 20 else 9223372036854775807 end)::bigint as valid_until from v
    union all select user_id, value + 1, 21, 9223372036854775807 from o where user_id % 3 = 0 and user_id % 5 <> 0
    union all select user_id + 1000000, value, 21, 9223372036854775807 from o where user_id < 10""",
    "user_log",
)
def apply_batch(spark: SparkSession, sf: str) -> DataFrame:
    versions, batch = _batch(spark, sf)
    store.check_batch(versions, batch, ["user_id"])
    return longs(store.apply_batch(versions, batch, ["user_id"], 21))


@query(
    """select a.user_id, coalesce(case when b.value % 2 = 0 then b.value end, a.value) as value, coalesce(b.k, a.k) as k
    from user_state a left join user_state b on a.user_id = b.user_id and b.valid_from <= 20 and b.valid_until >= 20 where a.valid_from <= 10 and a.valid_until >= 10""",
    "user_state",
)
def merge_cells(spark: SparkSession, sf: str) -> DataFrame:
    s = user_state(spark, sf)
    old = store.snapshot_at(s, 10).select("user_id", "value", "k")
    new = store.snapshot_at(s, 20).select("user_id", F.when(F.col("value") % 2 == 0, F.col("value")).alias("value"), "k", F.col("kind").alias("unknown"))
    return store.merge_cells(old, new, ["user_id"])


@query("select user_id, value, kind, k, valid_from, valid_until from user_state where valid_from <= 12 and valid_until >= 12", "user_state")
def snapshot_at(spark: SparkSession, sf: str) -> DataFrame:
    return store.snapshot_at(user_state(spark, sf), 12)


@query("select user_id, value, kind, k, valid_from, valid_until from user_state where valid_from = 12", "user_state")
def diff_at(spark: SparkSession, sf: str) -> DataFrame:
    return store.born_at(user_state(spark, sf), 12)


@query("select count(*)::bigint as size from user_state where valid_from <= 12 and valid_until >= 12", "user_state")
def size_at(spark: SparkSession, sf: str) -> DataFrame:
    return store.size_at(user_state(spark, sf), 12)


@query("select user_id from user_state where valid_from <= 12 and valid_until >= 12", "user_state")
def keys_at(spark: SparkSession, sf: str) -> DataFrame:
    return store.keys_at(user_state(spark, sf), ["user_id"], 12)


@query("select user_id, value, kind, k, valid_from, valid_until from user_state where user_id = 8 and valid_from <= 12 and valid_until >= 12", "user_state")
def get_at(spark: SparkSession, sf: str) -> DataFrame:
    return store.get_at(user_state(spark, sf), {"user_id": 8}, 12)


@query("select user_id, e as epoch, value from user_state, range(1, 31) t(e) where e between valid_from and valid_until and (user_id * 7 + e) % 11 = 0", "user_state")
def get_many_at(spark: SparkSession, sf: str) -> DataFrame:
    s = user_state(spark, sf)
    epochs = spark.range(1, 31).select(F.col("id").alias("epoch"))
    pairs = s.select("user_id").distinct().join(F.broadcast(epochs), (F.col("user_id") * 7 + F.col("epoch")) % 11 == 0)  # 30 epochs
    return store.get_many_at(s, pairs, ["user_id"]).select("user_id", "epoch", "value")


@query("select user_id, value, kind, k, valid_from, case when valid_until >= 15 then 9223372036854775807 else valid_until end as valid_until from user_state where valid_from <= 15", "user_state")
def rollback_to(spark: SparkSession, sf: str) -> DataFrame:
    return store.rollback(user_state(spark, sf), mapper(spark), 105)[0]


@query("select user_id, valid_from as incremental_epoch, valid_from * 7 as user_epoch from user_state", "user_state")
def epoch_map(spark: SparkSession, sf: str) -> DataFrame:
    began = user_state(spark, sf).select("user_id", (F.col("valid_from") * 7).alias("user_epoch"))
    return store.to_incremental(began, mapper(spark))


@query("select e * 7 as user_epoch, case when e > 1 then e * 7 - 7 end as previous, case when e < 30 then e * 7 + 7 end as next from range(1, 31) t(e)")
def prev_next_epoch(spark: SparkSession, sf: str) -> DataFrame:
    return store.neighbours_of_epochs(mapper(spark))


@query("select block, min(value) as least, max(value) as greatest, count(*)::bigint as n_rows from live group by block", "live")
def epoch_minmax(spark: SparkSession, sf: str) -> DataFrame:
    return store.epoch_extremes(_live(spark, sf), "block", "value")


def _live(spark: SparkSession, sf: str, low: int = 7, high: int = 210) -> DataFrame:
    return scan.epoch_range(user_state(spark, sf), mapper(spark), low, high, "block")


# -- scans and keys


@query("select block, user_id, value, kind, k from live where block between 30 and 100", "live")
def scan_epoch_range(spark: SparkSession, sf: str) -> DataFrame:
    return _live(spark, sf, 30, 100).select("block", "user_id", "value", "kind", "k")


@query("select e * 7 as epoch, user_id, value, valid_from, valid_until from user_state, range(1, 31) t(e) where e between valid_from and valid_until and e * 7 between 30 and 100", "user_state")
def scan_with_keys(spark: SparkSession, sf: str) -> DataFrame:
    return scan.epoch_range(user_state(spark, sf), mapper(spark), 30, 100, "epoch", keep_lifetime=True).select("epoch", "user_id", "value", "valid_from", "valid_until")


@query("select block as epoch, user_id from live where block between 30 and 100", "live")
def keys_in_range(spark: SparkSession, sf: str) -> DataFrame:
    return scan.keys_in_range(user_state(spark, sf), mapper(spark), 30, 100, ["user_id"])


@query("select e * 7 as epoch from range(1, 31) t(e) where e * 7 between 30 and 180")
def core_keys_index(spark: SparkSession, sf: str) -> DataFrame:
    return keys.core_epochs(mapper(spark), 30, 500, 180)


@query("select block as epoch, user_id from live where block between 30 and 100 and user_id between 5 and 60", "live")
def core_keys_rows(spark: SparkSession, sf: str) -> DataFrame:
    return keys.core_rows(user_state(spark, sf), mapper(spark), 30, 100, ["user_id"], "user_id", 5, 60)


@query("select max(case when e * 7 < 30 then e * 7 end)::bigint as below, min(case when e * 7 > 100 then e * 7 end)::bigint as above from range(1, 31) t(e)")
def bracket_primary(spark: SparkSession, sf: str) -> DataFrame:
    return keys.bracket_epochs(mapper(spark), 30, 100)


@query(
    """, s as (select * from user_state where valid_from <= 12 and valid_until >= 12)
    select -1 as side, value, user_id from (select value, user_id from s where value < 1000 order by value desc, user_id limit 1)
    union all select 1, value, user_id from (select value, user_id from s where value > 2000 order by value, user_id limit 1)""",
    "user_state",
)
def bracket_secondary(spark: SparkSession, sf: str) -> DataFrame:
    return keys.bracket_secondary(user_state(spark, sf), 12, ["user_id"], "value", 1000, 2000)


@query("select block, value, user_id, lag(user_id) over w as before_user_id, lead(user_id) over w as after_user_id from live window w as (partition by block order by value, user_id)", "live")
def row_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return keys.row_neighbours(_live(spark, sf), "block", "value", ["user_id"])


@query(
    """, r as (select block, (row_number() over (order by block, value, user_id) - 1) // 5 as chunk from live)
    select chunk, min(block) as first_epoch, max(block) as last_epoch, count(*)::bigint as n_rows from r group by chunk""",
    "live",
)
def chunk_plan(spark: SparkSession, sf: str) -> DataFrame:
    return keys.chunk_plan(_live(spark, sf), "block", "value", ["user_id"], 5)


@query(
    """, recursive_base as (select block, user_id, value, row_number() over (partition by block order by value, user_id) as p, count(*) over (partition by block) as n from live),
    pw as (select j, (1::bigint << j) as b from range(0, 40) t(j)),
    tree as (
        select x.block, x.user_id, x.value, x.p,
               (select min_by((x.p // (2 * b)) * 2 * b + b, j) from pw where b > (x.p & -x.p) and (x.p // (2 * b)) * 2 * b + b <= x.n) as up
        from recursive_base x),
    up1 as (select t.block, t.p, t.up from tree t),
    path as (
        with recursive a as (
            select block, p, up from tree where user_id % 17 = 3
            union select t.block, t.p, t.up from a join up1 t on t.block = a.block and t.p = a.up)
        select distinct block, p from a),
    one as (select t.block, t.p from tree t join path on path.block = t.block and t.up = path.p),
    two as (select t.block, t.p from tree t join one on one.block = t.block and t.up = one.p),
    everything as (select block, p from path union select block, p from one union select block, p from two)
    select t.block, t.user_id, (t.user_id % 17 = 3)::bigint as is_core from everything e join tree t on t.block = e.block and t.p = e.p""",
    "live",
    name="lineage",
)
def lineage_query(spark: SparkSession, sf: str) -> DataFrame:
    placed = lineage.positions(_live(spark, sf), "block", "value", ["user_id"])
    return lineage.wide_lineage(placed, F.col("user_id") % 17 == 3, "block", ["user_id"])


@query(
    """, x as (select block, user_id, row_number() over (partition by block order by value, user_id) as p, count(*) over (partition by block) as n from live),
    pw as (select j, (1::bigint << j) as b from range(0, 40) t(j)),
    up as (select block, user_id, p, (select min_by((x.p // (2 * b)) * 2 * b + b, j) from pw where b > (x.p & -x.p) and (x.p // (2 * b)) * 2 * b + b <= x.n) as parent,
                  (select count(*) from pw where b > (x.p & -x.p) and (x.p // (2 * b)) * 2 * b + b <= x.n)::bigint as depth from x),
    down as (select block, parent as p, max(case when p < parent then p end) as l, min(case when p > parent then p end) as r from up where parent is not null group by block, parent)
    select up.block, up.user_id, up.p as position, up.parent, down.l as left_child, down.r as right_child, up.depth from up left join down on up.block = down.block and up.p = down.p""",
    "live",
)
def tree_topology(spark: SparkSession, sf: str) -> DataFrame:
    placed = lineage.positions(_live(spark, sf), "block", "value", ["user_id"])
    return lineage.topology(placed, "block", ["user_id"])


@query(
    """, s as (select * from user_state where valid_from <= 12 and valid_until >= 12)
    select -1 as side, user_id from s where user_id < 1000000 order by user_id desc limit 1""",
    "user_state",
)
def absence_witness(spark: SparkSession, sf: str) -> DataFrame:
    return keys.witness(user_state(spark, sf), 12, ["user_id"], "user_id", 1_000_000, 2_000_000).select("side", "user_id")


@query("select qty, disc, count(*)::bigint as multiplicity from lineitem_epoch where block between 300 and 900 group by qty, disc", "lineitem_epoch")
def distinct_multiplicity(spark: SparkSession, sf: str) -> DataFrame:
    return lineitem_epoch(spark, sf).where("block between 300 and 900").groupBy("qty", "disc").agg(F.count("*").alias("multiplicity"))


_NUMBERED = "from lineitem_epoch where block between 300 and 900"


@query(f"select row_number() over (order by qty, disc)::bigint as number, qty, disc, multiplicity from (select qty, disc, count(*)::bigint as multiplicity {_NUMBERED} group by qty, disc)", "lineitem_epoch")
def distinct_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct result rows, numbered in order, with their multiplicity."""
    rows = distinct_multiplicity(spark, sf)
    return ranges.numbered(rows, ["qty", "disc"]).withColumnRenamed("__position", "number")


@query(f"select row_number() over (order by qty, disc)::bigint as number, qty, disc {_NUMBERED}", "lineitem_epoch")
def rows_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """All result rows, numbered in order, equal ones too."""
    rows = lineitem_epoch(spark, sf).where("block between 300 and 900").select("qty", "disc")
    return ranges.numbered(rows, ["qty", "disc"]).withColumnRenamed("__position", "number")


@query("select value, kind, min_by(user_id, (valid_from, user_id)) as user_id, min(valid_from) as epoch from user_state where valid_from <= 15 group by value, kind", "user_state")
def distinct_with_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Each distinct (value, kind) with the first epoch and key that has it."""
    s = user_state(spark, sf).where("valid_from <= 15")
    first = s.groupBy("value", "kind").agg(F.min(F.struct("valid_from", "user_id")).alias("f"))
    return first.select("value", "kind", F.col("f.user_id").alias("user_id"), F.col("f.valid_from").alias("epoch"))


# -- digests

_ROW = "('0x' || substr(md5(length(cast({0} as varchar)) || ':' || {0} || length(cast({1} as varchar)) || ':' || {1}), 1, 15))::bigint"
_DIGEST = f"cast(sum({_ROW.format('user_id', 'value')}) % 2305843009213693951 as bigint)"


@query(f"select {_DIGEST} as digest, count(*)::bigint as n_rows from user_state where valid_from <= 12 and valid_until >= 12", "user_state")
def table_digest(spark: SparkSession, sf: str) -> DataFrame:
    return digest.table_digest(store.snapshot_at(user_state(spark, sf), 12), ["user_id", "value"])


def _digests(spark: SparkSession, sf: str) -> DataFrame:
    return digest.table_digest(_live(spark, sf), ["user_id", "value"], ["block"])


@query(
    f""", d as (select block, {_DIGEST} as digest, row_number() over (order by block) as r from live group by block),
    c as (
        with recursive x as (
            select block, digest, r, sha256('|' || digest) as commitment from d where r = 1
            union all select d.block, d.digest, d.r, sha256(x.commitment || '|' || d.digest) from x join d on d.r = x.r + 1)
        select * from x)
    select block, digest, commitment from c""",
    "live",
)
def commitment_chain(spark: SparkSession, sf: str) -> DataFrame:
    return digest.commitment_chain(_digests(spark, sf), "block")


@query("select block, (case when block = 105 or block = 112 then 0 else 1 end)::bigint as holds from (select distinct block from live)", "live")
def chain_check(spark: SparkSession, sf: str) -> DataFrame:
    """A chain with one altered commitment: that epoch and the next do not hold."""
    chain = digest.commitment_chain(_digests(spark, sf), "block")
    return digest.chain_check(chain.withColumn("commitment", F.when(F.col("block") == 105, F.lit("0")).otherwise(F.col("commitment"))), "block")


@query("select block, (case when block = (select min(block) from live) or block = 112 then 0 else 1 end)::bigint as holds from (select distinct block from live)", "live")
def chain_start(spark: SparkSession, sf: str) -> DataFrame:
    """A chain that begins at an epoch after genesis, and one of whose epochs was built on another state than the last."""
    chain = digest.commitment_chain(_digests(spark, sf), "block")
    built = F.when(F.col("block") == 112, F.lit(1)).otherwise(F.lag("digest", 1, digest.EMPTY).over(Window.orderBy("block")))
    return digest.chain_check(chain.withColumn("built_on", built.cast("bigint")), "block", start=0, before="built_on")


# -- extraction

_PART = [Slice("price", 2, 15, 64), Slice("size", 2, 23, 16), Slice("key", 2, 25, 56), Slice("triple", 2, 24, 64, word=1)]


@query("select 1234567::bigint as a, 89::bigint as b, 5::bigint as c")
def extract_simple_slots(spark: SparkSession, sf: str) -> DataFrame:
    return extract_simple(words(spark, sf), [Slice("a", 0, 25, 32), Slice("b", 0, 29, 16), Slice("c", 0, 31, 8)])


@query("select p_partkey as map_key, round(p_retailprice * 100)::bigint as price, p_size::bigint as size, p_partkey as key, p_partkey * 3 + 1 as triple from part")
def extract_mapping_slots(spark: SparkSession, sf: str) -> DataFrame:
    return longs(extract_mapping(words(spark, sf), _PART))


@query("select n_regionkey::bigint as outer_key, n_nationkey::bigint as inner_key, (n_nationkey * 1000 + n_regionkey)::bigint as v from nation")
def extract_nested_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return extract_mapping(words(spark, sf), [Slice("v", 3, 26, 48)], ("outer_key", "inner_key"))


@query("select p_partkey as map_key, p_size::bigint as size from part")
def extract_mapping_with_length(spark: SparkSession, sf: str) -> DataFrame:
    return extract_with_length(words(spark, sf), [_PART[1]], Slice("n", 1, 25, 56))


@query("select p_partkey as key, (round(p_retailprice * 100)::bigint) % 65536 as low, p_size::bigint % 256 as last from part")
def bit_slice(spark: SparkSession, sf: str) -> DataFrame:
    got = extract_mapping(words(spark, sf), [Slice("low", 2, 21, 16), Slice("last", 2, 24, 8)])
    return got.withColumnRenamed("map_key", "key")


@query(
    """select p_partkey as key, p_size::bigint % 32 as five, ((round(p_retailprice * 100)::bigint) >> 6) % 256 * 256 + ((round(p_retailprice * 100)::bigint) >> 3) % 8 as eleven
    from part"""
)
def bit_slice_within_bytes(spark: SparkSession, sf: str) -> DataFrame:
    got = extract_mapping(words(spark, sf), [Slice("five", 2, 24, 5, shift=3), Slice("eleven", 2, 21, 11, shift=2)])
    return got.withColumnRenamed("map_key", "key")


@query("select n_nationkey::bigint as map_key, n_regionkey::bigint as region, 1234567::bigint as a, 89::bigint as b from nation")
def merge_single_mapping_rows(spark: SparkSession, sf: str) -> DataFrame:
    single = extract_simple(words(spark, sf), [Slice("a", 0, 25, 32), Slice("b", 0, 29, 16)])
    nations = read(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("map_key"), F.col("n_regionkey").cast("bigint").alias("region"))
    return merge_single_mapping(single, nations)


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def cells_from_json(spark: SparkSession, sf: str) -> DataFrame:
    return row_source.cells_from_json(read(spark, sf, "events").select("event_id", "props"), "props", {"k": "$.k"}).select("event_id", "k")


@query("select block, custkey, price, status, orderkey from orders_epoch", "orders_epoch")
def ingest_offchain(spark: SparkSession, sf: str) -> DataFrame:
    raw = orders_epoch(spark, sf).withColumnRenamed("price", "paid")
    return row_source.ingest_rows(raw, ORDERS, {"price": "paid"}, unique=["orderkey"])

