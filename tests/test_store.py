"""Versions, commits, keys, lineage, extraction and digests."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.errors import EpochError, IngestError, InvalidName, KeyStateError
from tidemark.catalog import table_def
from tidemark.operators import digest, keys, lineage, ranges, scan, show, store
from tidemark.operators.epochs import EpochStore
from tidemark.operators.value import ValueStore
from tidemark.sources.rows import cells_from_json, ingest_rows
from tidemark.sources.words import Slice, extract_mapping, extract_simple, extract_with_length, key_id, merge_single_mapping, pack, slice_id, words_table
from tidemark.streaming.commits import commit_stream


def ops(spark, *rows):
    return spark.createDataFrame([(op, k, key, value) for k, (op, key, value) in enumerate(rows)], "op string, seq int, id bigint, v bigint")


def live(frame):
    return sorted((r.id, r.v) for r in frame.collect())


def test_commits_and_rollback(spark, tmp_path):
    s = EpochStore(spark, str(tmp_path / "store"), {"t": ["id"]}, "create", first=9)
    s.commit(10, {"t": ops(spark, ("insert", 0, 1), ("insert", 1, 1))})
    s.commit(15, {"t": ops(spark, ("update", 1, 2), ("insert", 2, 2), ("delete", 0, None))})
    s.commit(16, {})
    s.commit(30, {"t": ops(spark, ("insert", 0, 5))})
    assert live(s.at("t", 10)) == live(s.at("t", 14)) == [(0, 1), (1, 1)]
    assert live(s.at("t", 15)) == live(s.at("t", 16)) == [(1, 2), (2, 2)]
    assert live(s.at("t", 30)) == [(0, 5), (1, 2), (2, 2)]
    with pytest.raises(EpochError):
        s.commit(30, {})
    with pytest.raises(EpochError):
        s.at("t", 31)
    with pytest.raises(KeyStateError):
        s.commit(31, {"t": ops(spark, ("insert", 0, 5))})
    with pytest.raises(KeyStateError):
        s.commit(31, {"t": ops(spark, ("delete", 77, None))})
    with pytest.raises(KeyStateError):
        s.commit(31, {"t": ops(spark, ("delete", 0, None), ("update", 0, 1))})
    s.rollback(30)
    s.rollback(15)
    assert live(s.at("t", 15)) == [(1, 2), (2, 2)]
    for epoch in (8, 30):
        with pytest.raises(EpochError):
            s.rollback(epoch)
    s.commit(31, {"t": ops(spark, ("insert", 9, 9), ("update", 9, 8))})
    assert live(s.at("t", 31)) == [(1, 2), (2, 2), (9, 8)]
    with pytest.raises(EpochError):
        EpochStore(spark, str(tmp_path / "store"), {"t": ["id"]}, "create")
    with pytest.raises(EpochError):
        EpochStore(spark, str(tmp_path / "none"), {"t": ["id"]})
    again = EpochStore(spark, str(tmp_path / "store"), {"t": ["id"]})
    assert [e.user for e in again.entries()] == [9, 10, 15, 31]
    assert again.compact("t", str(tmp_path / "compact")).count() == again.versions("t").count()
    assert EpochStore(spark, str(tmp_path / "store"), {"t": ["id"]}, "reset").versions("t") is None


def test_two_tables_in_one_commit(spark, tmp_path):
    s = EpochStore(spark, str(tmp_path / "store"), {"a": ["id"], "b": ["id"]}, "create")
    s.commit(1, {"a": ops(spark, ("insert", 1, 1)), "b": ops(spark, ("insert", 2, 2))})
    assert len(s.entries()) == 2
    assert live(s.at("a", 1)) == [(1, 1)] and live(s.at("b", 1)) == [(2, 2)]


def test_thousand_inserts_then_deletes(spark):
    versions = spark.createDataFrame([], "id bigint, v bigint, valid_from bigint, valid_until bigint")
    batch = spark.range(1000).select(F.lit("insert").alias("op"), F.lit(0).alias("seq"), "id", (F.col("id") * 10).alias("v"))
    versions = store.apply_batch(versions, batch, ["id"], 1)
    r = random.Random(5)
    gone = r.sample(range(1000), 100)
    versions = store.apply_batch(versions, ops(spark, *[("delete", k, None) for k in gone]), ["id"], 2)
    assert store.size_at(versions, 1).first()[0] == 1000
    assert live(store.snapshot_at(versions, 2)) == [(k, 10 * k) for k in range(1000) if k not in gone]
    assert store.contains_at(versions, {"id": gone[0]}, 1) and not store.contains_at(versions, {"id": gone[0]}, 2)
    assert store.any_key_at(versions, ["id"], 2).first()[0] not in gone
    assert store.born_at(versions, 2).count() == 0


def test_stream_commits(spark, tmp_path):
    source = str(tmp_path / "changes")
    ops(spark, ("insert", 1, 1), ("insert", 2, 2)).coalesce(1).write.parquet(source)
    s = EpochStore(spark, str(tmp_path / "store"), {"t": ["id"]}, "create")
    read = lambda: spark.readStream.schema("op string, seq int, id bigint, v bigint").parquet(source)
    commit_stream(read(), s, "t", str(tmp_path / "check")).awaitTermination()
    assert live(s.at("t", 1)) == [(1, 1), (2, 2)]


def test_a_stream_beside_other_commits(spark, tmp_path):
    """Each micro-batch is one epoch, whatever is committed in between and wherever the run broke off."""
    source, check = tmp_path / "changes", str(tmp_path / "check")
    s = EpochStore(spark, str(tmp_path / "store"), {"t": ["id"], "u": ["id"]}, "create")

    def arrive(*rows):
        ops(spark, *rows).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        read = spark.readStream.schema("op string, seq int, id bigint, v bigint").option("maxFilesPerTrigger", 1).parquet(str(source))
        commit_stream(read, EpochStore(spark, str(tmp_path / "store"), s.tables), "t", check).awaitTermination()

    arrive(("insert", 1, 1))
    run()
    s.commit(s.current().user + 1, {"u": ops(spark, ("insert", 7, 7))})
    arrive(("insert", 2, 2))
    arrive(("insert", 3, 3))
    run()
    assert live(s.at("t", s.current().user)) == [(1, 1), (2, 2), (3, 3)]
    # The last batch was published, but the stream's own note of it was lost.
    last = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for path in (last, last.with_name(f".{last.name}.crc")):
        path.unlink(missing_ok=True)
    before = s.entries()
    run()
    assert s.entries() == before and len({e.source for e in before if e.source}) == 3


def test_racing_commits(spark, tmp_path, monkeypatch):
    """Of two writers that saw the same store one is refused, and what the other has published stays as it is."""
    one, two = (EpochStore(spark, str(tmp_path / "store"), {"t": ["id"]}, mode, 0) for mode in ("create", "open"))
    stale = two.current()
    one.commit(1, {"t": ops(spark, ("insert", 1, 1))}, checked=False)
    monkeypatch.setattr(two, "current", lambda: stale)
    with pytest.raises(EpochError):
        two.commit(1, {"t": ops(spark, ("insert", 2, 2))}, checked=False)
    assert live(one.at("t", 1)) == [(1, 1)]
    assert len(list((tmp_path / "store" / "t").iterdir())) == 1 and not list((tmp_path / "store" / "manifest").glob("*.draft"))


def test_commits_after_a_compaction(spark, tmp_path):
    s = EpochStore(spark, str(tmp_path / "store"), {"t": ["id"]}, "create")
    s.commit(1, {"t": ops(spark, ("insert", 1, 1), ("insert", 2, 2))})
    s.commit(2, {"t": ops(spark, ("update", 1, 5), ("delete", 2, None))})
    plain = lambda: sorted(tuple(r) for r in s.versions("t").select("id", "v", "valid_from", "valid_until").collect())
    before = plain()
    assert s.compact("t").count() == 3 and plain() == before
    s.commit(3, {"t": ops(spark, ("insert", 2, 8), ("update", 1, 6))})
    read = s.versions("t", spark.createDataFrame([(1,)], "id bigint")).inputFiles()
    assert read and all("/versions/t/" in f or "epoch-000000000003" in f for f in read)
    assert [live(s.at("t", e)) for e in (1, 2, 3)] == [[(1, 1), (2, 2)], [(1, 5)], [(1, 6), (2, 8)]]
    with pytest.raises(KeyStateError):
        s.commit(4, {"t": ops(spark, ("insert", 2, 9))})
    s.rollback(2)
    assert plain() == before and live(s.at("t", 2)) == [(1, 5)]
    s.rollback(1)  # the compaction reaches beyond it and goes
    assert live(s.at("t", 1)) == [(1, 1), (2, 2)] and not list((tmp_path / "store" / "compacted" / "t").glob("*.json"))


def test_brackets_and_neighbours(spark):
    v = spark.createDataFrame([(1, 10, 1, 9), (2, 20, 1, 9), (3, 20, 1, 9), (4, 30, 1, 9), (5, 25, 5, 9)], "id bigint, s bigint, valid_from bigint, valid_until bigint")
    got = {(r.side, r.s, r.id) for r in keys.bracket_secondary(v, 2, ["id"], "s", 25, 28).collect()}
    assert got == {(-1, 20, 2), (1, 30, 4)}
    assert keys.bracket_secondary(v, 2, ["id"], "s", 0, keys.TOP).count() == 0
    assert {r.side for r in keys.bracket_secondary(v, 2, ["id"], "s", 5, 29).collect()} == {1}
    m = spark.createDataFrame([(10, 1), (20, 2), (35, 3)], "user_epoch bigint, incremental_epoch bigint")
    assert tuple(keys.bracket_epochs(m, 15, 34).first()) == (10, 35)
    assert tuple(keys.bracket_epochs(m, 0, 34).first()) == (None, 35)


def test_expansion_forms_agree(spark, monkeypatch):
    r = random.Random(2)
    v = spark.createDataFrame([(k, f, f + r.randrange(8)) for k, f in enumerate(r.randrange(1, 30) for _ in range(60))], "id bigint, valid_from bigint, valid_until bigint")
    m = spark.createDataFrame([(3 * k, k) for k in range(1, 41)], "user_epoch bigint, incremental_epoch bigint")
    one = sorted(tuple(x) for x in scan.epoch_range(v, m, 20, 70).select("id", "epoch").collect())
    monkeypatch.setattr(scan, "BROADCAST_EPOCHS", 0)
    two = sorted(tuple(x) for x in scan.epoch_range(v, m, 20, 70).select("id", "epoch").collect())
    three = sorted(tuple(x) for x in scan.keys_in_range(v, m, 20, 70, ["id"]).collect())
    assert one == two == three and one
    assert scan.weighted(v, m, 20, 70).agg(F.sum("n")).first()[0] == len(one)


def test_witness(spark):
    v = spark.createDataFrame([(1, 10, 1, 9), (2, 40, 1, 9)], "id bigint, s bigint, valid_from bigint, valid_until bigint")
    ask = lambda low, high, e=2: [(r.side, r.id) for r in keys.witness(v, e, ["id"], "s", low, high).collect()]
    assert ask(20, 30) == [(-1, 1)] and ask(0, 5) == [(1, 1)] and ask(41, 50) == [(-1, 2)] and ask(5, 15) == [] and ask(20, 30, 99) == []


def test_single_value(spark, tmp_path):
    s = ValueStore(spark, str(tmp_path / "value"), "bigint", "create")
    assert s.fetch() is None
    with pytest.raises(KeyStateError):
        s.update(1, 5)
    s.store(1, 5)
    s.update(4, 6)
    s.store(7, 8)
    assert [s.fetch_at(e) for e in (0, 1, 3, 4, 7)] == [None, 5, 5, 6, 8]
    s.rollback(4)
    assert s.fetch() == 6


def test_show(spark, tmp_path):
    s = EpochStore(spark, str(tmp_path / "store"), {"t": ["id"]}, "create")
    s.commit(1, {"t": ops(spark, *[("insert", k, 100 - k) for k in range(7)])})
    rows = {r.position: (r.id, r.parent, r.left_child, r.right_child, r.depth) for r in show.rows_at(s, "t", 1, "v").collect()}
    assert rows[4] == (3, None, 2, 6, 0) and rows[1] == (6, 2, None, None, 2) and rows[6] == (1, 4, 5, 7, 1)
    assert {r.place: r.position for r in show.around(s, "t", 1, "v", 2).collect()} == {"row": 2, "parent": 4, "left": 1, "right": 3}


def test_tree_shape():
    for n in range(1, 70):
        for k in range(1, n + 1):
            up = lineage.parent(k, n)
            assert (up is None) == (k == 1 << (n.bit_length() - 1))
            if up is not None:
                assert k in lineage.children(up, n)
        reached, front = set(), [1 << (n.bit_length() - 1)]
        while front:
            k = front.pop()
            reached.add(k)
            front += [c for c in lineage.children(k, n) if c]
        assert reached == set(range(1, n + 1))


def test_lineage_against_walk(spark):
    rows = [(e, k, (k * 37) % 101) for e, n in ((1, 23), (2, 1), (3, 64)) for k in range(n)]
    placed = lineage.positions(spark.createDataFrame(rows, "e bigint, id bigint, s bigint"), "e", "s", ["id"])
    got = {(r.e, r.id): r.is_core for r in lineage.wide_lineage(placed, F.col("id") % 9 == 4, "e", ["id"]).collect()}
    want = {}
    for e in (1, 2, 3):
        order = sorted((s, k) for x, k, s in rows if x == e)
        n, at = len(order), {p: k for p, (_, k) in enumerate(order, 1)}
        path, core = set(), {p for p, k in at.items() if k % 9 == 4}
        for p in core:
            while p:
                path.add(p)
                p = lineage.parent(p, n)
        front = set(path)
        for _ in range(2):
            front = {c for p in front for c in lineage.children(p, n) if c}
            path |= front
        want |= {(e, at[p]): int(p in core) for p in path}
    assert got == want


def test_merge_nodes():
    assert keys.merge_nodes(1, 3) == [(0, 0)]
    assert keys.merge_nodes(5, 3) == [(0, 0), (1, 0), (1, 1), *[(2, k) for k in range(5)]]


def test_words(spark):
    one = spark.range(1)
    none = F.lit(None).cast("bigint")
    w = one.select(F.lit(0).alias("slot"), none.alias("key1"), none.alias("key2"), F.lit(0).alias("word_index"), pack((F.lit(2), 8), (F.lit(513), 8), (F.lit(7), 1)).alias("word"))
    for k, size in ((5, 3), (6, 4)):
        w = w.unionByName(one.select(F.lit(1).alias("slot"), F.lit(k).cast("bigint").alias("key1"), none.alias("key2"), F.lit(0).alias("word_index"), pack((F.lit(size), 32)).alias("word")))
    w = w.unionByName(one.select(F.lit(2).alias("slot"), none.alias("key1"), none.alias("key2"), F.lit(0).alias("word_index"), pack((F.lit(3), 32)).alias("word")))
    got = extract_simple(w, [Slice("a", 0, 23, 64), Slice("b", 0, 31, 8), Slice("c", 0, 15, 120), Slice("d", 0, 0, 256), Slice("e", 9)]).first()
    assert (got.a, got.b, int(got.c), int.from_bytes(bytes(got.d), "big"), got.e) == (513, 7, (2 << 56) + 2, (2 << 72) + (513 << 8) + 7, None)
    rows = extract_mapping(w, [Slice("size", 1, 25, 56)])
    assert sorted(map(tuple, rows.collect())) == [(5, 3), (6, 4)]
    with pytest.raises(IngestError):
        extract_with_length(w, [Slice("size", 1, 25, 56)], Slice("n", 2, 25, 56))
    assert sorted(map(tuple, merge_single_mapping(spark.createDataFrame([(1,)], "x int"), rows).collect())) == [(5, 3, 1), (6, 4, 1)]
    with pytest.raises(IngestError):
        merge_single_mapping(rows, rows)
    for bad in ((0, 0), (30, 24), (-1, 8), (31, 8, 0, 1), (0, 8, 0, 8), (0, 257)):
        with pytest.raises(IngestError):
            Slice("x", 0, *bad)


def test_slices_within_bytes(spark):
    word = bytes((37 * k + 11) % 256 for k in range(32))
    bits = "".join(f"{b:08b}" for b in word)
    w = spark.createDataFrame([(0, None, None, 0, word)], "slot int, key1 bigint, key2 bigint, word_index int, word binary")
    cases = [(0, 11, 0), (3, 5, 3), (24, 61, 3), (7, 1, 7), (1, 56, 4), (2, 119, 1), (0, 249, 7), (31, 3, 5), (7, 190, 6)]
    got = extract_simple(w, [Slice(f"c{k}", 0, o, n, shift=s) for k, (o, n, s) in enumerate(cases)]).first()
    for (o, n, s), value in zip(cases, got, strict=True):
        part = bits[8 * o + s :][:n]
        want = int.from_bytes(bytes(int(part[k : k + 8], 2) for k in range(0, n, 8)), "big")
        assert (int.from_bytes(bytes(value), "big") if isinstance(value, bytes | bytearray) else int(value)) == want, (o, n, s)
    odd = spark.createDataFrame([(0, None, None, 0, bytes([0b10110101, 0b10100000] + [0] * 30))], w.schema)
    assert extract_simple(odd, [Slice("x", 0, 0, 11)]).first()[0] == 0xB505


def test_ids_of_slices():
    a = Slice("a", 1, 4, 32)
    same = slice_id(Slice("other_name", 1, 4, 32), "0xAB", 1)
    assert slice_id(a, "0xab", 1) == same and 0 < same < 1 << 64
    others = [slice_id(x, c, n, e) for x, c, n, e in ((a, "0xab", 2, ""), (a, "0xac", 1, ""), (a, "0xab", 1, "x"), (Slice("a", 1, 5, 32), "0xab", 1, ""), (Slice("a", 1, 4, 32, shift=1), "0xab", 1, ""))]
    keys_ = [key_id(1, p, "0xab", 1) for p in ("key", "outer", "inner")]
    assert len({same, *others, *keys_}) == 9
    t = words_table("t", "block", [a, Slice("b", 1, 8, 32)], ["k1", "k2"], "b", "0xab", 1)
    assert t.names == ["block", "k1", "k2", "a", "b"] and t.secondary.name == "b" and t.columns[3].id == same
    for bad in (([a, Slice("c", 2)], ["k"]), ([a], ["k"] * 3), ([a], [], "none")):
        with pytest.raises(IngestError):
            words_table("t", "block", *bad)
    with pytest.raises(IngestError):
        key_id(1, "middle")
    with pytest.raises(InvalidName):
        words_table("t", "block", [a, Slice("b", 1, 4, 32)])  # the same bits twice


@pytest.fixture
def many_ranges(spark):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    yield
    spark.conf.unset(setting)


def test_places_over_ranges(spark, many_ranges):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), rng.choice([7, 7, rng.randrange(9), None]), k) for k in range(700)] + [(None, 1, 900), (9, 2, 901)]
    frame = spark.createDataFrame(rows, "e bigint, s bigint, id bigint").repartition(5)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    groups = {e: sorted((r for r in rows if r[0] == e), key=order) for e in {r[0] for r in rows}}
    o = ranges.ordered(frame, ["e", "s", "id"])
    assert o.where("e = 1").select(ranges.RANGE).distinct().count() > 1  # one epoch is over several ranges
    got = {r.id: (r["__position"], r["__size"]) for r in ranges.placed(frame, "e", ["s", "id"]).collect()}
    assert got == {r[2]: (k, len(g)) for g in groups.values() for k, r in enumerate(g, 1)}
    near = {r.id: (r.before_id, r.after_id) for r in keys.row_neighbours(frame, "e", "s", ["id"]).collect()}
    ids = {e: [None, *[r[2] for r in g], None] for e, g in groups.items()}
    assert near == {x[k]: (x[k - 1], x[k + 1]) for x in ids.values() for k in range(1, len(x) - 1)}
    plan = sorted((r.chunk, r.n_rows) for r in keys.chunk_plan(frame, "e", "s", ["id"], 100).collect())
    assert plan == [(k, 100) for k in range(7)] + [(7, 2)]
    assert ranges.numbered(frame.limit(0), ["id"]).count() == ranges.placed(frame.limit(0), "e", ["id"]).count() == 0


def test_rows_and_cells(spark):
    t = table_def("t", "block", "a")
    good = spark.createDataFrame([(1, 2, "x"), (1, 3, "y")], "block int, a int, more string")
    assert ingest_rows(good, t).columns == ["block", "a"]
    for bad in ([], [(1, None)], [(1, -2)]):
        with pytest.raises(IngestError):
            ingest_rows(spark.createDataFrame(bad, "block int, a int"), t)
    with pytest.raises(IngestError):
        ingest_rows(good, t, unique=["block"])
    with pytest.raises(IngestError):
        ingest_rows(good.drop("a"), t)
    assert [r.k for r in cells_from_json(spark.createDataFrame([('{"k": 5}',), (None,)], "p string"), "p", {"k": "$.k"}).collect()] == [5, None]


def test_merge_cells(spark):
    old = spark.createDataFrame([(1, 10, 20), (2, 30, 40)], "id bigint, a bigint, b bigint")
    new = spark.createDataFrame([(1, None, 7, 8)], "id bigint, a bigint, b bigint, unknown bigint")
    assert sorted(map(tuple, store.merge_cells(old, new, ["id"]).collect())) == [(1, 10, 7), (2, 30, 40)]


def test_digests(spark):
    rows = [(k, k * k, k % 4) for k in range(50)]
    a = spark.createDataFrame(rows, "x bigint, y bigint, e bigint")
    b = spark.createDataFrame(rows[::-1], "x bigint, y bigint, e bigint").repartition(3)
    c = spark.createDataFrame([*rows[:-1], rows[0]], "x bigint, y bigint, e bigint")
    d = lambda f: digest.table_digest(f, ["x", "y"]).first()[0]
    assert d(a) == d(b) != d(c)
    chain = digest.commitment_chain(digest.table_digest(a, ["x", "y"], ["e"]), "e")
    assert chain.count() == 4 and {r.holds for r in digest.chain_check(chain, "e").collect()} == {1}
    whole = chain.withColumn("built_on", F.lag("digest", 1, digest.EMPTY).over(Window.orderBy("e")))
    holds = lambda f, **how: [r.holds for r in digest.chain_check(f, "e", **how).orderBy("e").collect()]
    assert holds(whole, start=0, before="built_on") == [1] * 4
    assert holds(whole, start=1) == holds(whole.withColumn("built_on", F.coalesce(F.nullif("built_on", F.lit(digest.EMPTY)), F.lit(3))), before="built_on") == [0, 1, 1, 1]
    assert digest.commitment_chain(digest.table_digest(a.limit(0), ["x"], ["e"]), "e").count() == 0
