"""Operators on documents: against brute force, and with nulls, empty and very long texts, ties, repeated rows, no rows and clashing names."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import encoding, frames, language, mixing, packing, quality, shingles, simhash, token_counts, token_store
from tidemark.llm.components import components
from tidemark.llm.frames import fresh_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, score double, key string"
LONG = "".join(f"word{k % 977} der\tdie " for k in range(30_000))
ODD = "It's I'LL don't <|endoftext|>x <|startoftext|> É́a é İstanbul ΑΣ ½² ª\x1cb c\x85d\xa0e 漢字かな 😀😀  x ǅ ß ﬁ a_b 12345 <|end  "


def texts():
    r = random.Random(4)
    words = [f"{a}{b}" for a in ("the", "Der", "la", "él", "on") for b in ("", "x", "ing", "keit", "ción", "!", ".")]
    made = [" ".join(r.choice(words) for _ in range(r.randrange(1, 90))) for _ in range(40)]
    return [*made, made[0], made[1] + " tail", made[1], None, "", " \t\n", "a", "$$$ 123", "b c", LONG, ODD, made[2].upper()]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ("en", "de", None)[k % 3], ("s1", "s2", None, "s1")[k % 4], 0, 1, 2.0, "k") for k, t in enumerate(texts())]
    rows += [rows[3], rows[3], (None, "the null id", None, None, 0, 1, 2.0, "k"), (None, None, None, None, 0, 1, 2.0, "k")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(encoding.default_vocabulary())


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


# -- encoding


def test_word_encoder_is_the_library(tokenizer):
    import pyarrow as pa

    some = texts()
    for most in (encoding.MAX_WORDS, 3):
        e = encoding.WordEncoder(encoding.default_vocabulary(), most)
        for part in (some[:20], some[20:], some):
            ids, offsets = e.encode(pa.array(part, pa.string()))
            for t, a, b in zip(part, offsets[:-1], offsets[1:], strict=True):
                assert ids[a:b].tolist() == ids_of(tokenizer, t).tolist()
    assert e.encode(pa.array([], pa.string()))[1].tolist() == [0]


def test_tables_are_empty_between_tasks(tokenizer):
    import pyarrow as pa

    path = encoding.default_vocabulary()
    with pytest.raises(KeyError), encoding.WordEncoder.lent(path) as e:
        e.encode(pa.array(texts(), pa.string()))
        assert len(e.words) > 100 and len(e.pieces) > 20
        raise KeyError
    assert not e.words and len(e.pieces) == 1 and len(e.pool) == 0
    with encoding.WordEncoder.lent(path) as again:
        assert again is e and again.encode(pa.array(["a b"]))[0].tolist() == ids_of(tokenizer, "a b").tolist()


def test_another_vocabulary_is_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="not known to split"):
        encoding.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


# -- packing


def test_packing(spark, docs, tokenizer):
    got = packing.pack_documents(docs, with_ids=True, capacity=64).collect()
    windows = {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        windows.setdefault(r.sequence_id, []).append(r)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 64 or at & (at - 1) == 0
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens, np.frombuffer(r.ids, "<u4").tolist()))
    for doc, text in pairs(docs):
        if doc is None or doc == 3:
            continue
        ids, at = [], 0
        for start, length, total, part in sorted(pieces[doc]):
            assert start == at
            at, ids = at + length, ids + part
        assert ids == ids_of(tokenizer, text).tolist() and total == len(ids)
    assert sum(x[1] for x in pieces[3]) == 3 * len(ids_of(tokenizer, texts()[3]))
    assert packing.pack_documents(docs.limit(0)).collect() == []


def test_sum_of_squares_choice():
    p, r = packing.SumOfSquares(16), random.Random(1)
    counts = {}
    for k in range(300):
        size = r.randrange(1, 16)

        def cost(level):
            after = dict(counts)
            if level:
                after[level] -= 1
            if level + size < 16:
                after[level + size] = after.get(level + size, 0) + 1
            return sum(v * v for v in after.values())

        choices = [0, *[h for h in counts if counts[h] and h + size <= 16]]
        level = p.level_for(size)
        assert cost(level) == min(map(cost, choices)) and level == max(h for h in choices if cost(h) == cost(level))
        p.place((k, 0, np.zeros(size, np.uint32), size))
        if level:
            counts[level] -= 1
        if level + size < 16:
            counts[level + size] = counts.get(level + size, 0) + 1


# -- token store


def test_chunks_stay_out_of_python_behind_the_shuffle(spark, monkeypatch):
    """A chunk that several tasks send is stored once; its address alone is looked at, on the far side of the shuffle."""
    plans, write = [], type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, *a, **b: (plans.append(self._df._jdf.queryExecution().optimizedPlan().toString()), write(self, *a, **b))[1])
    folder = frames.fresh_path(spark, "sent-once")
    text = " ".join(f"w{k}" for k in range(3000))
    token_store.write_store(spark.createDataFrame([(k, text) for k in range(8)], "doc_id bigint, text string").repartition(4), folder)
    names = [bytes(r.chunk_id) for r in token_store.chunk_rows(spark, folder).collect()]
    assert len(names) == len(set(names)) > 1
    assert plans[0].count("MapInArrow") == 1 and plans[0].index("first(") < plans[0].index("Repartition") < plans[0].index("MapInArrow")
    assert len({r.ids_crc32 for r in token_store.read_digests(spark, folder).collect()}) == 1


def test_token_store(spark, docs, tokenizer):
    folder = fresh_path(spark, "test-store")
    token_store.write_store(docs, folder)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_digests(spark, folder).collect()]
    want = sorted([(d, ids_of(tokenizer, t)) for d, t in pairs(docs)], key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
    start, rows = 0, []
    for doc, ids in want:
        rows.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted(got, key=key) == rows
    chunks = [bytes(r.chunk_id) for r in token_store.chunk_rows(spark, folder).collect()]
    assert len(chunks) == len(set(chunks))
    top = [r for r in spark.read.parquet(f"{folder}/manifest").collect() if r.shard == -1][0]
    assert (top.docs, top.tokens) == (len(rows), start)
    recipes = token_store.recipe_rows(spark, folder).where("root is null").collect()
    for shard in {r.shard for r in recipes}:
        m = token_store.MerkleRoot()
        for r in sorted((r for r in recipes if r.shard == shard), key=lambda r: r.before):
            m.add(token_store.leaf_of(r.doc_id, r.n_tokens, [bytes(x) for x in r.chunk_ids]))
        assert m.root() == bytes(next(r.root for r in spark.read.parquet(f"{folder}/manifest").collect() if r.shard == shard))


def test_copies_share_chunks(spark):
    long = " ".join(f"w{k}" for k in range(4000))
    folder = fresh_path(spark, "test-store")
    token_store.write_store(spark.createDataFrame([(k, ("intro " * k) + long) for k in range(20)], "doc_id bigint, text string"), folder)
    stored = sum(len(r.data) for r in token_store.chunk_rows(spark, folder).collect()) / 2
    total = sum(r.n_tokens for r in token_store.read_digests(spark, folder).collect())
    assert stored < total / 5


def test_damage_is_found(spark, docs):
    folder, other = fresh_path(spark, "test-store"), fresh_path(spark, "test-store")
    token_store.write_store(docs, folder)
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{folder}/{part}").write.parquet(f"{other}/{part}")
    packs = spark.read.parquet(f"{folder}/packs")
    packs.withColumn("data", F.concat("data", F.lit(bytearray(b"\1\0")))).write.parquet(f"{other}/packs")
    with pytest.raises(Exception, match="is damaged"):
        token_store.read_digests(spark, other).collect()


def test_lost_and_changed_recipes_are_found(spark, docs):
    folder = fresh_path(spark, "store-test")
    token_store.write_store(docs, folder)
    rows = token_store.recipe_rows(spark, folder)
    lost = rows.where("root is not null or doc_id is null or doc_id <> 5")
    swapped = rows.withColumn("chunk_ids", F.when(F.col("doc_id") == 5, F.transform("chunk_ids", lambda x: F.lit(b"0123456789abcdef"))).otherwise(F.col("chunk_ids")))
    for k, changed in enumerate((lost, swapped)):
        other = f"{folder}-{k}"
        for part in ("packs", "manifest"):
            spark.read.parquet(f"{folder}/{part}").write.parquet(f"{other}/{part}")
        changed.write.parquet(f"{other}/recipes")
        with pytest.raises(Exception, match="manifest|damaged"):
            token_store.read_digests(spark, other).collect()


def test_ids_are_read_back(spark, docs, tokenizer):
    folder = fresh_path(spark, "test-store")
    token_store.write_store(docs, folder)
    got = sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in token_store.read_ids(spark, folder).collect())
    assert got == sorted((d is not None, d or 0, ids_of(tokenizer, t).tobytes()) for d, t in pairs(docs))
    starts = {r.start: r.n_tokens for r in token_store.read_ids(spark, folder).collect()}
    assert all(a + starts[a] in starts or a == max(starts) for a in starts)


def test_empty_store(spark, docs):
    assert token_store.store_and_read(docs.limit(0)).collect() == []


def test_crc_advance():
    r = random.Random(0)
    a = [r.randbytes(r.randrange(0, 50)) for _ in range(40)]
    b = [r.randbytes(r.randrange(0, 5000)) for _ in range(40)]
    moved = token_store.crc_advance(np.array([zlib.crc32(x) for x in a]), np.array([len(x) for x in b]))
    assert [int(m) ^ zlib.crc32(y) for m, y in zip(moved, b, strict=True)] == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]


# -- token counts


def brute_count(word, scores, byte_score):
    text, best = token_counts.MARK + word, [(0.0, 0)]
    for end in range(1, len(text) + 1):
        found = [(-(best[s][0] + scores[text[s:end]]), best[s][1] + 1) for s in range(end) if text[s:end] in scores]
        if text[end - 1] not in scores:
            n = len(text[end - 1].encode())
            found.append((-(best[end - 1][0] + n * byte_score), best[end - 1][1] + n))
        cost, n = min(found)
        best.append((-cost, n))
    return best[-1][1]


def test_token_counts(spark, docs):
    scores, byte_score = token_counts.unigram_scores(token_counts.default_vocabulary())
    memo = {}
    want = []
    for doc, text in pairs(docs):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want.append((doc, len(words), sum(memo.setdefault(w, None) or memo.__setitem__(w, brute_count(w, scores, byte_score)) or memo[w] for w in words)))
    got = [tuple(r) for r in token_counts.token_counts(docs).collect()]
    key = lambda x: (x[0] is None, x)
    assert sorted(got, key=lambda x: (x[0] is None, x[0] or 0, x[1])) == sorted(want, key=lambda x: (x[0] is None, x[0] or 0, x[1])) and key
    assert token_counts.token_counts(docs.limit(0)).collect() == []


def test_tries_of_any_size_agree_with_brute_force(monkeypatch):
    import pyarrow as pa

    scores, byte_score = token_counts.unigram_scores(token_counts.default_vocabulary())
    words = [w for t in texts() if t for w in re.findall(r"[^\x20\x09-\x0D]+", t)[:300]] + ["漢字" * 300, "ab" * 400]
    want = [brute_count(w, scores, byte_score) for w in words]
    for most, long in ((50, 256), (1_000_000, 256), (1_000_000, 3)):
        monkeypatch.setattr(token_counts, "MAX_WORD", long)
        trie = token_counts.CountingTrie(scores, byte_score, max_nodes=most)
        got = [n for k in range(0, len(words), 20) for n in trie.counts(pa.array(words[k : k + 20])).tolist()]
        assert got == want
    assert len(trie.best) < 40  # long pre-tokens are not inserted


# -- simhash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, near):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if near(values[a], values[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(values))]


def test_simhash(spark, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).where("doc_id is not null").collect()}
    rows = sorted({(d, t or "") for d, t in pairs(docs) if d is not None})
    prints = [slow_fingerprint(t) for _, t in rows] + [slow_fingerprint("the null id"), 0]
    root = roots(prints, lambda x, y: (x ^ y).bit_count() <= 2)
    for (doc, _), fp, r in zip(rows, prints, root, strict=False):
        assert got[doc] == (f"{fp:016x}", rows[r][0])
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_ball_links_are_all_links(spark):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1, 1 << 63]
    values = list(dict.fromkeys(base + [v ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for v in base for _ in range(3)] + [v ^ 7 for v in base]))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fingerprint bigint"))
    found = {frozenset((x.a, x.b)) for x in links.collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in (tuple(v % (1 << 64) for v in f) for f in found))
    comp = {x.node: x.component for x in components(links).collect()}
    root = roots(values, lambda x, y: (x ^ y).bit_count() <= 2)
    groups = {}
    for v, k in zip(signed, root, strict=True):
        groups.setdefault(k, set()).add(comp.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_keep_one(spark, docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    found = simhash.near_duplicates(docs)
    want = sorted(r.doc_id for r in found.where("doc_id = component_id").select("doc_id").distinct().collect())
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == want
    assert kept.where("doc_id is null").count() == 2


@pytest.mark.parametrize("similarity", [False, True])
def test_keep_one_of_odd_rows(spark, similarity):
    """Two texts under one id are two documents; repeated rows leave one; of copies under one id one stays, always the same; clashing names."""
    many = " ".join(f"word{k}" for k in range(50))
    rows = [(1, "alpha beta gamma", "s", 1.0, "a"), (1, "something else altogether here", "s", 1.0, "a"), (2, many, "s", 1.0, "a"), (2, many, "s", 1.0, "a"), (3, many, None, 2.0, "b"), (4, "copy", "x", 1.0, "a"), (4, "copy", "y", 1.0, "a"), (5, None, "s", None, None), (6, "", "s", None, None), (None, many, "s", 1.0, "a"), (None, many, "s", 1.0, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, __key string, __row double, node string")
    got = [simhash.keep_one(x, similarity=similarity).collect() for x in (df.repartition(3), df.repartition(2, "text"))]
    for kept in got:
        assert sorted((r.doc_id, r.text or "") for r in kept if r.doc_id) == [(1, "alpha beta gamma"), (1, "something else altogether here"), (2, many), (4, "copy"), (5, "")]
        assert len([r for r in kept if r.doc_id is None]) == 2
    assert {tuple(r) for r in got[0]} == {tuple(r) for r in got[1]}
    assert simhash.keep_one(df, similarity=similarity).columns == df.columns
    assert simhash.keep_one(df.limit(0), similarity=similarity).collect() == []


@pytest.mark.parametrize("small", [64, 2])
def test_near_copies_by_shingles(spark, docs, monkeypatch, small):
    """Against all pairs, both by single pairs and by blocks; copies with edits far beyond two bits are found."""
    monkeypatch.setattr(shingles, "SMALL", small)
    monkeypatch.setattr(shingles, "BLOCK", 7)
    r = random.Random(5)
    rows = [(d, t) for d, t in pairs(docs) if d is not None]
    for g in range(4):
        base = [f"w{r.randrange(900)}" for _ in range(150)]
        for k in range(12):
            copy = list(base)
            for at in r.sample(range(150), r.randrange(5)):
                copy[at] = f"x{r.randrange(900)}"
            rows.append((1000 + 20 * g + k, " ".join(copy)))
    df = spark.createDataFrame([*rows, (None, "the null id")], "doc_id bigint, text string").repartition(3)

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}

    ids, sets = [d for d, _ in rows], [plain(t) for _, t in rows]
    order = sorted(range(len(ids)), key=lambda k: ids[k])
    ids, sets = [ids[k] for k in order], [sets[k] for k in order]
    root = roots(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    assert {x.doc_id: x.component_id for x in shingles.near_duplicates(df).where("doc_id is not null").collect()} == {d: ids[k] for d, k in zip(ids, root, strict=True)}
    bits = {d: simhash.fingerprint((t or "").encode()) for d, t in rows}
    assert any((bits[d] ^ bits[ids[k]]).bit_count() > 2 for d, k in zip(ids, root, strict=True))
    kept = simhash.keep_one(df, similarity=True)
    assert sorted(x.doc_id for x in kept.where("doc_id is not null").collect()) == sorted({ids[k] for k in root}) and kept.where("doc_id is null").count() == 1
    assert shingles.near_duplicates(df.limit(0)).collect() == []


def test_the_pipeline_drops_edited_copies(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(200)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["a", *words[1:60], "b", *words[61:130], "c", *words[131:199], "d"]))], "doc_id bigint, text string")
    assert (simhash.fingerprint(df.first().text.encode()) ^ simhash.fingerprint(df.collect()[1].text.encode())).bit_count() > 2
    assert [r.doc_id for r in corpus_pipeline.one_of_each(spark, df, "").collect()] == [1]


def test_balls_give_the_pipeline_links(spark, monkeypatch):
    """Of candidates by balls alone: a copy within two bits goes, and a pair that the sets don't bear out stays."""
    import corpus_pipeline

    words = [f"w{k}" for k in range(4000)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), "something else " * 9]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")
    monkeypatch.setattr(shingles, "candidate_pairs", lambda met: met.where("false").select(met.node.alias("a"), met.node.alias("b")))
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, df, "").collect()) == [1, 3]
    known = shingles.nodes(df)
    node = {r.doc_id: r.node for r in known.collect()}
    assert {frozenset((r.a, r.b)) for r in simhash.node_links(known).collect()} == {frozenset((node[1], node[2]))}
    docs = known.join(df, "doc_id").select("text", "key")
    asked = spark.createDataFrame([(node[1], node[2]), (node[1], node[3])], "a bigint, b bigint")
    assert {frozenset((r.a, r.b)) for r in shingles.near_links(docs, known, asked).collect()} == {frozenset((node[1], node[2]))}


def test_very_frequent_shingles_go_in_parts(spark, monkeypatch):
    monkeypatch.setattr(shingles, "HOT", 3)
    monkeypatch.setattr(frames, "MOST_WORDS", 1)
    base, r = [f"w{k}" for k in range(120)], random.Random(2)
    rows = [(k, " ".join([*base[:at], f"x{k}", *base[at + 1 :]])) for k, at in enumerate(r.choices(range(120), k=30))]
    rows += [(100 + k, " ".join(f"y{k} z{x}" for x in range(20))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {x.doc_id: x.component_id for x in shingles.near_duplicates(df).collect()} == {d: 0 if d < 100 else d for d, _ in rows}
    assert sorted(x.doc_id for x in simhash.keep_one(df, similarity=True).collect()) == [0, *range(100, 120)]


def test_shuffles_of_staged_tables_are_deleted(spark):
    import pathlib
    import time

    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {p.name for d in dirs for p in pathlib.Path(d).rglob("shuffle_*.data")}
    before, name = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name)
    kept = frames.staged(spark.range(1000).repartition(3, "id").groupBy("id").count(), "tried")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and kept.count() == 1000 and spark.conf.get(name) == setting


def test_components_of_a_path(spark):
    n = 60
    links = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(100, 101), (101, 100), (100, 100), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {k: 0 for k in range(n + 1)} | {100: 100, 101: 100}
    assert components(links.limit(0)).collect() == []


# -- language


SAMPLE = {
    "en": "the and of that with from this have are was which there their would been",
    "de": "der die und nicht auch sich werden können schon über für größe straße",
    "es": "el los las que del por una también según más niño señor canción",
}


def language_docs(spark, n=240):
    r, rows = random.Random(9), []
    for k in range(n):
        lang = list(SAMPLE)[k % 3]
        rows.append((k, " ".join(r.choice(SAMPLE[lang].split()) for _ in range(r.randrange(3, 60))), lang if k % 10 else None, "s"))
    rows += [(n, None, "en", "s"), (n + 1, "", None, "s"), (n + 2, "123 $$ !", "de", None), (None, "the and of", "en", "s"), (n + 3, "這是一個完全不同的語言", None, "s"), (n + 4, LONG, None, "s")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")


def test_language(spark):
    docs = language_docs(spark)
    got = {r.doc_id: r for r in language.language_report(docs).collect()}
    assert len(got) == docs.count()
    rows = docs.collect()
    for k in range(240):
        assert got[k].lang_pred == list(SAMPLE)[k % 3] and 0 <= got[k].score <= 1
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
    for k in (240, 241, 242):
        assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
    kept = {r.doc_id for r in language.keep_known(docs).collect()}
    assert kept == {r.doc_id for r in rows} - {240, 241, 242, 243}
    assert language.keep_known(docs).columns == docs.columns
    nothing = language.language_report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language.language_report(docs.limit(0)).collect() == []


def test_folded_scores_are_kernel_scores():
    """The n-gram weights give what ridge regression over explicit kernel columns gives."""
    r = random.Random(2)
    samples = [(lang, " ".join(r.choice(SAMPLE[lang].split()) for _ in range(20)).encode()) for lang in SAMPLE for _ in range(12)]
    m = language.fit(samples, landmarks=5, ridge=1e-2, jitter=1e-6)
    spectrum = language.Spectrum(m.letters)
    sets = [set(spectrum.grams(t).tolist()) for _, t in samples]
    k = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets])
    chosen = [n for lang in sorted(SAMPLE) for n in [n for n, (x, _) in enumerate(samples) if x == lang][:5]]
    inner = k[np.ix_(chosen, chosen)]
    e, v = np.linalg.eigh(inner + 1e-6 * np.eye(len(inner)))
    features = k[:, chosen] @ (v @ np.diag(e**-0.5) @ v.T)
    y = np.array([[float(x == lang) for lang in sorted(SAMPLE)] for x, _ in samples])
    want = features @ np.linalg.solve(features.T @ features + 1e-2 * len(samples) * np.eye(len(inner)), features.T @ y)
    names, scores = m.score([t for _, t in samples], spectrum)
    assert names == [sorted(SAMPLE)[n] for n in want.argmax(axis=1)]
    assert np.allclose(scores, np.clip(want.max(axis=1), 0, 1), atol=1e-3)


def test_spectrum_against_plain_python():
    some = [*[t for t in texts() if t], "漢字かな交じり文" * 3, "Ünï 1 x"]
    for letters in (["a", "b", "e"], sorted({c for t in some for c in t.lower() if c.isalpha()})):
        spectrum = language.Spectrum(letters)
        code = {c: k + 1 for k, c in enumerate(letters)}
        assert (spectrum.seen is None) == (len(letters) + 2 > language.DENSE)
        for text in some:
            line = re.sub("0+", "0", "0" + "".join(chr(code.get(c, len(letters) + 1) + 48) if c.isalpha() else "0" for c in text.lower()) + "0")
            want = {line[k : k + n] for n in (1, 2, 3) for k in range(len(line) - n + 1)} - {"0", "00"}
            assert len(spectrum.grams(text.encode())) == (len(want) if line != "0" else 0)


def test_other_scripts_are_told_apart(spark):
    """More letters than any one alphabet has, two of the languages in them."""
    r = random.Random(3)
    words = {"zh": "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里", "ja": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわをん", "en": "the and of that with"}
    make = lambda lang: " ".join("".join(r.choice(words[lang]) for _ in range(4)) for _ in range(20)) if lang != "en" else " ".join(r.choice(words[lang].split()) for _ in range(30))
    rows = [(k, make(list(words)[k % 3]), list(words)[k % 3]) for k in range(150)]
    got = language.language_report(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {k: lang for k, _, lang in rows}


def test_filters_keep_clashing_columns(spark):
    docs = language_docs(spark).withColumnRenamed("lang_pred", "source").withColumns({c: F.lit(k) for k, c in enumerate(("score", "__score", "__lang_pred", "__text", "__id", "__times", "__size", "__s"))})
    known = spark.createDataFrame([(k, 1) for k in range(240)], "doc_id bigint, quality int")
    for got in (language.keep_known(docs), quality.keep_good(docs, known, cutoff=0.0), mixing.mix(docs)):
        assert got.columns == docs.columns
        assert {tuple(r)[4:] for r in got.collect()} == {tuple(range(8))}


# -- quality


def test_quality(spark):
    r, rows, labels = random.Random(1), [], []
    for k in range(600):
        good = k % 3 > 0
        text = " ".join(r.choice(("the", "of", "running", "tale", "fine", "word")) + ("" if good else r.choice(("!!", "$$$", "###"))) for _ in range(r.randrange(5, 80)))
        rows.append((k, text, 0.5))
        labels.append((k, int(good)))
    rows += [(600, None, 0.5), (601, "", 0.5), (None, LONG, 0.5)]
    labels += [(None, 1), (600, None), (5, labels[5][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.quality_report(docs, known).collect()}
    assert len(got) == len(rows)
    for k in range(600):
        assert got[k].predicted == int(k % 3 > 0) == int(got[k].score >= 0.7)
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
    assert got[600].score == got[601].score
    kept = quality.keep_good(docs, known)
    assert kept.columns == docs.columns and kept.count() >= 400
    assert {r.score for r in quality.quality_report(docs, known.limit(0)).collect()} == {0.5}
    assert len(quality.quality_report(docs, known.unionByName(known).unionByName(known)).collect()) == len(rows)
    assert quality.quality_report(docs.limit(0), known).collect() == []


def test_flat_trees_are_the_trees():
    r = np.random.default_rng(0)
    x = np.round(r.normal(size=(500, 4)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    f = quality.grow(x, y, trees=12, depth=3)

    def walk(row):
        total = f.base
        for feature, threshold, leaf in zip(f.feature, f.threshold, f.leaf, strict=True):
            n = 0
            while n < len(feature):
                n = 2 * n + 1 + int(row[feature[n]] > threshold[n])
            total += leaf[n - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(f.score(x), [walk(row) for row in x])
    assert ((f.score(x) > 0.5) == y).mean() > 0.85


# -- mixing


def fill(sizes, share=1.5, most=2.0):
    """Capped shares by the rule as it is told: clamp, share the excess again by weight, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    free, left, target = set(order), share * sum(sizes.values()), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def check_mix(rows):
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = fill(sizes)
    for s, total in sizes.items():
        own = [r for r in rows if r.source == s]
        target, taken = want[s], sum(r.taken for r in own)
        assert all(r.source_size == total and abs(r.target - target) < 1e-6 for r in own)
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
        assert abs(taken - target) <= max(r.size for r in own)


def test_mixing(spark, docs):
    got = mixing.mix_report(docs)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert got.count() == docs.count()
    r = random.Random(7)
    rows = [(k, " ".join(["w"] * r.randrange(0, 40)), r.choice(["a", "b", "c", "d", None, "é", "Z"])) for k in range(1500)] + [(5000, "x " * 9000, "only")]
    many = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    report = many.join(mixing.mix_report(many), "doc_id").collect()
    check_mix(report)
    taken = {x.doc_id: x.taken for x in report}
    assert taken == {x.doc_id: x.taken for x in mixing.mix_report(many.repartition(5)).collect()}
    mixed = mixing.mix(many)
    assert mixed.columns == many.columns
    times = {x.doc_id: x["count"] for x in mixed.groupBy("doc_id").count().collect()}
    assert all(times.get(k, 0) * len(t.split()) == taken[k] for k, t, _ in rows)
    assert mixing.mix_report(docs.limit(0)).collect() == []
    assert sorted(mixing.mix(docs).columns) == sorted(docs.columns)


def test_mixing_without_words(spark):
    none = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string")
    assert {(r.doc_id, r.size, r.target, r.taken) for r in mixing.mix_report(none).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_many_sources_are_joined_by_a_shuffle(spark, monkeypatch):
    rows = [(k, "w " * (k % 7), f"s{k % 50}") for k in range(400)]
    many = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    one = sorted(map(tuple, mixing.mix_report(many).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix_report(many).collect())) == one


def test_mixing_sql(spark, tmp_path, docs):
    import duckdb

    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = con.sql(mixing.ORACLE_SQL).fetchall()
    got = [tuple(r) for r in mixing.mix_report(docs).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
