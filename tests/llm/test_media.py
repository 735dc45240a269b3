"""Operators on vectors, recordings and pages, and the pipeline, with the same awkward inputs."""

import random
import re
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chroma, encoding, language, metric_join, mixing, page_text, quality

# -- vectors


def planted(n=400, dim=12, seed=3):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 4, dim))
    near = [b + r.normal(size=dim) * 0.12 for b in base[: n // 8] for _ in range(3)]
    x = [*base, *near, base[0], base[0], base[1] * 5, -base[2]]
    return [v.astype(np.float32).tolist() for v in x]


def brute_links(vectors, threshold=0.9):
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m = x @ x.T >= threshold
    label = np.arange(len(x))
    while True:
        new = np.array([label[m[k]].min() for k in range(len(x))])
        if (new == label).all():
            return m.sum(axis=1) - 1, label
        label = new


@pytest.mark.parametrize("block", [2048, 40])
def test_vectors_against_all_pairs(spark, monkeypatch, block):
    """With 40 vectors a block there are many pivots, split cells and replicas."""
    monkeypatch.setattr(metric_join, "BLOCK", block)
    vectors = planted()
    odd = [None, [], [0.0] * 12, [float("nan")] * 12, [1.0, None, *[0.0] * 10], [float("inf"), *[0.0] * 11], [1.0, 2.0], [2.0, 4.0]]
    rows = [(k, v, 1, "x") for k, v in enumerate([*vectors, *odd])] + [(None, vectors[0], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, v string").repartition(3)
    got = {r.vec_id: r for r in metric_join.near_vectors(df).collect()}
    assert len(got) == len(rows)
    links, label = brute_links([*vectors, vectors[0]])
    for k in range(len(vectors)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (links[k], label[k], label[k] == k)
    n = len(vectors)
    for k in range(n, n + 6):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert (got[n + 6].n_links, got[n + 7].component_id) == (1, n + 6)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (links[-1], 0, False)


def test_a_split_cell(spark, monkeypatch):
    """All vectors in one ball: blocks of one cell exchange theirs, and one component comes out."""
    monkeypatch.setattr(metric_join, "BLOCK", 16)
    monkeypatch.setattr(metric_join, "MAX_PIVOTS", 2)
    r = np.random.default_rng(1)
    vectors = [(np.ones(8) + r.normal(size=8) * 0.25).tolist() for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    links, label = brute_links(vectors)
    got = {x.vec_id: (x.n_links, x.component_id) for x in metric_join.near_vectors(df).collect()}
    assert got == {k: (links[k], label[k]) for k in range(120)}


def test_vectors_against_sql(spark, tmp_path):
    import duckdb

    rows = [(k, v) for k, v in enumerate([*planted(120), None, [0.0] * 12, [float("nan")] * 12, [1.0, 2.0], [2.0, 4.0]])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    assert sorted(con.sql(metric_join.ORACLE_SQL).fetchall()) == sorted(tuple(r) for r in metric_join.near_vectors(df).collect())


def test_vectors_of_extreme_size(spark):
    """Squares that overflow or vanish link as others do."""
    rows = [(0, [1e200, 1e200]), (1, [1e200, 1.1e200]), (2, [1e-200, 1e-200]), (3, [5e-324, 5e-324]), (4, [1.0, -1.0]), (5, [-1e-300, 1e-300]), (6, [1e308, -1e308])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in metric_join.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (1, 4), 5: (0, 5), 6: (1, 4)}


def test_single_precision_is_within_its_margin():
    r = np.random.default_rng(4)
    for dim in (2, 64, 1024, 8192):
        a, b = (metric_join.normal(r.normal(size=(60, dim)) + 1) for _ in range(2))
        assert np.abs(a.astype(np.float32) @ b.astype(np.float32).T - a @ b.T).max() < metric_join.margin(dim) < 1e-2


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert metric_join.near_vectors(empty).collect() == []


# -- recordings


def wav(samples, rate=8000, bits=16, channels=1):
    x = np.repeat(np.clip(samples, -1, 1)[:, None], channels, axis=1)
    data = ((x * 127 + 128).astype(np.uint8) if bits == 8 else (x * 32767).astype("<i2")).tobytes()
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVE" + head + struct.pack("<4sI", b"data", len(data)) + data


def melody(seed, notes=40, rate=8000):
    r = random.Random(seed)
    t = np.arange(int(0.2 * rate)) / rate
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (r.randrange(36) / 12) * t) * 0.6 for _ in range(notes)])


def test_wav_forms():
    x = melody(1, 20)
    prints = [chroma.fingerprint(chroma.decode_wav(wav(x, bits=b, channels=c))) for b, c in ((16, 1), (8, 1), (16, 2))]
    assert len(prints[0]) > 30
    for p in prints[1:]:
        assert np.bitwise_count(p ^ prints[0]).mean() < 2
    assert not len(chroma.decode_wav(b"no audio")) and not len(chroma.decode_wav(wav(x)[:20]))
    assert len(chroma.resample(np.zeros(44100), 44100)) == pytest.approx(4000, abs=20)


def test_alignment_finds_the_offset():
    x = melody(5, 60)
    cut = int(1.0 * 8000 / 512) * 512  # whole hops, one second in
    a, b = (chroma.fingerprint(chroma.decode_wav(wav(s))) for s in (x, x[cut:]))
    offset, overlap, errors = chroma.align(a, b)
    assert offset == cut // 512 and overlap > 50 and errors < 0.02 * 32 * overlap
    assert chroma.align(a, np.zeros(0, np.uint32)) is None


def test_integral_filters_are_rectangle_sums():
    image = chroma.chroma(chroma.decode_wav(wav(melody(2, 12))))
    values = chroma.fingerprint(chroma.decode_wav(wav(melody(2, 12))))
    for at in (0, 3, len(values) - 1):
        want = 0
        for k, (kind, y, h, w) in enumerate(chroma.filter_bank()):
            part = image[at : at + w, y : y + h]
            upper, left = part[:, : h // 2], part[: w // 2]
            one = {
                0: upper.sum(),
                1: left.sum(),
                2: part[: w // 2, : h // 2].sum() + part[w // 2 :, h // 2 :].sum(),
                3: part[:, h // 3 : h - h // 3].sum(),
                4: part[w // 3 : w - w // 3].sum(),
            }[kind]
            ratio = np.round(np.log1p(one) - np.log1p(part.sum() - one), 6)
            want |= int(chroma.GRAY[np.searchsorted(chroma.LEVELS, ratio)]) << (2 * k)
        assert bin(want ^ int(values[at])).count("1") <= 1  # a ratio on the edge of a level may fall on either side


def test_recordings(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    text = lambda seed, n=60: " ".join(random.Random(seed).choice(words) for _ in range(n))
    turns = [(c, t, "user", text(100 * c + t)) for c in range(60) for t in range(2)]
    turns += [(70, 0, "user", text(0)), (71, 0, "user", text(0)), (72, 0, "user", "one two three " + text(0) + " tail"), (73, 0, "user", None), (74, 0, "user", ""), (75, 0, "user", "short"), (None, 0, "user", text(1)), (76, 0, "user", "same " * 90)]
    r.shuffle(turns)
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    rows = chroma.recording_report(df).collect()
    at = lambda conv, turn=0: conv << chroma.TURN_BITS | turn
    member = {x.media_id: x for x in rows if x.kind == "member"}
    assert len([x for x in rows if x.kind == "member"]) == len(turns)
    assert member[at(70)].class_id == member[at(71)].class_id == 0
    assert member[at(73)].n_frames == member[at(74)].n_frames == member[at(75)].n_frames == 0
    matches = {(x.media_id, x.class_id): x for x in rows if x.kind == "match"}
    found = matches[0, at(72)]
    assert found.offset == -6 and found.bit_errors <= 0.05 * 32 * found.overlap  # three words, two hops each, later in the other
    prints = {k: chroma.fingerprint(chroma.decode_tones((t or "").encode())) for k, t in ((at(c, n), t) for c, n, _, t in turns if c is not None)}
    want = set()
    for q in (k for k in prints if (k >> chroma.TURN_BITS) % 50 == 0 and member[k].class_id == k):
        for k, p in prints.items():
            got = chroma.align(prints[q], p) if k != q and member[k].class_id == k else None
            if got and got[1] >= chroma.LEAST_OVERLAP and got[2] <= 32 * chroma.MOST_ERRORS * got[1]:
                want.add((q, k))
    assert set(matches) == want
    assert chroma.recording_report(df.limit(0)).collect() == []


def test_a_shared_passage_is_enough(spark):
    """Turns with fifteen words in common at different places and nothing around them."""
    word = lambda r, n: [f"v{r.randrange(900)}" for _ in range(n)]
    r = random.Random(9)
    same = word(r, 15)
    one, two = [*word(r, 20), *same, *word(r, 25)], [*word(r, 35), *same, *word(r, 10)]
    a, b = (chroma.fingerprint(chroma.decode_tones(" ".join(x).encode())) for x in (one, two))
    offset, overlap, errors = chroma.align(a, b)
    whole, over = chroma.bit_errors(a, b, offset)
    assert over > 32 * chroma.MOST_ERRORS * whole and errors <= 32 * chroma.MOST_ERRORS * overlap and overlap >= chroma.LEAST_OVERLAP
    df = spark.createDataFrame([(0, 0, "user", " ".join(one)), (1, 0, "user", " ".join(two))], "conv_id bigint, turn bigint, role string, text string")
    found = [x for x in chroma.recording_report(df).collect() if x.kind == "match"]
    assert [(x.media_id, x.class_id, x.offset, x.overlap, x.bit_errors) for x in found] == [(0, 1 << chroma.TURN_BITS, offset, overlap, errors)]


def best_of_all_offsets(a, b):
    """Whether any passage at any offset is an alignment, by plain sums."""
    bits = np.bitwise_count(a[:, None] ^ b[None, :]).astype(int)
    least = chroma.LEAST_OVERLAP
    for offset in range(-len(b) + least, len(a) - least + 1):
        total = np.concatenate([[0], np.cumsum(np.diagonal(bits, -offset))])
        if len(total) > least and any((total[n:] - total[:-n] <= 32 * chroma.MOST_ERRORS * n).any() for n in range(least, min(len(total), 2 * least))):
            return True
    return False


def test_recall_against_all_offsets(spark):
    """Excerpts with noise that begin anywhere within a hop, and unrelated recordings: the index finds nine tenths or more of what all offsets give, and nothing else."""
    r, rng = random.Random(7), np.random.default_rng(7)
    rows = []
    for k in range(24):
        x = melody(100 + k, 30)
        cut = x[int(r.uniform(0.1, 0.3) * len(x)) :][: int(0.6 * len(x))]
        rows.append((50 * k, wav(x)))
        rows.append((50 * k + 1, wav(cut + rng.normal(0, 0.6 * 10 ** (-r.choice((12, 18, 30)) / 20), len(cut)))))
    rows += [(60 + 50 * k, wav(melody(500 + k, 20))) for k in range(10)] + [(70, wav(melody(1, 3))), (71, wav(np.tile(melody(2, 40), 12)))]
    df = spark.createDataFrame(rows, "media_id bigint, media binary")
    known = chroma.fingerprints(df, "media_id", "media").cache()
    prints = {x.media_id: np.frombuffer(x.fingerprint, "<u4") for x in known.collect()}
    starts = {k: [chroma.fingerprint(chroma.decode_wav(x)[n * chroma.HOP // chroma.STARTS :]) for n in range(chroma.STARTS)] for k, x in rows if k % 50 == 0}
    want = {(q, k) for q, a in starts.items() for k in prints if k != q and any(best_of_all_offsets(x, prints[k]) for x in a)}
    got = [(x.media_id, x.class_id) for x in chroma.search(known, F.col("media_id") % 50 == 0, df).where("kind = 'match'").collect()]
    assert set(got) <= want and len(set(got)) == len(got) and len(want) >= 20 and len(got) >= 0.9 * len(want)
    first = {(x.media_id, x.class_id) for x in chroma.search(known, F.col("media_id") % 50 == 0).where("kind = 'match'").collect()}
    alone = {(q, k) for q, k in want if best_of_all_offsets(prints[q], prints[k])}
    assert first <= alone and len(first) >= 0.9 * len(alone)


def test_recordings_with_clashing_columns_and_null_media(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, wav(melody(3, 9)), "b"), (50, wav(melody(3, 9)), "c"), (2, b"", "d")], "id bigint, media binary, fingerprint string")
    got = chroma.search(chroma.fingerprints(df, "id", "media"), F.col("media_id") % 50 == 0).collect()
    assert sorted((x.media_id or 0, x.class_id or 0, x.n_frames > 0) for x in got) == [(0, 50, True), (1, 1, False), (2, 2, False), (50, 50, True)]


# -- pages


def page(body):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p><article>x</article>";</script></head><body>{body}</body></html>'


MENU = "<nav><ul><li><a href=/a>Home</a></li><li>About</li></ul></nav>"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (page(MENU + "<div class='ad'>Buy</div><article><h1>Top &amp; more</h1><p>One <b>two</b>\n three<br>four<p>Five</article><footer>&copy; x</footer>"), "Top & more\nOne two three four\nFive"),
        ("<main><p>a</p><aside>side</aside><form>f <input></form><p>b &lt;c&gt; &#233;&#x41;</p><section class='reader-comments'><p>me too</p></section></main>", "a\nb <c> éA"),
        ("<article><p>one<article class='comment'><p>no</p></article><p>two", "one\ntwo"),
        ("<p>just &ampamp; text <!-- gone --> here", "just &amp; text here"),
        ("<div role=main><p>x</p></div><div>outside</div>", "x"),
        ("no markup < at all", "no markup < at all"),
        ("<p></p><script>only", ""),
        ("", ""),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<article><header><h1>H</h1></header><p>t</p></article><header>page head</header>", "H\nt"),
        ("<p title='a > b'>q r</p><p>s &am</p>", "q r\ns &am"),
        ('<article><p>one</p><svg class="i"/><p>two</p><iframe src="x"/><p>three</p></article>', "one\ntwo\nthree"),
        ("<title>no end<p>body</p><svg><p>more</p>", "body\nmore"),
        ("<article><p>x <math><mi>y</mi></math> <object>o</object> <canvas>c</canvas> <label>l</label></article>", "x y o c l"),
        ("<main><div class='social-history'>a</div><section class='related-work'>b</section><section class='related-articles'>c</section><div class='share-buttons'>d</div></main>", "a\nb"),
        ("<article><p>teaser</p></article><div><p>the body</p></div><div class='site-footer'>f</div>", "teaser\nthe body"),
        ("<script>if (a < b) { '</p>' }</script ><p>after</p><style>p > b", "after"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ],
)
def test_blocks(source, want):
    assert page_text.main_texts([source]) == [want]


def test_suffix_array():
    r = random.Random(0)
    for n in (1, 2, 7, 60):
        t = np.array([r.randrange(3) for _ in range(n)])
        assert page_text.suffix_array(t).tolist() == sorted(range(n), key=lambda k: t[k:].tolist())


def test_repeats_against_brute_force():
    r = random.Random(2)
    for _ in range(20):
        n = r.randrange(1, 120)
        t, p = np.array([r.randrange(3) for _ in range(n)]), np.sort(np.array([r.randrange(5) for _ in range(n)]))
        want = np.zeros(n, bool)
        runs = {}
        for k in range(n - 3):
            runs.setdefault(tuple(t[k : k + 4]), []).append(k)
        for at in runs.values():
            if len({p[k] for k in at}) >= 3:
                for k in at:
                    want[k : k + 4] = True
        assert (page_text.repeated(t, p, 4, 3) == want).all()


def test_host_boilerplate(spark):
    """Without an article, what three pages of a host share goes, and runs of their own stay; other hosts are not touched."""
    shared = "welcome to our very best shop of all"
    body = lambda k: f"<div>{shared} {'abcdefgh'[k]} own words number {k}</div><p>line of page {k}</p>"
    rows = [(k, f"http://h.example/{k}", body(k), "x") for k in range(5)] + [(9, "http://other.example/", body(6), "x"), (9, None, None, None), (None, "no url", "<p>x</p>", "x"), (10, "http://h.example/a", f"<article><p>{shared}</p></article>", "x"), (10, "http://h.example/a", f"<article><p>{shared}</p></article>", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = page_text.page_report(df).collect()
    by = {(r.page_id, r.url): r for r in got}
    assert len(got) == len(rows)
    for k in range(5):
        assert by[k, f"http://h.example/{k}"].text == f"{'abcdefgh'[k]} own words number {k}\nline of page {k}"
    assert by[9, "http://other.example/"].text.startswith(shared)
    assert by[9, None].text == "" and by[9, None].n_chars == 0 and by[None, "no url"].text == "x"
    assert by[10, "http://h.example/a"].text == shared
    assert all(r.n_chars == len(r.text) for r in got)
    assert page_text.extract_text(df).columns == ["page_id", "url", "text", "n_chars"]
    assert page_text.page_report(df.limit(0)).collect() == []


def test_copies_and_phrases_stay():
    """Copies do not cover each other, and a common phrase in running text is no boilerplate."""
    copy = "<p>one and the same long story told again and again</p>"
    assert page_text.main_texts([copy] * 4) == ["one and the same long story told again and again"] * 4
    phrase = lambda k: "at the end of the day" if k < 4 else f"e{k}"
    pages = [f"<p>a{k} b{k} {phrase(k)} c{k} d{k}</p><p>all of the rights are reserved</p>" for k in range(60)]
    assert page_text.main_texts(pages) == [f"a{k} b{k} {phrase(k)} c{k} d{k}" for k in range(60)]


@pytest.mark.parametrize("n", [7, 400])
def test_hosts_of_any_size_against_the_suffix_array(spark, monkeypatch, n):
    """Pages dealt out by runs give what one suffix array over the whole host gives, beside an article too."""
    r = random.Random(n)
    words = [f"w{k}" for k in range(60)]
    line = lambda m: " ".join(r.choice(words) for _ in range(m))
    notices, quotes = [line(r.randrange(3, 20)) for _ in range(6)], [line(14) for _ in range(3)]
    pages = []
    for k in range(n):
        body = f"<p>{line(8)} {r.choice(quotes)} p{k}</p><p>{r.choice(notices)}</p><div>{line(4)} x{k}</div><nav>{notices[0]}</nav>"
        pages.append(f"<article><p>{line(9)}</p><p>{notices[1]}</p></article>{body}" if k % 3 == 0 else body)
    pages += pages[:3] + [""]
    want = page_text.main_texts(pages)
    df = spark.createDataFrame([(k, "http://Host.example/" + str(k), x) for k, x in enumerate(pages)] + [(9000 + k, "http://other.example/", x) for k, x in enumerate(pages[:2])], "page_id bigint, url string, html string")
    got = {x.page_id: x.text for x in page_text.extract_text(df).collect()}
    assert [got[k] for k in range(len(pages))] == want
    assert [got[9000], got[9001]] == page_text.main_texts(pages[:2]) != want[:2]
    monkeypatch.setattr(page_text, "BROADCAST_HOSTS", 0)
    assert {x.page_id: x.text for x in page_text.extract_text(df).collect()} == got


# -- the pipeline


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


def plain_run(spark, folder):
    """What run() must give, stage by stage in plain Python over rows (doc_id, text, source): {(doc_id, text): token ids x times}."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = language.train(docs)
    spectrum = language.Spectrum(model.letters)
    judge = lambda t: model.score([(t or "").encode()], spectrum)
    rows = [r for r in docs.collect() if judge(r.text)[0][0] != "und" and judge(r.text)[1][0] >= 0.1]
    left = spark.createDataFrame(rows, docs.schema)
    forest = quality.train(left, labels)
    rows = [r for r in rows if forest.score(np.array([quality.statistics((r.text or "").encode())]))[0] >= quality.CUTOFF]
    named, sets = sorted({(r.doc_id, r.text, r.source) for r in rows if r.doc_id is not None}, key=str), {}
    named.sort(key=lambda r: r[0])
    parent = list(range(len(named)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [plain_shingles(t) for _, t, _ in named]
    for a in range(len(named)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return rows, {named[find(k)][0] for k in range(len(named))}


def check_run(spark, folder, got):
    import corpus_pipeline

    rows, kept = plain_run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = [r for r in rows if r.doc_id is None or r.doc_id in kept]
    stage = spark.createDataFrame(rows, docs.schema)
    one = corpus_pipeline.one_of_each(spark, stage, folder)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {r.doc_id for r in left}
    report = {}
    for r in mixing.mix_report(one).collect():
        report[r.doc_id] = report.get(r.doc_id, 0) + r.taken
    texts = {r.doc_id: r.text or "" for r in one.collect()}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {k for k, t in report.items() if t}
    encoder = encoding.WordEncoder(encoding.default_vocabulary())
    import pyarrow as pa

    for doc, parts in pieces.items():
        if doc is None:
            continue
        ids = encoder.encode(pa.array([texts[doc]]))[0].astype("<u4").tobytes()
        times = report[doc] // words(texts[doc])
        at = {}
        for p in parts:
            assert ids[4 * p.start : 4 * (p.start + p.length)] == bytes(p.ids) and p.doc_tokens == len(ids) // 4
            for k in range(p.start, p.start + p.length):
                at[k] = at.get(k, 0) + 1
        assert at == dict.fromkeys(range(len(ids) // 4), times)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the test tables are not here")
def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near-duplicates", "mixing", "packing"]
    check_run(spark, "/root/testdata/sf0.001", corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect())


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, one id with two texts, repeated rows and clashing names; and no rows at all."""
    import corpus_pipeline

    r = random.Random(6)
    text = lambda n, bad="": " ".join(r.choice("the and of that with from this have are was which there".split()) + bad for _ in range(n))
    rows = [(k, text(r.randrange(20, 60), "" if k % 2 else r.choice(("!!", "$#"))), "en" if k % 9 else None, ("a", "b", None)[k % 3]) for k in range(160)]
    rows += [rows[1], rows[1], rows[3], (200, rows[5][1], None, "z"), (201, None, "en", "a"), (202, "", None, None), (203, "1 2 3 $", "en", "a"), (1, text(40), "en", "b"), (None, text(30), "en", "a"), (204, text(30_000), "en", "b"), (None, None, None, None)]
    odd = [(*x, 1.5, "k", 0) for x in rows]
    schema = "doc_id bigint, text string, lang string, source string, __score double, __key string, score int"
    spark.createDataFrame(odd, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, k % 2) for k in range(160)] + [(None, 1), (3, None), (5, 1)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {x.doc_id for x in got}
    assert 204 in texts and not texts & {0, 2, 201, 202, 203}
    for x in (tmp_path / "none", tmp_path / "none2"):
        x.mkdir()
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "labels.parquet")).write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
    rows, kept = plain_run(spark, str(tmp_path))
    mixed = {x.doc_id for x in mixing.mix(corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, schema), "")).collect()}
    assert texts == mixed and texts - {None} <= kept | {1}


def test_staged_tables_are_deleted(spark):
    from tidemark.llm.frames import fresh_path, scratch

    with scratch(spark):
        path = fresh_path(spark, "gone")
        spark.range(3).write.parquet(path)
    assert not Path(path.removeprefix("file://")).exists()


def test_small_batches_leave_what_a_session_sets(spark):
    from tidemark.llm.frames import SCAN_ROWS, SLICE_BYTES, small_batches

    rows, size = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch"
    other = spark.newSession()
    other.conf.unset(rows)
    other.conf.set(size, "2097152")
    small_batches(other)
    assert (other.conf.get(rows), other.conf.get(size)) == (str(SCAN_ROWS), "2097152")
    other.conf.unset(size)
    small_batches(other)
    assert other.conf.get(size) == str(SLICE_BYTES)
