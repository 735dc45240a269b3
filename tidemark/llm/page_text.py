"""Operator 10: the main text of web pages, by markup and the repeated runs of each host.

A page becomes blocks in page order. Markup settles some of them: blocks in an article or main element stay, blocks in
menus, footers, side columns, forms and elements whose class, id or role names an advert, notice, comments and the like go, as does all
outside a main element with text. All others are open, beside an article too, and are settled by the host.

The words of a page's open and going blocks are its stream. Sorted by their first LEAST_WORDS words, all suffixes of a host's streams
are a suffix array, in which the occurrences of one run are neighbours. It is dealt out by that key (a hash of host and words), so that a host
of any size is spread over all tasks: an aggregation counts the distinct pages of each run, and the runs on LEAST_PAGES or more return to the pages
that have them. Words in such runs are covered. An open block that is covered wholly goes; of others the covered runs of INNER_WORDS or more
go, and those on one in INNER_SHARE of the host's pages; what remains, the block's unique runs, is kept. ``repeated`` finds the same runs
with a suffix array in memory.

Words inside an article are no evidence against it: copies and quoted passages of articles on one host stay whole.

Nulls: null html is empty, with empty text. A null url has the empty host. Null ids are kept. Repeated pages are pages of their own, but
copies, pages of a host with the same html, count as one page for repetition. An empty table gives an empty result. Elements that close themselves
are empty; of a raw element without an end tag only the tag goes (of a title its text, of scripts and styles the rest of the page). Other
columns are kept by ``extract_text``; a column named like the result's is replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import slices, staged

#: Words of a repeated run; distinct pages that it stands on.
LEAST_WORDS, LEAST_PAGES = 5, 3
#: A repeated run that is not a whole block goes if it has so many words, or stands on one of so many pages of the host at least.
INNER_WORDS, INNER_SHARE = 12, 10
#: Hosts up to this number are broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_HOSTS = 100_000

# Element names and words of class, id and role attributes.
RAW = "script|style|noscript|template|iframe|textarea|title|svg|select"
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul video audio".split())
CONTAINERS = frozenset("article aside body center details dialog div dl fieldset figure footer form head header main menu nav ol section table tbody td tfoot th thead tr ul button".split())
OUTSIDE = frozenset("aside footer form head menu nav dialog button fieldset".split())
OUTSIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments discussion disqus replies share sharing social related recommended recommendations widget widgets toolbar pagination pager login signup skip search contentinfo complementary".split())
#: Of page headers; inside an article they name the article's own.
HEADER_WORDS = frozenset("header masthead".split())
#: First words of names that say what is around or missing, such as has-sidebar.
NOT_ITSELF = frozenset("has no not with without is".split())
#: Last words of names that only say form or place: the word before them names the thing, as in share-buttons.
FORM_WORDS = frozenset("area articles bar block body bottom box button buttons center column container content form group icon icons inner item items left link links list media module outer panel posts results right row section slot stories text top unit wrap wrapper zone".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])(?P<inside>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+)>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_RAW_ENDS = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for x in RAW.split("|")}
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")

#: What markup says of a block. Inside a main element, which holds all of the main text, it is WHOLE while a page is read.
GOES, OPEN, STAYS, WHOLE = 0, 1, 2, 3


def kind_of(tag: str, rest: str, inside_main: bool) -> int:
    if tag in OUTSIDE or (tag == "header" and not inside_main):
        return GOES
    if rest and tag not in ("body", "main"):
        for m in _NAMES.finditer(rest):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                words = _WORDS.findall(name)
                if not words or words[0] in NOT_ITSELF:
                    continue
                if name == "main":
                    return WHOLE
                while len(words) > 1 and words[-1] in FORM_WORDS:
                    words.pop()
                # The last word names the thing: a related-work section is about work.
                if words[-1] in OUTSIDE_WORDS or not inside_main and words[-1] in HEADER_WORDS:
                    return GOES
    return {"main": WHOLE, "article": STAYS}.get(tag, OPEN)


def blocks_of(source: str) -> list[tuple[int, str]]:
    """(what markup says, text) of each block that has text, in page order."""
    found: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # open containers and what holds inside
    state, at = OPEN, 0
    unclosed: set[str] = set()  # raw elements without an end tag from here on

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((state, text))
            parts.clear()

    while m := _TOKEN.search(source, at):
        if m.start() > at:
            parts.append(source[at : m.start()])
        at = m.end()
        if m["raw"]:
            raw = m["raw"].lower()
            if m["inside"].endswith("/"):
                continue
            end = None if raw in unclosed else _RAW_ENDS[raw].search(source, at)
            if end:
                at = end.end()
                continue
            unclosed.add(raw)
            if raw in ("script", "style"):
                at = len(source)
            elif raw == "title":
                stop = source.find("<", at)
                at = stop if stop >= 0 else len(source)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in BLOCKS and tag not in CONTAINERS:
            continue
        if tag in BLOCKS:
            close()
        if tag not in CONTAINERS:
            continue
        close()
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif not m["rest"].endswith("/"):
            kind = kind_of(tag, m["rest"], state >= STAYS)
            stack.append((tag, GOES if state == GOES or kind == GOES else max(state, kind)))
        state = stack[-1][1] if stack else OPEN
    if at < len(source):
        parts.append(source[at:])
    close()
    # A main element says of all that is outside that it is not the main text; an article says nothing of what is beside it.
    outside = GOES if any(state == WHOLE for state, _ in found) else OPEN
    return [(outside if state == OPEN else min(state, STAYS), text) for state, text in found]


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        step = np.ones(n, np.int64)
        step[0] = 0
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        k *= 2
        if rank[order[-1]] == n - 1 or k >= n:
            return order


def repeated(tokens: np.ndarray, page: np.ndarray, least_words: int = LEAST_WORDS, least_pages: int = LEAST_PAGES) -> np.ndarray:
    """Which tokens lie in a run of ``least_words`` tokens or more that stands on ``least_pages`` distinct pages.

    Neighbours in the suffix array that agree in their first tokens are the occurrences of one run.
    """
    n = len(tokens)
    covered = np.zeros(n, bool)
    if n < least_words:
        return covered
    order = suffix_array(tokens)
    order = order[order + least_words <= n]
    same = np.ones(len(order) - 1, bool)
    for k in range(least_words):
        same &= tokens[order[1:] + k] == tokens[order[:-1] + k]
    group = np.concatenate([[0], np.cumsum(~same)])
    width = int(page.max()) + 1
    pages = np.bincount(np.unique(group * width + page[order]) // width, minlength=group[-1] + 1)
    starts = order[pages[group] >= least_pages]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + least_words, -1)
    return np.cumsum(change[:-1]) > 0


def inner_runs(covered: np.ndarray, least_words: int) -> np.ndarray:
    """Covered runs of a block that are long enough on their own, or the whole block. A few words that only continue a
    repeated run from the block beside stay."""
    if covered.all():
        return covered
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    out = covered.copy()
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if b - a < least_words:
            out[a:b] = False
    return out


def run_hashes(words: list[str], host: int, least_words: int = LEAST_WORDS) -> np.ndarray:
    """A hash of each run of ``least_words`` words and its host, by where it begins."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(" ".join(words[k : k + least_words]), host % (1 << 64)) for k in range(len(words) - least_words + 1)], np.uint64).view(np.int64)


def known_runs(words: list[str], host: int, runs: np.ndarray, least_words: int = LEAST_WORDS) -> np.ndarray:
    """Which words lie in one of the ``runs`` (hashes)."""
    change = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(np.isin(run_hashes(words, host, least_words), runs))
    change[starts] += 1
    change[starts + least_words] -= 1
    return np.cumsum(change[:-1]) > 0


def kept_text(own: list[tuple[int, str]], covered: np.ndarray, common: np.ndarray) -> str:
    """A page's text: blocks that stay, and of open blocks what is not boilerplate. ``covered`` and ``common``: of the words of its
    stream, which lie in repeated runs and in those on a share of the host's pages."""
    kept, at = [], 0
    for state, text in own:
        if state == STAYS:
            kept.append(text)
            continue
        words = text.split()
        gone = covered[at : at + len(words)]
        if not gone.all():
            gone = inner_runs(gone, max(LEAST_WORDS, INNER_WORDS)) | inner_runs(common[at : at + len(words)], LEAST_WORDS)
        at += len(words)
        if state == OPEN and not gone.all():
            kept.append(" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g))
    return "\n".join(kept)


def stream_of(own: list[tuple[int, str]]) -> list[str]:
    """The words of a page's open and going blocks."""
    return [w for state, text in own if state != STAYS for w in text.split()]


def main_texts(pages: list[str], least_words: int = LEAST_WORDS, least_pages: int = LEAST_PAGES) -> list[str]:
    """Main text of each html of one host, with a suffix array in memory."""
    blocks = [blocks_of(x) for x in pages]
    bodies = {x: n for n, x in enumerate(dict.fromkeys(pages))}
    number: dict[str, int] = {}
    stream, owner, starts = [], [], []
    for n, (source, own) in enumerate(zip(pages, blocks, strict=True)):
        starts.append(len(stream))
        stream += [number.setdefault(w, len(number)) for w in stream_of(own)] + [-1 - n]  # each page ends in a mark of its own
        owner += [bodies[source]] * (len(stream) - len(owner))
    ids, of = np.array(stream, np.int64), np.array(owner, np.int64)
    covered = repeated(ids, of, least_words, least_pages)
    common = repeated(ids, of, least_words, max(least_pages, -(-len(bodies) // INNER_SHARE)))
    return [kept_text(own, covered[a:], common[a:]) for own, a in zip(blocks, starts, strict=True)]


def page_runs(parsed: DataFrame) -> DataFrame:
    """(run, host, body) of each distinct page: hashes of a run of LEAST_WORDS words of its stream with the host, of the host and of the page.
    ``parsed``: __host, __body, __loose."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = [np.unique(run_hashes((x or "").split("\n"), host)) for x, host in zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), strict=True)]
            take = pa.array(np.repeat(np.arange(len(runs)), [len(x) for x in runs]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(runs)), batch.column(0).take(take), batch.column(1).take(take)], ["run", "host", "body"])

    return parsed.select("__host", "__body", "__loose").mapInArrow(work, "run bigint, host bigint, body bigint")


def repeated_runs(parsed: DataFrame) -> DataFrame:
    """For each page that has open blocks (__body): __runs, hashes of its runs on LEAST_PAGES distinct pages of its host, and
    __common, those on one in INNER_SHARE of them. ``parsed``: __host, __body, __loose and __open."""
    found = staged(page_runs(parsed).distinct(), "page-runs")
    often = found.groupBy("run", "host").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    sizes = parsed.select("__host", "__body").distinct().groupBy("__host").agg(F.count("*").alias("all"))
    sizes = staged(sizes, "host-pages")
    small = F.broadcast if sizes.count() <= BROADCAST_HOSTS else (lambda x: x)
    often = often.join(small(sizes), F.col("host") == F.col("__host")).select("run", (F.col("n") * INNER_SHARE >= F.col("all")).alias("common"))
    needed = parsed.where("__open").select(F.col("__body").alias("body")).distinct()
    told = found.join(needed, "body", "left_semi").join(often, "run")
    return told.groupBy(F.col("body").alias("__body")).agg(F.collect_list("run").alias("__runs"), F.collect_list(F.when(F.col("common"), F.col("run"))).alias("__common"))


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``df`` without its html and with ``text`` (empty if there is none) and ``n_chars``, its code points."""
    from pyspark.sql.types import BooleanType, StringType, StructType

    rows = df.drop(*({"text", "n_chars"} - {id_col, url_col, html_col}))
    kept = [c for c in rows.columns if c != html_col]
    name = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    source = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = rows.select(F.struct(*kept).alias("__row"), F.xxhash64(name).alias("__host"), F.xxhash64(name, source).alias("__body"), source.alias("__html"))
    schema = StructType.fromJson(rows.drop("__html").schema.jsonValue()).add("__open", BooleanType()).add("__loose", StringType()).add("__text", StringType())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__html"):
            found = [blocks_of(x) for x in batch.column(3).to_pylist()]
            is_open = [any(state == OPEN for state, _ in own) for own in found]
            loose = ["\n".join(stream_of(own)) for own in found]
            # A page with open blocks keeps them all until the host has settled them: a mark for each block's kind, then its text.
            text = ["\n".join(f"{state}{t}" if o else t for state, t in own if o or state == STAYS) for own, o in zip(found, is_open, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(is_open, pa.bool_()), pa.array(loose, pa.string()), pa.array(text, pa.string())], schema.names)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            texts = []
            for host, text, runs, common in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                own = [(int(x[0]), x[1:]) for x in text.split("\n")]
                words = stream_of(own)
                texts.append(kept_text(own, *(known_runs(words, host, np.array(x or [], np.int64)) for x in (runs, common))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["__row", "__text"])

    parsed = staged(rows.mapInArrow(parse, schema), "parsed-pages", compression="zstd")
    settled = parsed.where("not __open").select("__row", "__text")
    told = repeated_runs(parsed)
    unsettled = parsed.where("__open").select("__row", "__host", "__text", "__body").join(told, "__body", "left")
    unsettled = unsettled.select("__row", "__host", "__text", "__runs", "__common").mapInArrow(settle, settled.schema)
    out = settled.union(unsettled)
    return out.select("__row.*", F.col("__text").alias("text"), F.char_length("__text").cast("bigint").alias("n_chars"))


def page_report(df: DataFrame) -> DataFrame:
    """A row for each page: page_id, url, text, n_chars."""
    return extract_text(df.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
