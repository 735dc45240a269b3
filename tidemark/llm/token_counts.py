"""Operator 5: token counts by dynamic programming shared over a trie.

A pre-token is a word with the word-start mark before it; its tokens are the segmentation into vocabulary pieces with the highest
sum of scores (of equal sums the one with fewer tokens). Distinct pre-tokens go into a trie. A node's forward state (best
sum and its number of tokens) depends on the path to it alone, so it is computed once however many words begin with that path, and
the node where a word ends holds the word's count. A document's count is the sum over its words.

Each task has a trie of its own, which starts anew beyond a number of nodes; counts do not depend on that, and
nothing is shuffled. A pre-token of more than MAX_WORD characters (text without spaces) is scored by itself, with the states of
its last characters alone, and is not inserted: it shares its path with no other.

Scores. The vocabulary file lists merged pieces in order of rank. A unigram score is Zipf's log-probability of that rank,
-log(rank + OFFSET); single characters and bytes keep their place in that order. A character that is no piece falls back to the byte
pieces of its UTF-8 form.

Nulls: a null text has no words and count 0, as an empty one. Null ids are kept and repeated rows are counted each. An empty table gives an
empty result. Other columns are left out.
"""

from __future__ import annotations

import functools
import math
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import give_back, slices

#: Added to a piece's rank before the logarithm.
OFFSET = 3.0
#: Word-start mark of the vocabulary.
MARK = "▁"
#: Nodes of a task's trie before it starts anew, and characters of a pre-token that it takes.
MAX_NODES, MAX_WORD = 1_000_000, 256


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def unigram_scores(path: str) -> tuple[dict[str, float], float]:
    """Score of each piece, and that of a byte piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    plain.sort(key=lambda i: (-model.get_score(i), i))
    scores = {model.id_to_piece(i): -math.log(rank + OFFSET) for rank, i in enumerate(plain)}
    return scores, -math.log(len(plain) + OFFSET)


class CountingTrie:
    """Forward states by prefix. Children are found by (node, character) in one table."""

    def __init__(self, scores: dict[str, float], byte_score: float, max_nodes: int = MAX_NODES) -> None:
        self.byte_score, self.max_nodes = byte_score, max_nodes
        self.longest = max(map(len, scores), default=1)
        # The score of each piece, and None for what only ends a piece: a search for last tokens stops where no piece ends so.
        self.tails: dict[str, float | None] = {x[k:]: None for x in scores for k in range(1, len(x))} | scores
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]
        self.terminal: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Tokens of a word, stored at its terminal."""
        got = self.terminal.get(word)
        if got is None:
            text = MARK + word.decode("utf-8", "replace")
            if len(text) > MAX_WORD:
                return self._alone(text)
            got = self.terminal[word] = self._insert(text)
        return got

    def _state(self, text: str, end: int, states: Callable[[int], tuple[float, int]]) -> tuple[float, int]:
        """The best sum and its tokens for text[:end] from those of shorter prefixes: its last token is any piece that ends here, or
        the bytes of its last character."""
        top, least, tails = -math.inf, 0, self.tails
        for start in range(end - 1, max(0, end - self.longest) - 1, -1):
            score = tails.get(text[start:end], math.inf)
            if score == math.inf:
                break
            if score is not None:
                total, n = states(start)
                total, n = total + score, n + 1
                if total > top or total == top and n < least:
                    top, least = total, n
        char = text[end - 1]
        if tails.get(char) is None:
            width = len(char.encode("utf-8", "replace"))
            total, n = states(end - 1)
            total, n = total + width * self.byte_score, n + width
            if total > top or total == top and n < least:
                top, least = total, n
        return top, least

    def _insert(self, text: str) -> int:
        children, best, tokens = self.children, self.best, self.tokens
        node, path = 0, [0]
        for end, char in enumerate(text, 1):
            key = node << 21 | ord(char)
            child = children.get(key)
            if child is None:
                top, least = self._state(text, end, lambda k: (best[path[k]], tokens[path[k]]))
                child = children[key] = len(best)
                best.append(top)
                tokens.append(least)
            node = child
            path.append(node)
        return tokens[node]

    def _alone(self, text: str) -> int:
        kept = deque([(0.0, 0)], self.longest)  # the states of the last prefixes; the newest, of text[:end - 1], is the last
        for end in range(1, len(text) + 1):
            kept.append(self._state(text, end, lambda k: kept[k - end]))  # noqa: B023  called at once
        return kept[-1][1]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        if len(self.best) > self.max_nodes:
            self.clear()
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        coded = words.cast(pa.large_binary()).dictionary_encode()
        each = np.array([self.count(w) if w else 0 for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()], np.int64)
        total = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy()] if len(each) else np.zeros(len(words), np.int64))])
        return total[offsets[1:] - offsets[0]] - total[offsets[:-1] - offsets[0]]


@functools.cache
def _scores(path: str) -> tuple[dict[str, float], float]:
    return unigram_scores(path)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """A row for each text: doc_id, n_words, n_tokens."""
    path = vocabulary or default_vocabulary()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = CountingTrie(*_scores(path))
        try:
            for batch in slices(batches, "__text"):
                text = batch.column(1)
                lengths = pc.list_value_length(pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(text, ""))))
                words = pc.if_else(pc.equal(pc.binary_length(pc.ascii_trim_whitespace(pc.fill_null(text, ""))), 0), 0, lengths)
                yield pa.RecordBatch.from_arrays([batch.column(0), words.cast(pa.int64()), pa.array(trie.counts(text))], ["doc_id", "n_words", "n_tokens"])
        finally:
            del trie
            give_back()

    named = df.select(df[id_col].cast("bigint").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return named.mapInArrow(work, "doc_id bigint, n_words bigint, n_tokens bigint")
