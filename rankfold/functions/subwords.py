"""Subword counts by greedy longest match (T7 in subwords).

A model's input length is counted in subwords, not words.  The vocabulary is a file of
pieces (a parameter; nothing is trained): a piece that carries the end mark ends a word,
any other is followed by one.  A word is cut from the left, always by the longest piece that the vocabulary
has there; a character without a piece counts as one unknown subword.

Words are counted on the workers by a trie that each builds once from the broadcast
vocabulary; counts of words seen are kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import PAIR_SPECIAL_TOKENS

# Fixed value of the vocabulary files: the mark of a piece that ends a word.
WORD_END = "</w>"
MAX_VOCABULARY_BYTES = 64 << 20
CACHE_WORDS = 200_000
_TRIES: dict[str, "SubwordTrie"] = {}


class SubwordTrie:
    """Nested dictionaries by character; a node's "" tells which kinds of piece end there:
    1 inside a word, 2 at its end, 3 both."""

    def __init__(self, pieces: Iterable[str]):
        self.root: dict = {}
        self.known: dict[str, int] = {}
        for p in pieces:
            kind, text = (2, p[:-len(WORD_END)]) if p.endswith(WORD_END) else (1, p)
            if not text:
                continue
            node = self.root
            for c in text:
                node = node.setdefault(c, {})
            node[""] = node.get("", 0) | kind

    def cut(self, word: str) -> list[str]:
        out, at, n = [], 0, len(word)
        while at < n:
            node, best, i = self.root, at + 1, at
            while i < n and (node := node.get(word[i])) is not None:
                i += 1
                if node.get("", 0) & (2 if i == n else 1):
                    best = i
            out.append(word[at:best])
            at = best
        return out

    def count(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            n = self.known[word] = len(self.cut(word))
        return n


def read_pieces(path: str) -> list[str]:
    """The pieces of a byte-level tokenizer file in JSON (its ``model.vocab``) as text, in
    order of their ids; pieces that are no whole characters are left out.  The file's size
    is checked: the list is broadcast."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    vocab = json.loads(raw)["model"]["vocab"]
    # the file writes a byte as one character: printable ones as themselves, the others from 256 on
    plain = [b for b in range(256) if 33 <= b < 127 or b > 160 and b != 173]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}

    def text(piece: str) -> str:
        end = piece.endswith(WORD_END)
        body = bytes(byte.get(c, 255) for c in (piece[:-len(WORD_END)] if end else piece))
        return body.decode("utf-8", "replace") + WORD_END * end

    return [t for t in (text(p) for p in sorted(vocab, key=vocab.get)) if t and "\uFFFD" not in t]


def trie_of(key: str, pieces: Broadcast) -> SubwordTrie:
    """One trie per Python worker and vocabulary."""
    if key not in _TRIES:
        _TRIES[key] = SubwordTrie(pieces.value)
    return _TRIES[key]


def fitting_words(spark: SparkSession, pieces: list[str], max_len: int = 256) -> Callable[[Column, Column], Column]:
    """A function (query tokens, passage tokens) -> how many leading passage words fit,
    whole, next to the query in a model input of ``max_len`` subwords."""
    shared = spark.sparkContext.broadcast(pieces)
    key = hashlib.sha256("\n".join(pieces).encode()).hexdigest()

    @F.pandas_udf("int")
    def fit(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        trie = trie_of(key, shared)
        for queries, passages in batches:
            out = []
            for q, p in zip(queries, passages):
                room = max_len - PAIR_SPECIAL_TOKENS - sum(map(trie.count, q if q is not None else ()))
                n = 0
                for word in p if p is not None else ():
                    room -= trie.count(word)
                    if room < 0:
                        break
                    n += 1
                out.append(n)
            yield pd.Series(out, dtype="int32")

    return fit


def budget_subwords(pairs: DataFrame, pieces: list[str], max_len: int = 256) -> DataFrame:
    """Add ``input_tokens``, the leading words of ``ptokens`` that fit next to
    ``qtokens``.  A query that leaves no room, null and empty arrays give none."""
    fit = fitting_words(pairs.sparkSession, pieces, max_len)
    none = F.array().cast("array<string>")
    return pairs.withColumn("input_tokens", F.slice(F.coalesce("ptokens", none), F.lit(1), fit("qtokens", "ptokens")))
