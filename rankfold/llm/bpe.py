"""Byte-level BPE encoding and decoding (operator 1).

Encoder: every token is put into an Aho-Corasick automaton; one pass over a piece
of text gives the longest token at each position.  Tokens are laid left to right,
longest first; a token is accepted only if it is *compatible* with the token before
it, i.e. if BPE applied to the two together gives exactly these two.  When no prefix
of the longest match fits, the position is marked dead and the previous token is
shortened (backtracking).  Each position dies at most once, so the work is linear.
A sequence whose neighbours are all compatible is the one the merge rules produce.

Decoder: the bytes of all tokens lie in one blob; an offset table turns a vector of
ids into the vector of blob positions to gather.

Text is cut into words first (cached: natural text repeats its words), and words into
pre-tokens by the public byte-level pattern.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .held import cache

# The pre-token pattern of byte-level BPE vocabularies (public).  The
# alternatives start with different characters except the last three, whose order
# matters; letters come first because most pre-tokens are letters.
PRETOKEN = r" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A vocabulary file above this size is refused: it is read on the driver and broadcast.
MAX_VOCAB_BYTES = 64 << 20
# Words, and pre-tokens, in each of the two halves kept per Python worker (about 200 bytes an
# entry), and the longest kept string.
CACHE_WORDS = 150_000
CACHE_CHARS = 64
# Pairs of tokens whose compatibility is kept (emptied when full).
MAX_STEPS = 500_000
# Rows worked on at a time, so that ids and texts of a whole Arrow batch never lie in
# memory together.
SLICE_ROWS = 1_000


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for
    themselves, the others are numbered from U+0100 in ascending order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in printable}
    others = [b for b in range(256) if b not in set(printable)]
    table.update({chr(256 + i): b for i, b in enumerate(others)})
    return table


def read_vocabulary(d: dict) -> tuple[dict[bytes, int], list[bytes]]:
    """(token bytes -> id, id -> bytes with added tokens) of a vocabulary file's JSON."""
    alphabet = byte_alphabet()
    vocab = {bytes(alphabet[c] for c in t): i for t, i in d["model"]["vocab"].items()}
    of_id = [b""] * (1 + max([*vocab.values(), *(a["id"] for a in d["added_tokens"])]))
    for t, i in vocab.items():
        of_id[i] = t
    for a in d["added_tokens"]:
        of_id[a["id"]] = a["content"].encode()
    return vocab, of_id


class Decoder:
    """The bytes of all tokens in one blob, and the offset of each."""

    def __init__(self, spec: bytes):
        of_id = read_vocabulary(json.loads(spec))[1]
        self.size = len(of_id)
        self.offsets, self.blob = offset_table(of_id)

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD, unknown ids give nothing."""
        ids = np.asarray(ids, dtype=np.int64)
        known = (ids >= 0) & (ids < self.size)
        got = gather(ids if known.all() else ids[known], self.offsets, self.blob)
        return got.decode("utf-8", "replace")


class Words(dict):
    """Word -> value; a new word is learned when it is asked for.  When ``CACHE_WORDS`` are
    held they become the older half, from which a word asked for again is taken over; the older
    half before them goes.  So frequent words are never learned twice, however many rare ones
    pass."""

    def __init__(self, learn: Callable[[str], bytes | None]):
        self.learn = learn
        self.older: dict[str, bytes | None] = {}

    def __missing__(self, word: str) -> bytes | None:
        got = self.older.get(word, _MISSING)
        if got is _MISSING:
            got = self.learn(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = got
        return got


class BpeModel:
    """Tables of one vocabulary, built from the JSON text of a byte-level BPE file."""

    def __init__(self, spec: bytes):
        d = json.loads(spec)
        m, pre = d["model"], d.get("pre_tokenizer") or {}
        if (m.get("type") != "BPE" or pre.get("type") != "ByteLevel" or d.get("normalizer")
                or pre.get("add_prefix_space") or not pre.get("use_regex", True)
                or m.get("byte_fallback") or m.get("ignore_merges")
                or m.get("continuing_subword_prefix") or m.get("end_of_word_suffix")):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        alphabet = byte_alphabet()
        vocab, of_id = read_vocabulary(d)
        self.size = len(of_id)
        # merges: pair -> merged id (ids must ascend with the merge order), merged id -> its halves
        self.pair: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(self.size)), list(range(self.size))
        before = -1
        for merge in m["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            ba, bb = (bytes(alphabet[c] for c in x) for x in (a, b))
            i, j, k = vocab[ba], vocab[bb], vocab[ba + bb]
            if k <= before:
                raise ValueError("token ids must follow the order of the merges")
            before = k
            self.pair[i, j] = k
            self.left[k], self.right[k] = i, j
        self.steps: dict[int, int] = {}  # a * size + b -> ``step(a, b)``
        # a token that its own bytes do not encode to never occurs in an encoding
        self.ids = {t: i for t, i in vocab.items()
                    if self.left[i] == i or self._fits(self.left[i], self.right[i], i)}
        self.shorter = [-1] * self.size
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t.decode("latin-1"), i)
            self.shorter[i] = next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1)
        self.automaton.make_automaton()
        self.lengths = [len(t) for t in of_id]
        self.back = [len(t) - 1 for t in of_id]
        # added tokens: looked for in the raw text first (earliest, then longest)
        self.added = {a["content"]: a["id"] for a in d["added_tokens"]}
        if any(a.get(k) for a in d["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that strip or need word borders are not supported")
        alts = sorted((k for k in self.added if k), key=len, reverse=True)
        self.added_re = regex.compile("(" + "|".join(map(regex.escape, alts)) + ")") if alts else None
        self.pre = regex.compile(PRETOKEN)
        self.words = Words(self._learn)
        self.pieces = Words(self._learn_piece)

    # -- compatibility -----------------------------------------------------------------
    def _fits(self, a: int, b: int, limit: int) -> bool:
        """No merge earlier than ``limit`` joins the end of ``a`` with the start of ``b``.

        The merges that built a and b are undone from the latest to the earliest; at
        each step the two tokens touching the border must not have been mergeable
        before the later of them was built."""
        while True:
            k = self.pair.get((a, b))
            if k is not None and k < limit:
                return False
            a_made, b_made = self.left[a] != a, self.left[b] != b
            if not a_made and not b_made:
                return True
            if a_made and (a > b or not b_made):
                limit = a
                a = self.right[a]
            else:
                limit = b + 1
                b = self.left[b]

    def step(self, a: int, b: int) -> int:
        """The longest of ``b`` and the tokens it starts with that is compatible with ``a``
        (-1: any) before it; -1 if none is."""
        if len(self.steps) >= MAX_STEPS:
            self.steps.clear()
        at = a * self.size + b
        while b >= 0 and a >= 0 and not self._fits(a, b, self.size):
            b = self.shorter[b]
        self.steps[at] = b
        return b

    # -- encoding ----------------------------------------------------------------------
    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        best = [-1] * (n + 1)
        lengths, back, shorter, steps, size = self.lengths, self.back, self.shorter, self.steps, self.size
        for end, tok in self.automaton.iter(piece.decode("latin-1")):
            best[end - back[tok]] = tok  # later ends are longer: the last one wins
        dead: set[int] = set()
        out: list[int] = []
        pos, tok, last = 0, best[0], -1
        while pos < n:
            if tok >= 0:
                fit = steps.get(last * size + tok)
                tok = self.step(last, tok) if fit is None else fit
            if tok >= 0:
                end = pos + lengths[tok]
                if end in dead:
                    tok = shorter[tok]
                else:
                    out.append(tok)
                    pos, last, tok = end, tok, best[end]
            else:  # nothing fits here: this position is dead, shorten the token before it
                if not out:
                    raise ValueError("the vocabulary does not cover all bytes")
                dead.add(pos)
                out.pop()
                pos -= lengths[last]
                tok = shorter[last]
                last = out[-1] if out else -1
        return out

    def _encode_plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pre.findall(text)))

    def _learn_piece(self, piece: str) -> bytes:
        return array("i", self.encode_piece(piece.encode())).tobytes()

    def _encode_any(self, text: str) -> bytes:
        if self.added_re is None:
            return self._encode_plain(text)
        parts = self.added_re.split(text)
        return b"".join(np.int32(self.added[p]).tobytes() if i % 2 else self._encode_plain(p)
                        for i, p in enumerate(parts) if p)

    def encode(self, text: str | None) -> np.ndarray:
        return encode_words(text, self.words, self._encode_any)

    def _learn(self, word: str) -> bytes | None:
        if self.added_re is None or not self.added_re.search(word):
            if _LETTERS(word):  # one pre-token, with the space before it
                return self._learn_piece(" " + word)
            if not joined_word(word):
                return array("i", [i for p in self.pre.findall(literal(word)) for i in self.encode_piece(p.encode())]).tobytes()
        return None


# A symbol right before a full stop or comma: the two are one pre-token.
_SYMBOLS = re.compile(r"[.,](?<=[^\w\s].|_.)")
# (letters in every version of Unicode)
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
_MISSING = b"?"


def joined_word(word: str) -> bool:
    """True if ``word`` (a piece as cut by ``cut_words``) touches other white space, so
    that it cannot be encoded on its own."""
    body = word[1:] if word[:1] == "\n" else word
    return not body or body[0].isspace() or body[-1].isspace()


def cut_words(text: str) -> list[str] | None:
    """Pieces of ``text`` that always end and start pre-tokens, or None.

    A space before a non-space starts a pre-token; so do a single line feed, and a full
    stop or comma that no symbol precedes.  Pieces that start with one of these three
    are literal, all but the first of the others stand for a space and themselves.
    """
    if _SYMBOLS.search(text):
        return None
    return text.replace("\n", " \n").replace(".", " .").replace(",", " ,").split(" ")


def literal(word: str) -> str:
    return word if word[0] in "\n.," else " " + word


def encode_words(text: str | None, known: Words, whole: Callable[[str], bytes]) -> np.ndarray:
    """Ids of ``text`` from the ids of its words as bytes, None for a word by which the text
    must be encoded by ``whole``: white space touches white space or a full stop, or there is
    an added token."""
    if not text:
        return np.empty(0, dtype="<i4")
    words = cut_words(text)
    if words is None or joined_word(words[0]):
        return np.frombuffer(whole(text), dtype="<i4")
    first = words.pop(0)
    got = list(map(known.__getitem__, words))
    if None in got:
        return np.frombuffer(whole(text), dtype="<i4")
    return np.frombuffer(whole(first) + b"".join(got), dtype="<i4")


def offset_table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of len+1, blob) of a list of byte strings."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return offsets, np.frombuffer(b"".join(parts), dtype=np.uint8)


def gather(ids: np.ndarray, offsets: np.ndarray, blob: np.ndarray) -> bytes:
    """The byte strings of ``ids`` one after another."""
    starts = offsets[ids]
    lens = offsets[ids + 1] - starts
    ends = np.cumsum(lens)
    if not len(ends) or ends[-1] == 0:
        return b""
    at = np.arange(ends[-1], dtype=np.int64)
    at += np.repeat(starts - (ends - lens), lens)
    return blob[at].tobytes()


# -- Spark side --------------------------------------------------------------------------
def model_of(kind: type, spec: bytes):
    """One BpeModel or Decoder per Python process and vocabulary, until another operator's
    words take its place."""
    models = cache("bpe")
    key = kind, hashlib.sha256(spec).hexdigest()
    if key not in models:
        models[key] = kind(spec)
    return models[key]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def broadcast_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file, read once on the driver, its size checked, broadcast."""
    with open(path, "rb") as f:
        spec = f.read(MAX_VOCAB_BYTES + 1)
    if len(spec) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCAB_BYTES} bytes")
    return spark.sparkContext.broadcast(spec)


def with_fields(df: DataFrame, source: str, **fields: T.DataType) -> tuple[DataFrame, T.StructType]:
    """(``df`` without columns named like the new ones, its schema with them at the end):
    as with ``withColumn``, a new column replaces one of the same name.  The column that
    is read cannot be replaced."""
    names = {n.lower() for n in fields}
    if source.lower() in names:
        raise ValueError(f"the result cannot replace the column {source!r} it is made from")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    return df, T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in fields.items())])


def _text_column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "token_ids") -> DataFrame:
    """Add ``out`` (array of int): the ids of the whole text.

    Null and empty texts give an empty array.  All other columns pass through; a
    column already named ``out`` is replaced.  Rows are independent: repeated rows give
    repeated results, an empty table an empty one.
    """
    df, schema = with_fields(df, text_col, **{out: T.ArrayType(T.IntegerType(), False)})
    spec = broadcast_vocabulary(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(BpeModel, spec.value)
        for b in slices(batches):
            ids = [model.encode(t) for t in _text_column(b, text_col)]
            ends = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = np.concatenate(ids) if ids else np.empty(0, dtype="<i4")
            col = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, col], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (string): the text of the ids in ``ids_col`` (null: empty), special
    tokens included.  Ids that the vocabulary lacks, and null ids, give nothing.  A column
    already named ``out`` is replaced."""
    df, schema = with_fields(df, ids_col, **{out: T.StringType()})
    spec = broadcast_vocabulary(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(Decoder, spec.value)
        for b in slices(batches):
            col = b.column(b.schema.get_field_index(ids_col))
            at = col.offsets.to_numpy()
            flat = col.values.slice(at[0], at[-1] - at[0]).fill_null(-1).to_numpy(zero_copy_only=False)
            at = at - at[0]
            ok = col.is_valid().to_numpy(zero_copy_only=False)
            texts = [model.decode(flat[s:e]) if v else "" for s, e, v in zip(at[:-1], at[1:], ok)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, type=pa.string())],
                                             names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)
