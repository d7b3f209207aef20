"""Packed token-id files (operator 2).

File format: a Parquet folder of *blocks*.  The documents, in ascending ``doc_id``
order, are cut into shards (one per task of the range sort) and each shard into
blocks of whole documents, about ``block_tokens`` ids each (a longer document is a
block of its own).  A block holds

    shard int, block int      place in the whole order
    shard_start long          ids of the shard before this block
    n_tokens long, bits int   ids in the block, bits of one id
    doc_id array<long>        its documents, in order
    offset array<long>        len(doc_id)+1 positions: document i is ids[offset[i]:offset[i+1]]
    payload binary            ids at fixed width, least significant bit first

Every id takes ``bits`` = the least number of bits that hold the vocabulary, so id k of
a block starts at bit k*bits: any range can be cut out and unpacked by numpy without
reading what lies before it (``unpack(payload, bits, start, stop)``).  Blocks are
small rows, so reading is bounded in memory and splits over tasks, and Spark's commit
protocol makes lost or repeated tasks harmless.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import CACHE_CHARS, broadcast_vocabulary, byte_alphabet, cut_words, joined_word, literal, model_of, slices

BLOCK_TOKENS = 65_536
# Words a Python worker keeps (about 200 bytes each; all are dropped when full).
MAX_WORDS = 1_000_000
# Shard offsets are broadcast: one row per shard, refused above this many.
MAX_SHARDS = 1_000_000
BLOCK_SCHEMA = ("shard int, block int, shard_start long, n_tokens long, bits int, "
                "doc_id array<long>, offset array<long>, payload binary")
_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("shard_start", pa.int64()),
                    ("n_tokens", pa.int64()), ("bits", pa.int32()), ("doc_id", pa.list_(pa.int64())),
                    ("offset", pa.list_(pa.int64())), ("payload", pa.binary())])


# -- bit packing ---------------------------------------------------------------------------
def bits_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width little-endian bit string of ``ids``."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(rows[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start``..``stop`` (exclusive) of a packed block, as unsigned 32-bit integers."""
    n = max(0, stop - start)
    first, last = start * bits // 8, (stop * bits + 7) // 8
    raw = np.frombuffer(payload, dtype=np.uint8)[first:last]
    if bits in (8, 16, 32):
        return raw.view(f"<u{bits // 8}").astype("<u4")
    skip = start * bits - first * 8
    rows = np.unpackbits(raw, bitorder="little")[skip:skip + n * bits].reshape(n, bits)
    wide = np.zeros((n, 32), dtype=np.uint8)
    wide[:, :bits] = rows
    return np.packbits(wide, axis=1, bitorder="little").reshape(-1).view("<u4")


# -- encoding with the tokenizers library ---------------------------------------------------
class Joined(Exception):
    """A word that cannot be encoded on its own."""


class Words(dict):
    """Word -> ids as bytes; a new word is learned when it is asked for."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        ids = self.learn(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = ids
        return ids


def cuts_at_words(spec: bytes) -> bool:
    """Does the vocabulary file cut texts as ``cut_words`` takes for granted: plain byte-level
    BPE with its usual pattern, and nothing that changes the text before or the ids after?"""
    d = json.loads(spec)
    model, pre, post = d["model"], d.get("pre_tokenizer") or {}, d.get("post_processor") or {}
    return (model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and not d.get("normalizer") and post.get("type") in (None, "ByteLevel")
            and not any(model.get(k) for k in ("byte_fallback", "ignore_merges", "dropout", "continuing_subword_prefix",
                                               "end_of_word_suffix", "unk_token")))


class LibraryEncoder:
    """The tokenizers library behind a cache of words (a vocabulary that cuts texts another
    way goes through the library's whole pipeline).  A word of letters is one pre-token
    and goes to the library's BPE model at once; other words, and texts that cannot be
    cut into words, go through its whole pipeline."""

    def __init__(self, spec: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_buffer(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.words = Words(self._learn)
        self.by_words = cuts_at_words(spec)
        # bytes (as Latin-1 characters) to the characters of the vocabulary
        self.alphabet = {byte: char for char, byte in byte_alphabet().items()}

    def _whole(self, text: str) -> bytes:
        return array("i", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, piece: str) -> bytes:
        """Ids of one pre-token: letters, perhaps after a space."""
        said = piece.encode().decode("latin-1").translate(self.alphabet)
        return array("i", [t.id for t in self.model.tokenize(said)]).tobytes()

    def _learn(self, word: str) -> bytes:
        if joined_word(word) or any(a in word for a in self.added):
            raise Joined
        if word.isalpha():
            return self._letters(" " + word)
        if word[0] in "\n.," and word[1:].isalpha():
            return self._whole(word[0]) + self._letters(word[1:])
        return self._whole(literal(word))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype="<i4")
        words = cut_words(text) if self.by_words else None
        try:
            if words is None or joined_word(words[0]):
                raise Joined
            first = words.pop(0)
            ids = self._whole(first) + b"".join(map(self.words.__getitem__, words))
        except Joined:
            ids = self._whole(text)
        return np.frombuffer(ids, dtype="<i4")


# -- writing and reading --------------------------------------------------------------------
def write_tokens(df: DataFrame, path: str, vocabulary: str, end_id: int | None = None,
                 text_col: str = "text", id_col: str = "doc_id", block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every whole text, append ``end_id`` and write the packed files to ``path``.

    Null texts count as empty, null ids come first; repeated ids keep all their rows
    (ordered by a hash of the text).  Only the two named columns are read.  An empty
    table writes a folder without blocks.
    """
    spec = broadcast_vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = model_of(LibraryEncoder, spec.value)
        bits = bits_for(max(enc.size, (end_id or 0) + 1))
        shard = TaskContext.get().partitionId()
        end = np.array([] if end_id is None else [end_id], dtype="<i4")
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        offset, block, before = [0], 0, 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(parts) if parts else np.empty(0, dtype="<i4")
            row = (shard, block, before, len(flat), bits, ids, offset, pack(flat, bits))
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, _ARROW)],
                                              schema=_ARROW)

        for b in slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = enc.encode(text)
                n = len(got) + len(end)
                if ids and offset[-1] + n > block_tokens:
                    yield flush()
                    before, block = before + offset[-1], block + 1
                    ids, parts, offset = [], [], [0]
                ids.append(doc)
                parts += [got, end]
                offset.append(offset[-1] + n)
        if ids:
            yield flush()

    (df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
     .withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
     # (an id, or a row, that holds a third of the table is cut into many ranges)
     .repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")
     .mapInArrow(run, BLOCK_SCHEMA).write.mode("errorifexists").parquet(path))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``: ids of all documents before the block.

    Only one row per shard is summed over all shards; blocks carry their place in
    their shard."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    n = shards.count()
    if n > MAX_SHARDS:
        raise ValueError(f"{n} shards; write with fewer partitions")
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("total").over(w), F.lit(0)).alias("shard_offset"))
    return (blocks.join(F.broadcast(starts), "shard")
            .withColumn("start", F.col("shard_offset") + F.col("shard_start")).drop("shard_offset"))


def read_documents(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers) and, if asked for, token_ids (array of long)."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
                     *([("token_ids", pa.list_(pa.int64()))] if ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                at = np.array(r["offset"], dtype=np.int64)
                flat = unpack(r["payload"], r["bits"], 0, r["n_tokens"])
                crc = [zlib.crc32(flat[s:e].tobytes()) for s, e in zip(at[:-1], at[1:])]
                columns = [pa.array(r["doc_id"], type=pa.int64()), pa.array(r["start"] + at[:-1]), pa.array(np.diff(at)),
                           pa.array(crc, type=pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return read_blocks(spark, path).select("start", "n_tokens", "bits", "doc_id", "offset", "payload").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<long>" * ids)
