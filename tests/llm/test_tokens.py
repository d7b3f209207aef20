"""Operators 1 and 2 against the tokenizers library, and exact round trips."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from rankfold.llm import bpe, q_tokens, token_files

DIR = "/root/testdata/sf0.001"
PARTS = ["a", "b", "the", "é", "ß", "1", "23", " ", "  ", "\n", "\n\n", "\t", "\r", "'s", "'ll", "don't", "...",
         "<|endoftext|>", " ", " ", "中文", "😀", "\x1c", "\x85", "²", "_", "-", "́", "aaaaaaaa", "\x00",
         "'", ".", ",", " .", "!,", "_.", "Ⅷ"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(q_tokens.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def spec():
    with open(q_tokens.vocabulary_path(), "rb") as f:
        return f.read()


def test_encoders_equal_the_library_on_random_texts(library, spec):
    model, cached, back = bpe.BpeModel(spec), token_files.LibraryEncoder(spec), bpe.Decoder(spec)
    rng = random.Random(5)
    for _ in range(4000):
        s = "".join(rng.choices(PARTS, k=rng.randint(0, 14)))
        want = library.encode(s, add_special_tokens=False).ids
        assert model.encode(s).tolist() == want, s
        assert cached.encode(s).tolist() == want, s
        assert back.decode(want) == library.decode(want, skip_special_tokens=False), s


def test_frequent_words_are_learned_once(library, spec, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    model, learned = bpe.BpeModel(spec), []
    encode_piece = model.encode_piece
    model.encode_piece = lambda piece: learned.append(piece) or encode_piece(piece)
    for i in range(60):
        text = f"the frequentword rare{'abcdef'[i % 6]}{'ghijklmnop'[i // 6]}word frequentword\nwörd. Two  spaces" + "!" * (i % 3)
        assert model.encode(text[:-12] if i % 2 else text).tolist() == library.encode(
            text[:-12] if i % 2 else text, add_special_tokens=False).ids
    assert learned.count(b" frequentword") <= 2  # as a word, and as a pre-token of whole texts


def test_words_of_all_kinds_are_learned_as_the_library_encodes_them(library, spec):
    model = bpe.BpeModel(spec)
    rng = random.Random(8)
    letters = "aeinrstüöäßéñçÀÿªµº×÷ŉſ中²1'#$*_"
    for _ in range(3000):
        s = "x " + " ".join("".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(3)) + rng.choice(["", ".", " <|endoftext|>", ",", "!."])
        assert model.encode(s).tolist() == library.encode(s, add_special_tokens=False).ids, s
        assert bool(bpe._SYMBOLS.search(s)) == bool(re.search(r"(?:[^\w\s]|_)[.,]", s)), s


def test_very_long_pieces_are_linear(library, spec):
    model = bpe.BpeModel(spec)
    for s in ("ab" * 50_000, " " * 50_000 + "x", "é" * 20_000):
        assert model.encode(s).tolist() == library.encode(s, add_special_tokens=False).ids


def test_decode_of_broken_and_unknown_ids(library, spec):
    model = bpe.Decoder(spec)
    rng = random.Random(6)
    for _ in range(500):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 6))]
        assert model.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert model.decode([10 ** 6, -1]) == ""


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 32])
def test_packing_round_trip_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 2 ** bits, 1000, dtype=np.uint64).astype("<u4")
    payload = token_files.pack(ids, bits)
    assert len(payload) == (1000 * bits + 7) // 8
    for s, e in ((0, 1000), (0, 0), (17, 18), (333, 901), (1000, 1000)):
        assert token_files.unpack(payload, bits, s, e).tolist() == ids[s:e].tolist()
    assert token_files.bits_for(50_257) == 16 and token_files.bits_for(1) == 1 and token_files.bits_for(256) == 8


SCHEMA = "doc_id long, text string, lang string"
EDGE = [(5, "a b", None), (1, None, "x"), (2, "", None), (2, "twice", None), (2, "twice", None), (None, "no id", None),
        (9, "word " * 30_000, None), (7, "<|endoftext|> x", None)]


def test_op1_edge_rows_and_clashing_names(spark, library):
    df = spark.createDataFrame(EDGE, SCHEMA)
    path = q_tokens.vocabulary_path()
    rows = bpe.decode(bpe.encode(df, path), path).collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    assert bpe.encode(spark.createDataFrame([], SCHEMA), path).count() == 0
    clash = bpe.encode(df.withColumnRenamed("lang", "Token_IDs"), path)
    assert clash.columns == ["doc_id", "text", "token_ids"] and clash.count() == len(EDGE)


def test_op1_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text for r in q_tokens.documents(spark, DIR).collect()}
    rows = q_tokens.op1_bpe(spark, DIR).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def brute_op2(rows, library):
    start, out = 0, []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_op2_query_equals_the_library(spark, library):
    src = sorted((r.doc_id, r.text) for r in q_tokens.documents(spark, DIR).collect())
    got = sorted(map(tuple, q_tokens.op2_token_files(spark, DIR).collect()))
    assert got == brute_op2(src, library)


def test_op2_edges(spark, library, tmpdir_path):
    df = spark.createDataFrame(EDGE, SCHEMA).repartition(3)
    path = os.path.join(tmpdir_path, "files")
    token_files.write_tokens(df, path, q_tokens.vocabulary_path(), end_id=2, block_tokens=4)
    got = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 2, 5, 7, 9]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    for r in got:
        assert r.token_ids[-1] == 2 and len(r.token_ids) == r.n_tokens
    assert sorted(library.decode(r.token_ids[:-1], skip_special_tokens=False) for r in got) \
        == sorted((t or "") for _, t, _ in EDGE)
    empty = os.path.join(tmpdir_path, "none")
    token_files.write_tokens(spark.createDataFrame([], SCHEMA), empty, q_tokens.vocabulary_path(), end_id=2)
    assert token_files.read_documents(spark, empty).count() == 0
    assert isinstance(df.schema, T.StructType)
