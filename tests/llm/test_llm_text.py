"""Operators 5 and 7 against brute force, held-out accuracy and edge tables."""

import hashlib
import random
import re
import zlib

import numpy as np

from rankfold.llm import langid, q_text, secrets
from rankfold.llm.q_tokens import documents

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"


# -- 5 ---------------------------------------------------------------------------------------
def brute_base(text):
    out = []
    for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                         text, re.I | re.A):
        if len(m[1]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_base_spans_equal_matching_and_dropping():
    rng = random.Random(1)
    parts = ["token", "Secret", "api_key", "APIKEY", "password", "=", ":", " ", '"', "'", "abc", "deadbeef00", "AKIA",
             "ABCDEFGH12", "x", "é", "ſecret", "/", ".", "0123456789abcdef", "\n", "-"]
    for _ in range(6000):
        s = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert secrets.base_spans(s) == brute_base(s), s


def test_op5_query_keeps_all_base_spans(spark):
    rows = {r.doc_id: r for r in q_text.op5_secrets(spark, DIR).collect()}
    texts = {r.doc_id: r.text or "" for r in documents(spark, DIR).collect()}
    assert rows.keys() == texts.keys()
    for doc, text in texts.items():
        base = brute_base(text)
        said = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        r = rows[doc]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))


def planted_secrets(spark, folder, n=1500):
    """Documents of words, every tenth with a random string that no base pattern matches."""
    rng = random.Random(11)
    words = re.findall(r"[a-z]{2,}", " ".join(r.text or "" for r in documents(spark, "/root/testdata/sf0.01").limit(200).collect()))
    rows, keys = [], {}
    for i in range(n):
        text = " ".join(rng.choices(words, k=60))
        if i % 10 == 1:
            key = "".join(rng.choices(secrets.ALPHABET[:62], k=rng.choice([12, 16, 19, 24, 40])))
            if secrets.base_spans(f" {key} "):
                continue
            keys[i] = (len(text) + 1, len(text) + 1 + len(key))
            text += f" {key} " + " ".join(rng.choices(words, k=20))
        elif i % 20 == 0:
            text += f' api_key = "{"".join(rng.choices(secrets.ALPHABET[:62], k=24))}"'
        rows.append((i, text))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return keys


def test_op5_query_finds_planted_strings_that_the_base_misses(spark, tmpdir_path):
    keys = planted_secrets(spark, tmpdir_path)
    rows = {r.doc_id: [tuple(x.split(":")) for x in filter(None, r.spans.split(","))] for r in q_text.op5_secrets(spark, tmpdir_path).collect()}
    found = {d: [(int(s), int(e)) for k, s, e in v if k == "random"] for d, v in rows.items()}
    assert sum(k in found[d] for d, k in keys.items()) >= 0.98 * len(keys)
    assert sum(len(v) for d, v in found.items() if d not in keys) <= 1


def test_token_ratios_equal_token_by_token_sums():
    rng = random.Random(6)
    ratio = np.random.default_rng(1).normal(size=len(secrets.ALPHABET) ** 2)
    for _ in range(800):
        text = "".join(rng.choices("aB3/= é漢.,?deadbeef01" + "f" * 6, k=rng.randint(1, 90)))
        spans = secrets.base_spans(text)
        want = [(s, e, ratio[secrets.transitions(text[s:e])].sum()) for s, e in secrets.outside(text, spans)]
        got = list(zip(*secrets.token_ratios(text, spans, ratio)))
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want]), text


def test_parts_of_a_token_beside_a_base_span_are_scored(spark):
    model = secrets.fit(documents(spark, "/root/testdata/sf0.01"))
    text = "see kQ9zX2vB7nW4jR=deadbeefdeadbeef0=tY6uP3mZ8cH5gL1 here"
    kinds = [(secrets.KINDS[k], text[s:e]) for s, k, e in secrets.scan_text(text, model)]
    assert kinds == [("random", "kQ9zX2vB7nW4jR="), ("hex", "deadbeefdeadbeef0"), ("random", "=tY6uP3mZ8cH5gL1")]


def test_markov_models_part_random_strings_from_identifiers(spark):
    ratio = secrets.fit(documents(spark, "/root/testdata/sf0.01"))
    rng = random.Random(2)
    secret = ["".join(rng.choices(secrets.ALPHABET[:64], k=32)) for _ in range(300)]
    plain = re.findall(r"[a-z]{4,}", " ".join(r.text or "" for r in documents(spark, DIR).collect()))
    names = ["".join(rng.choices(plain, k=8))[:40] for _ in range(300)]
    caught = sum(bool(secrets.scan_text(f"see {s} here", ratio)) for s in secret)
    wrong = sum(bool(secrets.scan_text(f"see {s} here", ratio)) for s in names)
    assert caught >= 285 and wrong <= 3


def test_op5_edges(spark):
    rows = [(1, None, None), (2, "", None), (None, "token = abcdefghijklmnop", "x"), (3, "é token: 0123456789abcdef", None),
            (3, "é token: 0123456789abcdef", None), (4, "w " * 60_000 + "AKIA" + "A" * 20, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = secrets.scan(df, secrets.fit(df)).collect()
    assert len(got) == 6
    by = {r.doc_id: [(s.start, s.end, s.kind) for s in r.secrets] for r in got}
    assert by[1] == by[2] == [] and by[4] == [(120_000, 120_024, "access")]
    assert by[3] == [(2, 25, "assign"), (9, 25, "hex")]
    none = spark.createDataFrame([], SCHEMA)
    assert secrets.scan(none, secrets.fit(none)).count() == 0
    clash = secrets.scan(df.withColumnRenamed("lang", "Secrets"), secrets.fit(df))
    assert clash.columns == ["doc_id", "text", "secrets"] and clash.count() == 6


# -- 7 ---------------------------------------------------------------------------------------
def test_op7_held_out_accuracy_and_split(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in q_text.op7_langid(spark, d).collect()}
    docs = documents(spark, d).collect()
    assert len(rows) == len(docs)
    for r in docs:
        assert rows[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    test = [r for r in docs if rows[r.doc_id].held_out]
    right = sum(rows[r.doc_id].lang_pred == r.lang for r in test)
    assert right >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_op7_never_learns_from_held_out_rows(spark):
    docs = documents(spark, DIR)
    a = langid.fit(docs)
    spoiled = docs.withColumn("lang", q_text.F.when(langid.held_out(docs.doc_id), "zz").otherwise(docs.lang))
    b = langid.fit(spoiled)
    assert a.langs == b.langs and np.array_equal(a.w, b.w)


def test_op7_whole_texts_count(spark):
    model = langid.fit(documents(spark, DIR))
    text = {r.lang: r.text for r in documents(spark, DIR).collect() if len(r.text or "") > 1500}
    p = model.texts([text["en"][:1500] + text["fr"] * 20])
    assert model.langs[p[0].argmax()] == "fr"


def test_op7_edges(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "123 456", "en"), (None, "the and of", None), (4, "the and of", "en"),
            (4, "the and of", "en"), (5, "de la " * 30_000, "fr"), (6, "le des et", "fr"), (7, "of the and", "en")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = langid.predict(df, langid.fit(df)).collect()
    assert len(got) == len(rows) and got[0].score == 0
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert langid.fit(spark.createDataFrame([], SCHEMA)) is None
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    clash = langid.predict(df.withColumnRenamed("lang", "Score"), None)
    assert clash.columns == ["doc_id", "text", "lang_pred", "score"] and clash.count() == len(rows)
