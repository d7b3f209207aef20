"""Operator 13 against brute force, and edge tables."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from rankfold.llm import periodic, q_words
from rankfold.llm.q_tokens import documents

DIR = "/root/testdata/sf0.001"


def brute_runs(ws):
    out = []
    for q in range(1, len(ws) // 4 + 1):
        i = 0
        while i + q < len(ws):
            if ws[i] != ws[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(6, 4 * q) and not any(ws[s:e - r] == ws[s + r:e] for r in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(ws, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def some_words(rng):
    ws = []
    for _ in range(rng.randint(0, 6)):
        kind = rng.random()
        if kind < 0.3:
            ws += rng.choices("abc", k=rng.randint(0, 30))
        elif kind < 0.8:
            p = rng.choices("abcdefgh"[:rng.randint(1, 8)], k=rng.randint(1, rng.choice([3, 8, 30])))
            ws += p * rng.randint(1, 8) + p[:rng.randint(0, len(p))]
        else:
            ws += (rng.choices("ab", k=rng.randint(1, 3)) * rng.randint(2, 8) + ["z"]) * rng.randint(1, 6)
    return ws


def test_runs_equal_brute_force_on_repetitive_words():
    rng = random.Random(5)
    n = 0
    for _ in range(700):
        docs = [some_words(rng) for _ in range(rng.randint(1, 6))]
        for ws, (runs, rest) in zip(docs, periodic.scan_texts([" ".join(ws) if ws else rng.choice([None, "", " \n"]) for ws in docs])):
            want = brute_runs(ws)
            n += len(want)
            assert runs == want and rest == collapse(ws, want), ws
    assert n > 3000


def test_long_texts_of_one_period_and_of_nested_ones():
    one = ["x"] * 50_000
    fib = ["a"], ["a", "b"]
    while len(fib[1]) < 900:
        fib = fib[1], fib[1] + fib[0]
    nested = (["p", "q"] * 40 + ["r"]) * 30
    big = [str(i) for i in range(700)] * 5
    got = periodic.scan_texts([" ".join(w) for w in (one, fib[1], nested, big)])
    assert got[0] == ([(0, 50_000, 1)], "x")
    assert got[1][0] == brute_runs(fib[1])
    assert got[2][0] == brute_runs(nested) and (0, 2430, 81) in got[2][0]
    assert got[3] == ([(0, 3500, 700)], " ".join(big[:700]))


def brute_row(doc_id, text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(ws), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    runs = brute_runs(ws)
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = s, length, q
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(collapse(ws, runs)))


def test_query_equals_brute_force(spark):
    # the longest texts take the brute force long: they are planted anew from other rows below
    texts = {r.doc_id: r.text for r in documents(spark, DIR).collect()}
    rows = {r.doc_id: r for r in q_words.op13_periodic(spark, DIR).collect()}
    assert rows.keys() == texts.keys()
    planted = 0
    for doc, text in texts.items():
        if len((text or "").split()) > 1500:
            continue
        r = rows[doc]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == brute_row(doc, text)
        planted += r.n_runs > 0 and zlib.crc32(str(doc).encode()) % 10 == 0
    assert planted > 3


def test_planting_of_short_null_and_empty_texts(spark):
    rng = random.Random(3)
    data = [(i, rng.choice([None, "", "  ", "a", "a b", "a b c d e f g h i j", " ".join(map(str, range(80)))])) for i in range(400)]
    data += [(None, "a a a a a a"), (None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    changed = df.select("doc_id", "text", q_words.planted(F.col("doc_id"), F.col("text")).alias("new")).collect()
    for r in changed:
        ws = (r.text or "").split()
        h = zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is None or h % 10 or not ws:
            assert r.new == r.text
        else:
            a = h // 10 % len(ws)
            p = 1 + (len(ws) - a) // (3 + h // 10 % 8)
            assert r.new.split(" ") == [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]


def test_edges(spark):
    data = [(1, None, 7), (1, None, 7), (2, "", 8), (3, " \t\n", 9), (4, "a " * 5, 1), (5, "a " * 6, 2), (None, "b\x0bb" + "\u00a0b" * 6, 3)]
    df = spark.createDataFrame(data, "doc_id long, text string, RUNS int")
    got = periodic.find(df)
    assert got.columns == ["doc_id", "text", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == len(data)
    by = {r.doc_id: r for r in rows}
    for k in (1, 2, 3):
        assert by[k].runs == [] and by[k].collapsed == ""
    assert by[4].runs == [] and by[4].collapsed == "a a a a a"
    assert [tuple(r) for r in by[5].runs] == [(0, 6, 1)] and by[5].collapsed == "a"
    # no-break space is part of a word, the vertical tab is not
    assert by[None].runs == [] and by[None].collapsed == "b b" + "\u00a0b" * 6
    assert periodic.find(df.limit(0)).count() == 0
