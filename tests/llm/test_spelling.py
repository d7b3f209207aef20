"""Operator 11 against brute force, and edge tables."""

import random
import re
import zlib
from collections import Counter

from rankfold.llm import q_words, spelling
from rankfold.llm.q_tokens import documents

DIR = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows, least=7, count=2):
    out = Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(lower)
            if doc is not None:
                h = zlib.crc32(f"{doc}:{w}".encode())
                if h % 31 == 0:
                    w = w[:h % len(w)] + w[h % len(w) + 1:]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= least and n >= count}


def brute_groups(words, ratio=10):
    # words that are near share a word with one letter deleted, or one is such a word of the other
    cut = {}
    for w in words:
        for k in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            cut.setdefault(k, set()).add(w)
    near = {w: set() for w in words}
    for ws in cut.values():
        for a in ws:
            near[a] |= {b for b in ws if one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda b: (-words[b], b), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def result(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, DIR).collect()]
    want = brute_groups(brute_words(rows))
    assert result(q_words.op11_spelling(spark, DIR)) == want
    assert sum(v[3] > 0 for v in want.values()) > 50 and any(v[0] for v in want.values())


def test_dense_vocabulary_equals_brute_force(spark):
    rng = random.Random(8)
    words = {}
    while len(words) < 3000:
        words["".join(rng.choices("abé", k=rng.randint(1, 9)))] = rng.choice([1, 2, 3, 11, 40, 500, 9000])
    # all anagrams of one multiset, and a very long word with its variants
    for _ in range(300):
        w = list("aabbccddeeff")
        rng.shuffle(w)
        words["".join(w)] = rng.randint(1, 100)
    long = "".join(rng.choices("abcdefgh", k=30_000))
    words |= {long: 1000, long[:777] + long[778:]: 5, long + "é": 7, "x" + long[1:]: 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = brute_groups({w: n for w, n in words.items() if len(w) < 1000})
    got = result(spelling.group(df))
    assert {w: v for w, v in got.items() if len(w) < 1000} == want
    assert got[long] == (None, long, 1000, 3, None)
    assert {w: v[:2] for w, v in got.items() if len(w) > 1000 and w != long} == {
        w: (long, long) for w in words if len(w) > 1000 and w != long}


def test_every_near_pair_leaves_exactly_one_signature(spark):
    rng = random.Random(4)
    words = list({"".join(rng.choices("abc", k=rng.randint(2, 7))) for _ in range(800)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(df).collect()]
    want = {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_chains_ties_and_long_paths(spark):
    # each form is the form of a rarer word: w0 <- w1 <- ... ; ties go to the smaller word
    words, w = [], "abcdefghijklmnop"
    for i in range(9):
        words.append((w[i:], 10 ** (9 - i)))
    words += [("tietiea", 50), ("tietieb", 50), ("tietie", 5), ("tietiex", 6)]
    got = result(spelling.group(spark.createDataFrame(words, "word string, n long")))
    assert got[w[8:]][1] == w and got[w[8:]][0] == w[7:]
    assert got["tietie"][0] == "tietiea" and got["tietiex"][0] is None


def test_edges(spark):
    text = "Wordlike wordlike Ünderway ünderway Ünderway x÷×÷×÷×"
    data = [(1, None, "a"), (1, "", "b"), (None, text, "c"), (None, text, "c"), (2, "short words only", "d"), (3, "漢字 wordlike" * 2, "e")]
    df = spark.createDataFrame(data, "doc_id long, text string, word string")
    got = result(spelling.variants(df))
    want = brute_groups(brute_words([(d, t) for d, t, _ in data]))
    assert got == want and got["Ünderway"][2] == 4 and got["ünderway"][2] == 2 and got["x÷×÷×÷×"][2] == 2
    assert spelling.variants(df.limit(0)).count() == 0
    assert spelling.variants(df.filter("text is null")).count() == 0
