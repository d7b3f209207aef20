"""Subword counts and budgets against brute force."""

import random

import pytest

from rankfold.functions import subwords as W
from rankfold.plans.queries import QUERIES, q_rerank

PIECES = ["a", "b", "ab", "abc", "bc</w>", "c</w>", "abcab</w>", "é", "éa</w>", "cab", "</w>", "aa", "aaa</w>"]


def brute_cut(word, pieces):
    out = []
    while word:
        for n in range(len(word), 0, -1):
            # a piece ends the word if and only if it carries the mark
            if (word + "</w>" if n == len(word) else word[:n]) in pieces:
                break
        out.append(word[:n])
        word = word[n:]
    return out


def test_greedy_longest_match():
    rng = random.Random(1)
    trie, pieces = W.SubwordTrie(PIECES), set(PIECES)
    for _ in range(3000):
        w = "".join(rng.choices("abcéz", k=rng.randint(0, 12)))
        assert trie.cut(w) == brute_cut(w, pieces), w


def test_budget_of_rows(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcé", k=rng.randint(1, 6)))
    data = [(i, [word() for _ in range(rng.randint(0, 8))], [word() for _ in range(rng.randint(0, 30))]) for i in range(60)]
    data += [(100, None, ["ab"]), (101, ["ab"], None), (102, [], []), (103, ["a"] * 500, ["ab"])]
    df = spark.createDataFrame(data, "i int, qtokens array<string>, ptokens array<string>")
    got = {r.i: r.input_tokens for r in W.budget_subwords(df, PIECES, 40).collect()}
    for i, q, p in data:
        room = 40 - 3 - sum(len(brute_cut(w, set(PIECES))) for w in q or [])
        want = []
        for w in p or []:
            room -= len(brute_cut(w, set(PIECES)))
            if room < 0:
                break
            want.append(w)
        assert got[i] == want, i


def test_query_equals_brute_force(spark):
    pytest.importorskip("public_tokenizers")
    sf = "/root/testdata/sf0.001"
    pieces = set(W.read_pieces(q_rerank.vocabulary_path()))
    assert len(pieces) > 40_000 and "the</w>" in pieces and any("é" in p for p in pieces)
    rows = QUERIES["token_budget_subwords"](spark, sf).collect()
    words = {(r.qid, r.docid, r.pidx): r for r in rows}
    assert len(words) == len(rows) == QUERIES["token_budget"](spark, sf).count()
    from rankfold.functions.text import tokenize
    from rankfold.plans.context import Experiment

    x = Experiment(spark, sf)
    texts = {r.docid: r.t for r in x.docs.select("docid", tokenize("text").alias("t")).collect()}
    queries = {r.qid: r.t for r in x.desc.select("qid", tokenize("query").alias("t")).collect()}
    for (qid, docid, pidx), r in random.Random(3).sample(sorted(words.items()), 150):
        p = texts[docid][pidx * 75:pidx * 75 + 150]
        room = 253 - sum(len(brute_cut(w, pieces)) for w in queries[qid])
        n = 0
        for w in p:
            room -= len(brute_cut(w, pieces))
            if room < 0:
                break
            n += 1
        assert (r.n_passage, r.n_input) == (len(p), n)
