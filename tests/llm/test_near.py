"""Operator 3 against brute force over all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from rankfold.llm import near_dup, q_near
from rankfold.llm.q_tokens import documents

SCHEMA = "doc_id long, text string, digest string"


def bag(text):
    w = near_dup.words(text)
    return Counter(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else Counter([tuple(w)]) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows, least=0.8):
    """Partition of row numbers into classes, comparing all pairs that can be alike."""
    bags = [bag(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            m, n = sorted((sum(bags[i].values()), sum(bags[j].values())))
            if find(i) != find(j) and ((m == n == 0) or (m >= least * n and jaccard(bags[i], bags[j]) >= least)):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def check(df_rows, got, want_roots):
    groups = {}
    for (doc, *_), r in zip(df_rows, want_roots):
        groups.setdefault(r, []).append(doc)
    want = {}
    for docs in groups.values():
        ids = [d for d in docs if d is not None]
        for d in docs:
            want.setdefault(d, []).append((min(ids) if ids else None, len(docs)))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.class_id, r.class_size))
    key = lambda v: sorted(v, key=repr)
    assert {k: key(v) for k, v in have.items()} == {k: key(v) for k, v in want.items()}


def changed(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[rng.randrange(len(ws))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(ws)


def test_signatures_are_unbiased_for_weights():
    rng = np.random.default_rng(1)
    for wa, wb in (((1, 1, 1, 0, 5), (1, 1, 0, 1, 2)), ((3, 7, 1, 16, 2), (5, 7, 0, 11, 9))):
        want = sum(map(min, wa, wb)) / sum(map(max, wa, wb))
        values = rng.integers(0, 2 ** 63, (60, 5), dtype=np.int64).astype(np.uint64)
        hit = [near_dup.signatures([np.sort(np.repeat(v, wa)), np.sort(np.repeat(v, wb))], 256) for v in values]
        got = np.mean([(s[0] == s[1]).mean() for s in hit])
        assert got == pytest.approx(want, abs=0.02)


def test_verification_equals_multisets():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice("abcdefg") for _ in range(rng.randint(0, 40))]
        b = [rng.choice("abcdefg") for _ in range(rng.randint(0, 40))]
        x, y = (near_dup.unpack(near_dup.pack(near_dup.shingles(w))) for w in (a, b))
        assert near_dup.similarity(x, y) == pytest.approx(jaccard(bag(" ".join(a)), bag(" ".join(b))))


@pytest.mark.parametrize("block", [4, 256])
def test_classes_equal_all_pairs(spark, block):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 90))]
        for _ in range(rng.choice([1, 2, 3, 30])):
            rows.append((len(rows), changed(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 6])), None))
    base = [rng.choice(vocab) for _ in range(120)]
    for k in range(60):  # a chain: each near the one before it, the ends far apart
        base[(2 * k) % 120] = f"chain{k}"
        rows.append((len(rows), " ".join(base), None))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    check(rows, near_dup.classes(df, block=block).collect(), brute(rows))


def test_op3_query_on_the_smallest_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in documents(spark, d).collect()]
    got = q_near.op3_neardup(spark, d).collect()
    check(rows, got, brute(rows))
    assert sum(r.kept for r in got) == len({r.class_id for r in got})


def test_op3_edges(spark):
    long = " ".join(f"x{i % 700}" for i in range(30_000))
    rows = [(5, "one two", None), (3, "One  TWO!", None), (None, "one two", None), (4, None, None), (9, "", None), (9, " . ", None),
            (1, long, None), (2, long + " end", None), (7, "a b c d e f g", "x"), (7, "a b c d e f g", "x"), (7, "q r s", None),
            (None, "only null id", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    check(rows, near_dup.classes(df).collect(), brute(rows))
    kept = near_dup.keep(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:9]) for r in kept.collect()) == [
        (0, "only null"), (1, long[:9]), (3, "One  TWO!"), (4, ""), (7, "a b c d e"), (7, "q r s")]
    none = spark.createDataFrame([], SCHEMA)
    assert near_dup.classes(none).count() == 0 and near_dup.keep(none).count() == 0
