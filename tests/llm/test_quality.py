"""Operator 12: gradients against differences, whole texts, held-out accuracy and edge tables."""

import zlib

import numpy as np

from rankfold.llm import q_text, quality
from rankfold.llm.q_tokens import documents

DIR = "/root/testdata/sf0.01"


def test_chunks_cover_whole_texts():
    texts = ["", None, "a", "b" * 256, "c" * 257, "".join(chr(97 + i % 26) for i in range(5000)), "é" * 300]
    x, owner, adds = quality.chunks(texts)
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        got = bytearray(len(raw))
        mine = x[owner == k]
        for i, row in enumerate(mine):
            at = i * quality.STRIDE
            got[at:at + quality.CHUNK] = row.tobytes()[:len(raw) - at]
        assert bytes(got) == raw and adds[owner == k].sum() == max(1, len(raw))


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    net = quality.ByteNet()
    for p in quality.PARAMETERS:
        setattr(net, p, getattr(net, p).astype(np.float64))
    x = rng.integers(0, 256, (5, 40)).astype(np.uint8)
    owner, label, weight = np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0]), np.array([0.5, 2.0, 1.0])

    def loss():
        a = net.hidden(x)
        mean = np.stack([a[owner == k].mean(0) for k in range(3)])
        p = 1 / (1 + np.exp(-(mean @ net.out + net.out_bias)))
        return -(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).mean()

    g = net.gradients(x, owner, label, weight)
    for p in quality.PARAMETERS:
        value, grad = getattr(net, p), np.asarray(g[p])
        picks = [()] if value.ndim == 0 else [tuple(i) for i in np.argwhere(grad != 0)[rng.permutation(int((grad != 0).sum()))[:6]]]
        for i in picks:
            new = value.copy()
            new[i] += 1e-3
            setattr(net, p, new)
            up = loss()
            new = value.copy()
            new[i] -= 1e-3
            setattr(net, p, new)
            down = loss()
            setattr(net, p, value)
            # (float32 embedding buffers: differences are coarse)
            assert abs((up - down) / 2e-3 - grad[i]) < 2e-2 * max(0.05, abs(grad[i])), (p, i)


def test_held_out_documents_are_told_apart(spark):
    rows = q_text.op12_quality(spark, DIR).collect()
    assert len(rows) == documents(spark, DIR).count()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    mine = [(label[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in label]
    good, bad = [s for y, s in mine if y == 1], [s for y, s in mine if y == 0]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    right = np.mean([(s >= 0.5) == y for y, s in mine])
    assert auc > 0.97 and right > 0.95, (auc, right)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_edges(spark):
    data = [(i, ("plain words here " if i % 2 else "$$$ %%% ### ") * (1 + i % 7), "x") for i in range(60)]
    data += [(60, None, "x"), (61, "", "x"), (None, "words", "x"), (61, "", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, SCORE string")
    marks = [(i, i % 2) for i in range(60)] + [(0, 0), (3, 0), (5, None), (None, 1), (7, 2), (61, 1), (999, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    model = quality.fit(df, labels)
    got = quality.score(df, model)
    assert got.columns == ["doc_id", "text", "score"]
    rows = got.collect()
    assert len(rows) == len(data) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    assert quality.score(df.limit(0), model).count() == 0
    assert quality.fit(df, labels.limit(0)) is None and quality.fit(df.limit(0), labels) is None
    assert {r.score for r in quality.score(df, None).collect()} == {0.5}
    # one id that holds most rows, labelled: the sample stays bounded
    hot = spark.range(4000).selectExpr("cast(1 as long) as doc_id", "concat('text ', id) as text")
    assert quality.fit(hot, labels, docs_per_label=50) is not None
    assert quality.fit(df, labels.filter("quality = 1")) is not None
