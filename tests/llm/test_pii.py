"""Operator 6 against the plain patterns, and edge tables."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from rankfold.llm import pii, q_text
from rankfold.llm.q_tokens import documents

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    def every(p):
        return [(m.start(), m.end(), m[0]) for m in re.finditer(p, text)]

    n = lambda v: len(re.sub("[^0-9]", "", v))
    return {
        "email": [x[:2] for x in every(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")],
        "ip": [x[:2] for x in every(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if max(map(int, x[2].split("."))) <= 255],
        "card": [x[:2] for x in every(r"[0-9]([\x20-]?[0-9])+") if 16 <= n(x[2]) <= 19 and luhn(re.sub("[^0-9]", "", x[2]))],
        "phone": [x[:2] for x in every(r"\+[0-9][\x20().0-9-]+[0-9]") if 8 <= n(x[2]) <= 15],
    }


def said(found):
    return ",".join(f"{k}:{s}:{e}" for k in pii.KINDS for s, e in found[k])


def base_of(row):
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in row.pii if s.base)


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "@x", ".", "..", "-", "_", "é", "😀", " ", "  ", "1", "12", "255", "256", "0001", "4", "7",
             "4444", "1234567890", "+", "+1", "(", ")", "com", "\n", "%", "4111111111111111", "x@y.z", "1.2.3.4"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 14))), None) for i in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    text = {r[0]: r[1] for r in rows}
    for r in pii.find(df, None).collect():
        assert base_of(r) == said(brute(text[r.doc_id])), text[r.doc_id]


def test_op6_query_keeps_all_base_spans(spark):
    texts = {r.doc_id: r.text or "" for r in documents(spark, DIR).collect()}
    rows = {r.doc_id: r for r in q_text.op6_pii(spark, DIR).collect()}
    assert rows.keys() == texts.keys()
    for doc, t in texts.items():
        want = brute(t)
        r = rows[doc]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[k]) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(said(want).encode()).hexdigest()
        assert set(filter(None, said(want).split(","))) <= set(r.spans.split(","))


def test_trees_equal_sparks_own_scores_and_add_only_beside_the_base(spark):
    rng = random.Random(4)
    num = lambda n: "".join(rng.choices("0123456789", k=n))
    rows = []
    for i in range(600):
        t = f"word +1 ({num(3)}) 555-{num(4)} and item {num(9)} tel: {num(7)} or a{i}@ex.com also {i % 256}.1.2.{i % 300} x"
        rows.append((i, t, None))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    model = pii.fit(df)
    assert model is not None and 0.5 <= model.threshold <= 1
    out = pii.find(df, model)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        assert base_of(r) == said(brute(r.text))
        base = [s for s in r.pii if s.base]
        for s in r.pii:
            assert s.base or not any(b.start < s.end and s.start < b.end for b in base)


def test_added_spans_follow_the_threshold(spark):
    df = spark.createDataFrame([(1, "no 1234567 here", None)], SCHEMA)
    by_digits = [(pii.FEATURES.index("digits"), 6.5, -2.0, 2.0)]
    hot, cold = pii.Model(by_digits, [1.0], 0.9), pii.Model(by_digits, [1.0], 0.99)
    assert [(s.kind, s.start, s.end, s.base) for s in pii.find(df, hot).first().pii] == [("phone", 3, 10, False)]
    assert pii.find(df, cold).first().pii == []
    assert pii.redact(pii.find(df, hot)).first().redacted == "no [phone] here"


def test_op6_edges(spark):
    rows = [(1, None, None), (2, "", None), (None, "x@y.zz", None), (3, "é x@y.zz", "l"), (3, "é x@y.zz", "l"),
            (4, "a" * 3_000 + " 1" * 40_000 + ".a" * 2_000, None), (5, "1.1.1.1 " * 2000, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = pii.find(df, pii.fit(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert base_of(r) == said(brute(r.text or ""))
    none = spark.createDataFrame([], SCHEMA)
    assert pii.find(none, pii.fit(none)).count() == 0
    clash = pii.find(df.withColumnRenamed("lang", "PII").withColumn("_base", F.lit("x")), None)
    assert clash.columns == ["doc_id", "text", "_base", "pii"] and {r["_base"] for r in clash.collect()} == {"x"}
