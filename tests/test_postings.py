"""Postings kept by term: same runs as the corpus scan, pruned folders, safe top-k."""

import random

from pyspark.sql import functions as F

from rankfold.operators import postings as P
from rankfold.operators.retrieve import bm25
from rankfold.session import scratch_dir


def corpus(spark, n=400, seed=1, words=300):
    """Texts whose words follow a steep distribution: a few are in most documents."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ws = [f"w{min(words - 1, int(rng.paretovariate(0.7)) - 1)}" for _ in range(rng.choice([0, 1, 5, 30, 120]))]
        rows.append((f"d{i:04d}", " ".join(ws)))
    rows.append(("null", None))
    return spark.createDataFrame(rows, "docid string, text string")


def topics(spark, n=12, seed=2, words=300):
    rng = random.Random(seed)
    rows = [(f"q{i}", " ".join(f"w{min(words - 1, int(rng.paretovariate(0.5)) - 1)}" for _ in range(rng.randint(1, 12)))) for i in range(n)]
    return spark.createDataFrame([*rows, ("none", "unknownword"), ("empty", "")], "qid string, query string")


def rows(df):
    return sorted((r.qid, r.docid, r["rank"], round(r.score, 6)) for r in df.collect())


def built(spark, docs, **kw):
    path = scratch_dir(spark, "idx")
    P.write_index(docs, path, **kw)
    return P.read_index(spark, path)


def test_run_from_postings_equals_the_scan(spark):
    docs, t = corpus(spark), topics(spark)
    index = built(spark, docs, buckets=16)
    assert (index.n_docs, index.buckets) == (401, 16)
    for k in (5, 1000):
        assert rows(bm25(None, None, k=k, parts=P.index_parts(index, t))) == rows(bm25(docs, t, k=k))


def test_search_reads_only_the_folders_of_its_terms_and_shuffles_no_postings(spark):
    docs = corpus(spark)
    index = built(spark, docs, buckets=32)
    terms = spark.createDataFrame([("w7",), ("w123",)], "term string")
    asked = sorted({r[0] for r in terms.select(P.bucket_of(F.col("term"), 32)).collect()})
    lists = index.lists(terms, 2)
    text = lists._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scan = text[text.index("PartitionFilters"):][:200]
    assert "bucket#" in scan and all(str(a) in scan for a in asked)
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text and "rangepartitioning" not in text
    files = [r[0] for r in index.table("postings", asked).select(F.input_file_name()).distinct().collect()]
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in files} == set(asked)
    assert {r.term for r in lists.collect()} == {"w7", "w123"}


def test_safe_top_k_equals_full_scoring_and_scores_fewer_hits(spark):
    docs, t = corpus(spark, 900, 5), topics(spark, 20, 6)
    index = built(spark, docs, buckets=8)
    full = bm25(docs, t, k=None)
    for k, first in ((1, 1), (3, 4), (10, 1), (1000, 4)):
        got = P.safe_top_k(index, t, k, first_hits=first)
        assert rows(got.run) == rows(full.filter(F.col("rank") <= k)), (k, first)
        hits = {r.qid: (r.hits, r.scored) for r in got.hits.collect()}
        assert all(s <= h for h, s in hits.values())
        if k == 3:
            assert sum(s for _, s in hits.values()) < 0.8 * sum(h for h, _ in hits.values())
    # other parameters than those of the index: looser bounds, same rows
    got = P.safe_top_k(index, t, 5, k1=1.2, b=0.75)
    assert rows(got.run) == rows(bm25(docs, t, 1.2, 0.75, k=5))


def test_ties_and_copies(spark):
    docs = spark.createDataFrame([(f"c{i}", "same words here") for i in range(50)] + [("x", "same other")], "docid string, text string")
    t = spark.createDataFrame([("q", "same words here"), ("r", "other same")], "qid string, query string")
    index = built(spark, docs, buckets=4)
    assert rows(P.safe_top_k(index, t, 7, first_hits=1).run) == rows(bm25(docs, t, k=7))


def test_empty_tables(spark):
    docs, t = corpus(spark, 20), topics(spark, 3)
    empty = built(spark, docs.limit(0), buckets=4)
    assert empty.n_docs == 0 and bm25(None, None, parts=P.index_parts(empty, t)).count() == 0
    assert P.safe_top_k(empty, t, 3).run.count() == 0
    index = built(spark, docs, buckets=4)
    assert P.safe_top_k(index, t.limit(0), 3).run.count() == 0
