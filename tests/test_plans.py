"""Plan-shape checks: no cartesian products or Python in native queries, top-k
limited before the shuffle, parquet scans pruned."""

import contextlib
import io
import re
import tempfile

import pyspark
import pytest

from rankfold.plans import queries as LIBRARY

SF = "/root/testdata/sf0.001"
# iterative MLlib fit; Arrow batches in Python by design
PY_QUERIES = {"pairwise_model", "pairwise_eval", "passage_scores_batch", "token_budget_subwords"}


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(set(LIBRARY.queries()) - PY_QUERIES))
def test_no_cartesian_no_python(spark, name):
    p = plan(LIBRARY.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in p, f"{name}: {bad}"


@pytest.fixture(scope="module")
def many_files(spark):
    """The small tables with the documents in 8 files, as a large corpus has many."""
    folder = tempfile.mkdtemp(prefix="rankfold-test-many-")
    for name in ("documents", "benchmark"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        (df.repartition(8) if name == "documents" else df).write.parquet(f"{folder}/{name}.parquet")
    return folder


def _bm25_plan(spark, sf=SF):
    from rankfold.operators.retrieve import bm25
    from rankfold.sources import testbed

    docs = testbed.docs(spark, sf)
    title = testbed.topics(spark, sf, "title")
    return plan(bm25(docs, title, k=1000))


def _scans(spark, build) -> int:
    """Scans of the documents in all plans that run while ``build`` and its result do."""
    sc = spark.sparkContext
    log = []
    old = pyspark.sql.DataFrameWriter.parquet

    def parquet(self, path, *a, **k):
        log.append(plan(self._df))
        return old(self, path, *a, **k)

    pyspark.sql.DataFrameWriter.parquet = parquet
    try:
        log.append(plan(build()))
    finally:
        pyspark.sql.DataFrameWriter.parquet = old
    assert sc is not None
    return sum(len(re.findall(r"Location: \S+ \[\S*documents\.parquet", p)) for p in log)


def test_corpus_scans_on_many_files(spark, many_files):
    from rankfold.plans.context import Experiment

    assert 1 <= _scans(spark, lambda: Experiment(spark, many_files, False).search_run) <= 2
    assert 1 <= _scans(spark, lambda: Experiment(spark, many_files).doc_scores()) <= 3


def test_no_exchange_by_document_and_term(spark, many_files):
    p = _bm25_plan(spark, many_files)
    keys = [line for line in p.splitlines() if "Arguments: hashpartitioning(" in line]
    assert keys and not any("docid" in k and "term" in k for k in keys)


def test_shallow_sampling_sorts_no_query_in_one_task(spark):
    from rankfold.operators.benchmark import sample_shallow

    q = spark.createDataFrame([("a", f"d{i}", 1) for i in range(50)], "qid string, docid string, rel int")
    p = plan(sample_shallow(q, 0.5))
    assert "Window" not in p


def test_topk_limited_before_shuffle(spark):
    p = _bm25_plan(spark)
    assert "WindowGroupLimit" in p


def test_scan_pruned_and_vocabulary_broadcast(spark):
    p = _bm25_plan(spark)
    reads = [l.strip() for l in p.splitlines() if l.strip().startswith("ReadSchema")]
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in reads
    assert all("lang" not in l and "source" not in l and "n_chars" not in l for l in reads)
    assert "BroadcastHashJoin Inner" in p             # terms meet the query weights map-side


def test_every_query_has_an_oracle():
    missing = set(LIBRARY.queries()) - set(LIBRARY.oracle_sql()) - PY_QUERIES
    assert not missing
