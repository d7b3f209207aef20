"""The pipeline, stage by stage, against brute force on the smallest table."""

import re
from collections import Counter

from tokenizers import Tokenizer

import __spark_entry__ as ENTRY
import corpus_pipeline
from rankfold.llm import mix, near_dup, q_tokens
from tests.llm.test_near import brute

DIR = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "bpe_encoding"]
    assert "pipeline" in ENTRY.queries() and "pipeline" not in ENTRY.oracle_sql()
    ops = {int(m[1]) for q in ENTRY.queries() if (m := re.match(r"op(\d+)_", q))}
    assert ops == set(range(1, 14))


def test_each_stage_equals_brute_force(spark, tmpdir_path):
    docs = q_tokens.documents(spark, DIR)
    junk = spark.createDataFrame([(10 ** 6, None, None, "src0", None), (10 ** 6 + 1, "12 34", "en", "src0", 5)], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.collect()

    docs.union(junk).write.parquet(f"{tmpdir_path}/with_junk")  # a stage reads a written table
    named = stages["language_id"](spark, spark.read.parquet(f"{tmpdir_path}/with_junk"), DIR).cache()
    assert named.columns == docs.columns
    assert {r.doc_id for r in named.collect()} == {r.doc_id for r in rows if re.search(r"[^\W\d_]", r.text or "")}

    exact = stages["exact_dedup"](spark, docs, DIR).cache()
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        best[key] = min(best.get(key, (1, 0)), (-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in exact.collect()) == sorted(d for _, d in best.values())
    assert exact.columns == docs.columns

    near = stages["near_dedup"](spark, exact, DIR).cache()
    left = exact.collect()
    roots = brute([(r.doc_id, r.text) for r in left])
    first = {}
    for r, root in zip(left, roots):
        first[root] = min(first.get(root, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in near.collect()) == sorted(first.values())

    mixed = stages["mix_sources"](spark, near, DIR)
    taken = mix.plan(near)[1].collect()
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(t.doc_id for t in taken)
    assert mixed.columns == docs.columns

    t = Tokenizer.from_file(q_tokens.vocabulary_path())
    for r in stages["bpe_encoding"](spark, docs, DIR).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r.token_ids == t.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.token_ids)


def test_without_labels_only_texts_without_letters_go(spark):
    docs = spark.createDataFrame([(1, "plain words", None, "s", 3), (2, "x", None, "s", 1), (3, "12 34", None, "s", 5), (4, None, None, "s", 0)],
                                 q_tokens.documents(spark, DIR).schema)
    kept = dict(corpus_pipeline.STAGES)["language_id"](spark, docs, DIR)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_run_equals_the_stages_and_takes_an_empty_table(spark, tmpdir_path):
    out = corpus_pipeline.run(spark, DIR)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids"] and out.count() > 50
    q_tokens.documents(spark, DIR).limit(0).write.parquet(f"{tmpdir_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmpdir_path}/none").count() == 0
    assert near_dup.SHINGLE == 5 and near_dup.SIMILARITY == 0.8
