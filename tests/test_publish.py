"""Versions, pointers and job keys."""

import glob
import os

import pytest

from rankfold.sources import publish as P


def test_rerun_adds_nothing_and_replace_takes_the_place(spark, tmpdir_path):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "k int, v string")
    b = spark.createDataFrame([(2, "y")], "k int, v string")
    assert P.publish(a, tmpdir_path, "m", "a") and P.publish(b, tmpdir_path, "m", "b")
    assert not P.publish(b, tmpdir_path, "m", "a")
    rows = lambda: sorted((r.job, r.k) for r in P.read_all(spark, tmpdir_path, "m").collect())
    assert rows() == [("a", 1), ("a", 1), ("b", 2)]
    assert P.publish(b, tmpdir_path, "m", "a", replace=True)
    assert rows() == [("a", 2), ("b", 2)]


def test_best_is_the_greatest_value_the_earliest_on_ties(spark, tmpdir_path):
    for job, value in (("e4", 0.5), ("e8", 0.7), ("e12", 0.7), ("e16", None), ("e20", float("nan"))):
        P.publish(spark.createDataFrame([(job,)], "s string"), tmpdir_path, "dev.best", job, value)
    assert [r.s for r in P.read_best(spark, tmpdir_path, "dev.best").collect()] == ["e8"]


def test_a_version_without_pointer_is_never_read(spark, tmpdir_path):
    with pytest.raises(FileNotFoundError):
        P.read_all(spark, tmpdir_path, "m")
    df = spark.createDataFrame([(1,)], "k int")
    broken = df.selectExpr("case when k = 1 then raise_error('job died') else k end as k")
    P.publish(df, tmpdir_path, "m", "a", 1.0)
    with pytest.raises(Exception, match="job died"):
        P.publish(broken, tmpdir_path, "m", "b", 2.0)
    df.write.parquet(f"{tmpdir_path}/m/versions/half-written")
    assert [r.k for r in P.read_all(spark, tmpdir_path, "m").collect()] == [1]
    assert P.read_best(spark, tmpdir_path, "m").count() == 1
    # the job that died can run again
    assert P.publish(df, tmpdir_path, "m", "b", 2.0) and P.read_all(spark, tmpdir_path, "m").count() == 2


def test_folders_and_new_columns(spark, tmpdir_path):
    P.publish(spark.createDataFrame([(1, "s1")], "k int, fold string"), tmpdir_path, "r", "a", partition_cols=("fold",))
    P.publish(spark.createDataFrame([(2, 0.5)], "k int, extra double"), tmpdir_path, "r", "b")
    got = {r.job: (r.k, r.fold, r.extra) for r in P.read_all(spark, tmpdir_path, "r").collect()}
    assert got == {"a": (1, "s1", None), "b": (2, None, 0.5)}
    assert glob.glob(os.path.join(tmpdir_path, "r/versions/*/fold=s1/*.parquet"))
