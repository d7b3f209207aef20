"""Benchmark preparation (B1-B10): folds, run splits, sampling, qrels sets, checks.

Folds and topic lists are bounded by the topic set; they are broadcast behind
that bound.  Samples are exact counts in md5 order, so they are the same in any
engine and on any retry.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sample_order
from ..session import checkpoint
from .labels import labels_of
from .ordering import sequence_number
from .sizing import broadcast_bounded, row_bound

# The reference's sampling grid and modes.
RATES = (0.1, 0.3, 0.5, 0.7, 0.9, 1.0)
MODES = ("deep", "shallow")


def make_folds(topic_ids: DataFrame, n: int) -> DataFrame:
    """B1: (fold, split, qid) with test bucket ``ord % n + 1`` and dev of s_i = test of s_{i-1}.

    ``topic_ids`` = (qid, ord long).  Each topic is multiplied by the n fold
    names with ``explode`` (a Generate), so no join is needed.
    """
    bucket = F.pmod(F.col("ord"), F.lit(n)) + 1
    i = F.col("i")
    prev = F.when(i == 1, F.lit(n)).otherwise(i - 1)
    return (topic_ids.select("qid", bucket.alias("bucket"),
                             F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"))
            .select(F.concat(F.lit("s"), i.cast("string")).alias("fold"),
                    F.when(F.col("bucket") == i, "test").when(F.col("bucket") == prev, "dev")
                    .otherwise("train").alias("split"),
                    "qid"))


def fold_number(c="fold"):
    """'s12' -> 12 (fold names compare as numbers, not strings)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(col, r"(\d+)$", 1).cast("int")


def select_folds(folds: DataFrame, spec: str = "all") -> DataFrame:
    """B2: ``all`` or a ``-``-joined list (``s1-s3`` = s1 and s3, not a range)."""
    if spec == "all":
        return folds
    return folds.filter(F.col("fold").isin(*spec.split("-")))


def split_run(run: DataFrame, folds: DataFrame, folds_bound: int | None = None,
              splits: Sequence[str] | None = None) -> DataFrame:
    """Tag every run row with (fold, split); one row per fold the query is in."""
    f = folds if splits is None else folds.filter(F.col("split").isin(*splits))
    return run.join(broadcast_bounded(f.select("fold", "split", "qid").distinct(), folds_bound), "qid")


def _keep_count(n, rate: float):
    return F.greatest(F.lit(1), F.round(F.lit(float(rate)) * n).cast("long"))


def sample_deep(folds: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    """Keep ``max(1, round(rate * n))`` queries of every train and dev list; test untouched.

    Queries are taken in md5(seed|fold|split|qid) order; rate >= 1 passes through.
    """
    if rate >= 1:
        return folds
    w = Window.partitionBy("fold", "split").orderBy(sample_order(seed, "fold", "split", "qid"))
    wn = Window.partitionBy("fold", "split")
    f = (folds.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(wn)))
    keep = (F.col("split") == "test") | (F.col("_r") <= _keep_count(F.col("_n"), rate))
    return f.filter(keep).drop("_r", "_n")


def numbered_judgments(qrels: DataFrame, rates: Sequence[float], seed: int = 42) -> DataFrame:
    """(qid, docid, rel, _r, _n): a judgment's place in the md5 order of its query, as far as
    the counts kept at ``rates`` tell places apart, and the query's judgments.

    A query's judgments grow with the corpus, so they are not sorted: they are counted by the
    first two digits of their md5, and a count kept at a rate ends inside one of these 256
    blocks at most.  Only such a block is numbered, by a range-partitioned sort; all rows of
    the others have the place of their block's first, which is on the same side of every
    count.  No task holds a query."""
    q = qrels.withColumn("_o", sample_order(seed, "qid", "docid")).withColumn("_b", F.substring("_o", 1, 2))
    mine = Window.partitionBy("qid")
    blocks = (q.groupBy("qid", "_b").agg(F.count(F.lit(1)).alias("_m"))
              .withColumn("_first", F.sum("_m").over(mine.orderBy("_b")) - F.col("_m") + 1)
              .withColumn("_n", F.sum("_m").over(mine)))
    keeps = [_keep_count(F.col("_n"), r) for r in rates if r < 1]
    parted = reduce(Column.__or__, [(k >= F.col("_first")) & (k < F.col("_first") + F.col("_m") - 1) for k in keeps], F.lit(False))
    blocks = checkpoint(blocks.withColumn("_parted", parted).drop("_m"))
    q = q.join(broadcast_bounded(blocks, row_bound(blocks)), ["qid", "_b"])
    columns = [*qrels.columns, "_r", "_n"]
    whole = q.filter(~F.col("_parted")).withColumn("_r", F.col("_first")).select(*columns)
    some = sequence_number(checkpoint(q.filter("_parted")), ["qid", "_b"], ["_o", "docid"], "_k")
    return whole.unionByName(some.withColumn("_r", F.col("_first") + F.col("_k") - 1).select(*columns))


def sample_shallow(qrels: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    """Keep ``max(1, round(rate * n))`` judgments of every query (md5 order); folds untouched."""
    if rate >= 1:
        return qrels
    q = numbered_judgments(qrels, [rate], seed)
    return q.filter(F.col("_r") <= _keep_count(F.col("_n"), rate)).drop("_r", "_n")


def rate_name(mode: str, rate: float) -> str:
    """The sampled set's name, ``mode.%.2f``; rate 1 is the unsampled set."""
    return "full" if rate >= 1 else f"{mode}.{rate:.2f}"


def sample_grid(qrels: DataFrame, folds: DataFrame, rates: Sequence[float] = RATES,
                modes: Sequence[str] = MODES, seed: int = 42, n_lists: int | None = None,
                numbered: DataFrame | None = None, run: DataFrame | None = None,
                counted: Sequence[str] | None = None) -> DataFrame:
    """(mode, rate, set_name, fold, split, qid, docid, rel) judgments every
    train/dev list sees, for the whole grid.

    Queries and judgments are numbered once; the rates are exploded and filtered.  ``n_lists``
    bounds the rows of ``folds``, which are broadcast onto the judgments behind it.
    ``numbered`` is ``numbered_judgments`` of the same arguments, if there already.

    A judgment is in some 28 rows of the whole grid (rates x modes x folds).  With ``run``
    only judgments of its (qid, docid) are multiplied, all being numbered.  With ``counted``
    (columns of ``qrels``) all judgments are counted by query, these columns and the rates that
    keep them, and the counts are multiplied: (mode, rate, set_name, fold, split, qid,
    <counted>.., n), to be summed."""
    f = folds.filter(F.col("split") != "test")
    order = Window.partitionBy("fold", "split").orderBy(sample_order(seed, "fold", "split", "qid"))
    lists = (f.withColumn("_r", F.row_number().over(order))
             .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("fold", "split"))))

    def cells_of(mode: str) -> Column:
        return F.array(*[F.struct(F.lit(mode).alias("mode"), F.lit(float(r)).alias("rate"),
                                  F.lit(rate_name(mode, r)).alias("set_name")) for r in rates])

    def cells(mode: str) -> Column:
        return F.explode(cells_of(mode)).alias("cell")

    keep = (F.col("cell.rate") >= 1) | (F.col("_r") <= F.greatest(
        F.lit(1), F.round(F.col("cell.rate") * F.col("_n")).cast("long")))
    mine = ["docid", "rel"] if counted is None else [*counted, "n"]
    columns = ["cell.mode", "cell.rate", "cell.set_name", "fold", "split", "qid", *mine]
    pairs = ["qid", "docid"]
    parts = []
    if "deep" in modes:
        deep = lists.select("*", cells("deep")).filter(keep).drop("_r", "_n")
        judged = qrels if run is None else labels_of(run, qrels, pairs)
        if counted is not None:
            judged = judged.groupBy("qid", *counted).agg(F.count(F.lit(1)).alias("n"))
        parts.append(judged.join(broadcast_bounded(deep, n_lists and n_lists * len(rates)), "qid").select(*columns))
    if "shallow" in modes:
        judged = numbered_judgments(qrels, rates, seed) if numbered is None else numbered
        if run is not None:
            judged = labels_of(run, judged, pairs)
        if counted is None:
            shallow = judged.select("*", cells("shallow")).filter(keep).drop("_r", "_n")
        else:
            kept = [F.lit(True) if r >= 1 else F.col("_r") <= _keep_count(F.col("_n"), r) for r in rates]
            judged = judged.groupBy("qid", *counted, F.array(*kept).alias("_kept")).agg(F.count(F.lit(1)).alias("n"))
            shallow = judged.select("*", F.posexplode("_kept").alias("_i", "_in"), cells_of("shallow").alias("_cells")).filter("_in")
            shallow = shallow.withColumn("cell", F.col("_cells")[F.col("_i")]).drop("_kept", "_i", "_in", "_cells")
        parts.append(shallow.join(broadcast_bounded(f, n_lists), "qid").select(*columns))
    return reduce(DataFrame.unionByName, parts)


def qrels_for_split(tagged: DataFrame, sampled: DataFrame, full: DataFrame,
                    dev_qrels: str = "sampled") -> DataFrame:
    """Join labels to (fold, split, qid, docid) rows: train and dev are judged by
    the sampled qrels (dev by the full ones with ``dev_qrels='full'``), test
    always by the full qrels."""
    use_full = (F.col("split") == "test") | ((F.col("split") == "dev") & F.lit(dev_qrels == "full"))
    t = checkpoint(tagged.withColumn("qrels_set", F.when(use_full, "full").otherwise("sampled")))

    def labels(qrels: DataFrame, name: str) -> DataFrame:  # each set by the pairs that it judges
        mine = t.filter(F.col("qrels_set") == name)
        return labels_of(mine, qrels.select("qid", "docid", "rel")).withColumn("qrels_set", F.lit(name))

    both = checkpoint(labels(sampled, "sampled").unionByName(labels(full, "full")))
    return t.join(both, ["qrels_set", "qid", "docid"], "left")


def check_benchmark(folds: DataFrame, qrels: DataFrame, topics: DataFrame) -> DataFrame:
    """Violations (check, fold, qid, detail); empty when the benchmark is sound.

    * split_overlap      a query in two splits of one fold
    * test_repeated      a query in the test set of two folds
    * test_missing       a topic in no test set
    * unjudged_topic     a topic without judgments
    * unknown_qrels_qid  judgments for a query that is not a topic
    """
    f = folds.select("fold", "split", "qid").distinct()
    overlap = (f.groupBy("fold", "qid").agg(F.count(F.lit(1)).alias("n"),
                                           F.array_join(F.array_sort(F.collect_set("split")), ",").alias("d"))
               .filter("n > 1").select(F.lit("split_overlap").alias("check"), "fold", "qid",
                                       F.col("d").alias("detail")))
    test = f.filter(F.col("split") == "test")
    repeated = (test.groupBy("qid").agg(F.count(F.lit(1)).alias("n"),
                                       F.array_join(F.array_sort(F.collect_list("fold")), ",").alias("d"))
                .filter("n > 1").select(F.lit("test_repeated").alias("check"), F.lit(None).cast("string").alias("fold"),
                                        "qid", F.col("d").alias("detail")))
    tq = topics.select("qid").distinct()
    missing = (tq.join(test.select("qid"), "qid", "left_anti")
               .select(F.lit("test_missing").alias("check"), F.lit(None).cast("string").alias("fold"), "qid",
                       F.lit(None).cast("string").alias("detail")))
    qq = qrels.select("qid").distinct()
    unjudged = (tq.join(qq, "qid", "left_anti")
                .select(F.lit("unjudged_topic").alias("check"), F.lit(None).cast("string").alias("fold"), "qid",
                        F.lit(None).cast("string").alias("detail")))
    unknown = (qq.join(tq, "qid", "left_anti")
               .select(F.lit("unknown_qrels_qid").alias("check"), F.lit(None).cast("string").alias("fold"), "qid",
                       F.lit(None).cast("string").alias("detail")))
    return overlap.unionByName(repeated).unionByName(missing).unionByName(unjudged).unionByName(unknown)
