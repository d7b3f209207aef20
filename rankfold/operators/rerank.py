"""Reranking: cut (K1), labelled pairs (K2), triplets (K3), passages (K4, K5),
passage scoring (K6), passage -> document aggregation (K7), rerank (K8),
pairwise model (K9) and scorer comparison (K10).

All of it is expression code on rows plus a few keyed shuffles:
* passages are produced in the task that holds the document (posexplode of
  array slices), never shuffled by document;
* query-side data (term weights per query, the cut run's (qid, docid) pairs) is
  broadcast behind a bound of topics x depth;
* per-(qid, docid) aggregation is partial on the map side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fit_budget, sample_order, tokenize, uniform
from ..session import checkpoint
from .corpus import DOC_MARK, all_tokens
from .labels import labels_of
from .ordering import sequence_number
from .retrieve import BM25_B, BM25_K1, BM25Parts, rank_within
from .sizing import broadcast_bounded

# Passage windows, rerank depth and training subsample of the reference config.
PASSAGE_LEN = 150
PASSAGE_STRIDE = 75
REFERENCE_NUM_PASSAGES = 30
RERANK_DEPTH = 100
TRAIN_PASSAGE_PROB = 0.1
MAX_SEQ_LEN = 256
AGGREGATIONS = ("max", "first", "sum", "avg")


# --------------------------------------------------------------------- K1 / K2
def cut_run(run: DataFrame, threshold: int = RERANK_DEPTH, group_cols: Sequence[str] = ("qid",),
            assume_dense: bool = True) -> DataFrame:
    """K1: the first ``threshold`` documents of every query in run order.

    Ranks from ``rank_within`` are dense (1..n), so a filter is enough and no
    shuffle happens; ``assume_dense=False`` renumbers by the rank column first
    (a bounded WindowGroupLimit).
    """
    if assume_dense:
        return run.filter(F.col("rank") <= threshold)
    w = Window.partitionBy(*group_cols).orderBy(F.col("rank").asc(), F.col("docid").asc())
    return (run.withColumn("_pos", F.row_number().over(w)).filter(F.col("_pos") <= threshold)
            .drop("rank").withColumnRenamed("_pos", "rank"))


def pred_pairs(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """K2: one row per (query, doc) of the run with its label (null if unjudged)."""
    return run.join(labels_of(run, qrels.select("qid", "docid", "rel")), ["qid", "docid"], "left")


# --------------------------------------------------------------------- K3
def triplets(run: DataFrame, qrels: DataFrame, level: int = 1, per_positive: int = 1,
             seed: int = 42, group_cols: Sequence[str] = ()) -> DataFrame:
    """K3: (g.., qid, pos_docid, neg_docid) from the run's own documents.

    Negatives (judged non-relevant or unjudged) of a query get dense numbers
    0..n-1 in md5 order (range-partitioned numbering, no per-query task);
    positive p takes the ``min(per_positive, n)`` numbers
    starting at md5(p) mod n.  This is an equi-join on (qid, number), so exactly
    min(k, n) rows per positive are produced and the pos x neg product of a
    query is never built.
    """
    g = list(group_cols)
    lab = checkpoint(pred_pairs(run.select(*g, "qid", "docid"), qrels))
    is_pos = F.col("rel") >= level
    pos = lab.filter(is_pos).select(*g, "qid", F.col("docid").alias("pos_docid"))
    neg = lab.filter(~is_pos | F.col("rel").isNull()).select(*g, "qid", F.col("docid").alias("neg_docid"))
    # Dense numbers in md5 order per query, from a range-partitioned sort: a query
    # with a very deep run is numbered by many tasks, not one.
    negn = (sequence_number(neg.withColumn("_o", sample_order(seed, "qid", "neg_docid")),
                            [*g, "qid"], ["_o", "neg_docid"], "j")
            .withColumn("j", F.col("j") - 1).drop("_o"))
    nneg = neg.groupBy(*g, "qid").agg(F.count(F.lit(1)).alias("n_neg"))
    start = F.pmod(F.conv(F.substring(sample_order(seed, "qid", "pos_docid"), 1, 8), 16, 10)
                   .cast("long"), F.col("n_neg"))
    take = F.least(F.lit(per_positive), F.col("n_neg"))
    picks = (pos.join(nneg, [*g, "qid"])
             .select(*g, "qid", "pos_docid", "n_neg",
                     F.explode(F.sequence(F.lit(0), take - 1)).alias("t"), start.alias("s"))
             .select(*g, "qid", "pos_docid", F.pmod(F.col("s") + F.col("t"), F.col("n_neg")).alias("j")))
    return picks.join(negn, [*g, "qid", "j"]).select(*g, "qid", "pos_docid", "neg_docid")


# --------------------------------------------------------------------- K4 / K5 / T7
def passage_count(n_words: Column, passagelen: int = PASSAGE_LEN, stride: int = PASSAGE_STRIDE,
                  numpassages: int | None = None) -> Column:
    n = F.greatest(F.lit(1), (F.ceil((n_words - F.lit(passagelen)) / F.lit(float(stride))) + 1).cast("int"))
    return F.least(F.lit(numpassages), n) if numpassages else n


def passages(docs: DataFrame, passagelen: int = PASSAGE_LEN, stride: int = PASSAGE_STRIDE,
             numpassages: int | None = None, tokens_col: str = "tokens",
             keep_cols: Sequence[str] = ("docid",)) -> DataFrame:
    """K4: (keep.., pidx, start, ptokens) word windows of ``passagelen`` every ``stride``.

    The whole text is covered by default; ``numpassages`` caps the count as in
    the reference's MaxP config (30).  Windows are cut in the task that holds
    the document.
    """
    toks = F.col(tokens_col)
    n = passage_count(F.size(toks), passagelen, stride, numpassages)
    windows = F.transform(F.sequence(F.lit(0), n - 1),
                          lambda i: F.slice(toks, i * stride + 1, F.lit(passagelen)))
    return (docs.select(*keep_cols, F.posexplode_outer(windows).alias("pidx", "ptokens"))
            .withColumn("start", F.col("pidx") * stride))


def subsample_passages(p: DataFrame, prob: float = TRAIN_PASSAGE_PROB, seed: int = 42) -> DataFrame:
    """K5: keep passage 0 always, any other with probability ``prob`` (md5 coin)."""
    return p.filter((F.col("pidx") == 0) | (uniform(seed, "docid", "pidx") < F.lit(prob)))


def budget_tokens(pairs: DataFrame, max_len: int = MAX_SEQ_LEN) -> DataFrame:
    """T7 on pairs with qtokens/ptokens: passage part of a ``max_len`` model input."""
    return pairs.withColumn("input_tokens", fit_budget("qtokens", "ptokens", max_len))


# --------------------------------------------------------------------- K6 scorers
def query_weights(parts: BM25Parts) -> DataFrame:
    """(qid, qterms array<struct<term, qw>>), qw = qtf * corpus idf.

    Built from the small statistics table of the first-stage run (the corpus is not read
    again); one array per query, bounded by query length.
    """
    return parts.qw.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", "qw"))).alias("qterms"))


def bm25_passage_score(qterms: Column, ptokens: Column, k1: float = BM25_K1, b: float = BM25_B,
                       avg_len: float = PASSAGE_LEN) -> Column:
    """BM25 of a passage: corpus idf, tf in the passage, length normalised by the
    nominal passage length (so a passage's score does not depend on the others).
    A query without terms (null or empty ``qterms``) scores 0.

    tf of a term = size(p) - size(array_remove(p, term)): one native pass per
    query term.
    """
    pl = F.size(ptokens)
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * pl / F.lit(float(avg_len)))

    def contrib(t):
        tf = (pl - F.size(F.array_remove(ptokens, t["term"]))).cast("double")
        return t["qw"] * (tf / (tf + norm))

    return F.coalesce(F.aggregate(qterms, F.lit(0.0), lambda acc, t: acc + contrib(t)), F.lit(0.0))


def overlap_score(qtokens: Column, ptokens: Column) -> Column:
    """Share of the distinct query terms found in the passage."""
    qd = F.array_distinct(qtokens)
    return F.when(F.size(qd) > 0, F.size(F.array_intersect(qd, ptokens)) / F.size(qd)).otherwise(0.0)


def score_passages(pairs: DataFrame, scorer: str | Callable[[DataFrame], Column] = "bm25_passage",
                   **kw) -> DataFrame:
    """K6: add ``score`` to (qid, docid, pidx, ptokens, qtokens, qterms) rows.

    ``scorer`` is a registry name (native expressions) or a callable returning
    a Column, e.g. an Arrow ``pandas_udf`` applied to columns of ``pairs``.
    """
    if callable(scorer):
        return pairs.withColumn("score", scorer(pairs))
    return pairs.withColumn("score", scorer_column(scorer, **kw))


def scorer_column(scorer: str, **kw) -> Column:
    """The native expression of a registered scorer."""
    if scorer == "bm25_passage":
        return bm25_passage_score(F.col("qterms"), F.col("ptokens"), **kw).cast("double")
    if scorer == "overlap":
        return overlap_score(F.col("qtokens"), F.col("ptokens")).cast("double")
    raise ValueError(f"unknown scorer {scorer!r}")


_LOADED: dict = {}


def loaded(name: str, load: Callable[[], object]) -> object:
    """The model of that name in this process (a function of the module, so that workers find
    the module's own dictionary, not a copy of it)."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def batch_scorer(load: Callable[[], object], predict: Callable[..., Sequence[float]], columns: Sequence[str],
                 name: str) -> Callable[[DataFrame], Column]:
    """K6: a scorer for ``score_passages`` that scores Arrow batches in Python.

    ``load`` builds the model, once in every Python worker (workers are reused from task to
    task; ``name`` tells models apart); ``predict(model, *columns)`` gets one pandas series
    for each column and returns as many numbers.  Both travel to the workers, so what they
    hold must be small or a broadcast."""
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = loaded(name, load)
        for series in batches:
            yield pd.Series(predict(model, *series), dtype="float64")

    return lambda pairs: run(*[F.col(c) for c in columns])


def passage_pairs(cut: DataFrame, docs: DataFrame, qside: DataFrame, passagelen: int = PASSAGE_LEN,
                  stride: int = PASSAGE_STRIDE, numpassages: int | None = None,
                  pair_bound: int | None = None, q_bound: int | None = None,
                  group_cols: Sequence[str] = ()) -> DataFrame:
    """(g.., qid, docid, pidx, start, ptokens, <qside cols>) for every passage of
    every document in the cut run.

    The pairs, gathered per document (bounded by topics x depth), are broadcast onto the
    streaming corpus, so only needed documents survive the scan and are shuffled, never the
    corpus.  A document is tokenized and cut once; its passages are multiplied by its
    queries last, when the query side joins.
    """
    g = list(group_cols)
    pairs = (cut.select(*g, "qid", "docid").groupBy("docid")
             .agg(F.collect_list(F.struct(*g, "qid")).alias("_for")))
    # scoring costs far more than reading: the few needed documents are spread over all tasks
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    need = docs.join(broadcast_bounded(pairs, pair_bound), "docid").select("docid", "_for", "text").repartition(n, "docid")
    d = need.select("docid", "_for", tokenize("text").alias("tokens"))
    p = passages(d, passagelen, stride, numpassages, keep_cols=("docid", "_for"))
    p = p.select("docid", "pidx", "start", "ptokens", F.explode("_for").alias("_f")).select("docid", "pidx", "start",
                                                                                          "ptokens", "_f.*")
    return p.join(broadcast_bounded(qside, q_bound), "qid")


def hit_scores(cut: DataFrame, docs: DataFrame, qterms: DataFrame, scorers: Sequence[str] = ("bm25_passage",),
               k1: float = BM25_K1, b: float = BM25_B, passagelen: int = PASSAGE_LEN, stride: int = PASSAGE_STRIDE,
               numpassages: int | None = None, pair_bound: int | None = None, qterm_bound: int | None = None) -> DataFrame:
    """K6 from term hits: (qid, docid, pidx, <scorer>..) of every passage of the cut run.

    A document's positions are joined once with its queries' terms; each hit is given by
    arithmetic to the windows that hold it and counted per (query, document, window, term).
    No window is built and no term is searched in one, so the work is that of the hits.
    One marker position per document reaches all its windows, so those without a hit score 0.

    ``qterms``: (qid, term, qw, n_terms), n_terms being the query's distinct tokens (with
    those the corpus does not have).  The needed documents are shuffled by id before they
    are cut; all later groups hold the id and stay in their partition.
    """
    pairs = cut.select("qid", "docid").groupBy("docid").agg(F.collect_list("qid").alias("_for"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    need = docs.join(broadcast_bounded(pairs, pair_bound), "docid").select("docid", "_for", "text").repartition(n, "docid")
    tokens = need.select("docid", "_for", all_tokens("text").alias("_t"))
    places = tokens.select("docid", "_for", F.size("_t").alias("_n"),
                           F.posexplode_outer(F.concat(F.array(F.lit(DOC_MARK)), "_t")).alias("_p", "term"))
    marks = qterms.select("qid", "n_terms").distinct().select("qid", F.lit(DOC_MARK).alias("term"), F.lit(0.0).alias("qw"), "n_terms")
    known = broadcast_bounded(qterms.select("qid", "term", "qw", "n_terms").filter(F.col("term") != DOC_MARK).unionByName(marks),
                              None if qterm_bound is None else 2 * qterm_bound)
    hits = places.select("docid", "_n", "_p", "term", F.explode("_for").alias("qid")).join(known, ["qid", "term"])
    # windows that hold word p - 1 (p = 0, the marker: all of them)
    n_windows = passage_count(F.col("_n"), passagelen, stride, numpassages)
    low = F.when(F.col("_p") == 0, 0).otherwise(F.greatest(F.lit(0), F.ceil((F.col("_p") - passagelen) / F.lit(float(stride)))))
    high = F.when(F.col("_p") == 0, n_windows - 1).otherwise(F.least(n_windows - 1, F.floor((F.col("_p") - 1) / F.lit(float(stride)))))
    hits = (hits.select("docid", "qid", "term", "qw", "n_terms", "_n", low.cast("int").alias("_lo"), high.cast("int").alias("_hi"))
            .filter("_lo <= _hi")
            .select("docid", "qid", "term", "qw", "n_terms", "_n", F.explode(F.sequence("_lo", "_hi")).alias("pidx")))
    tf = (hits.groupBy("docid", "qid", "pidx", "term")
          .agg(F.count(F.lit(1)).cast("double").alias("tf"), F.max("qw").alias("qw"), F.max("n_terms").alias("n_terms"),
               F.max("_n").alias("_n")))
    length = F.least(F.lit(passagelen), F.col("_n") - F.col("pidx") * stride)
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length / F.lit(float(passagelen)))
    real = F.col("term") != DOC_MARK
    scores = {"bm25_passage": F.sum(F.when(real, F.col("qw") * (F.col("tf") / (F.col("tf") + norm))).otherwise(0.0)),
              "overlap": F.sum(F.when(real, 1.0).otherwise(0.0)) / F.max(F.when(F.col("n_terms") > 0, F.col("n_terms")).otherwise(1))}
    unknown = set(scorers) - set(scores)
    if unknown:
        raise ValueError(f"no scorer from term hits: {sorted(unknown)}")
    return tf.groupBy("qid", "docid", "pidx").agg(*[scores[s].alias(s) for s in scorers])


# --------------------------------------------------------------------- K7 / K8
def aggregations(score: str) -> dict[str, Column]:
    """The four aggregations of a passage score column, by name."""
    return {"max": F.max(score), "first": F.min_by(score, "pidx"), "sum": F.sum(score), "avg": F.avg(score)}


def compare_scorers(pairs: DataFrame, scorers: Sequence[str]) -> DataFrame:
    """(scorer, agg, qid, docid, score, rank) of every scorer and aggregation.

    All scorers are columns of one pass over the passages (see ``compare_scored``)."""
    return compare_scored(pairs.select("qid", "docid", "pidx", *[scorer_column(s).alias(s) for s in scorers]), scorers)


def compare_scored(scored: DataFrame, scorers: Sequence[str]) -> DataFrame:
    """K10 on passages that have a column for every scorer: all aggregations are one
    partial-aggregated groupBy; rows are multiplied after it."""
    wide = scored.groupBy("qid", "docid").agg(*[
        a.alias(f"_{how}{i}") for i, s in enumerate(scorers) for how, a in aggregations(s).items()])
    runs = F.array(*[F.struct(F.lit(s).alias("scorer"), F.lit(how).alias("agg"), F.col(f"_{how}{i}").alias("score"))
                     for i, s in enumerate(scorers) for how in AGGREGATIONS])
    long = wide.select("qid", "docid", F.explode(runs).alias("r")).select("r.scorer", "r.agg", "qid", "docid", "r.score")
    return rerank(long, "score", ["scorer", "agg"])


def aggregate_scores(scored: DataFrame, how: str | None = None,
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """K7: passage scores -> document scores.

    With ``how=None`` one partial-aggregated pass gives all four
    (score_max, score_first, score_sum, score_avg); with a name, one ``score``.
    """
    keys = [*group_cols, "qid", "docid"]
    aggs = aggregations("score")
    if how is None:
        return scored.groupBy(*keys).agg(*[aggs[a].alias(f"score_{a}") for a in AGGREGATIONS])
    if how not in aggs:
        raise ValueError(f"unknown aggregation {how!r}")
    return scored.groupBy(*keys).agg(aggs[how].alias("score"))


def rerank(df: DataFrame, score_col: str = "score", group_cols: Sequence[str] = ()) -> DataFrame:
    """K8: new ranks 1.. per query by score desc, docid desc."""
    return rank_within(df, [*group_cols, "qid"], score_col)
