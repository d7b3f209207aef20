"""Queries on postings kept by term."""

from __future__ import annotations

from ..operators import postings as P
from ..operators.rerank import RERANK_DEPTH
from ..operators.retrieve import SEARCH_DEPTH, bm25
from ..session import scratch_dir
from . import oracle as O
from .registry import X, r6, register

K = RERANK_DEPTH


def _index(x):
    path = scratch_dir(x.spark, "postings")
    P.write_index(x.docs, path)
    return P.read_index(x.spark, path)


@register("bm25_from_postings", O.sql("SELECT qid, docid, rank, round(score, 6) AS score FROM run", "run"))
def q_bm25_from_postings(spark, sf_dir):
    """R1 + R2 + R3: the run of ``bm25_top`` from an index on disk, without the corpus."""
    x = X(spark, sf_dir, False)
    run = bm25(None, None, k=SEARCH_DEPTH, parts=P.index_parts(_index(x), x.title, qterm_bound=x.title_bound))
    return run.select("qid", "docid", "rank", r6("score").alias("score"))


@register("postings_terms", O.sql("""
SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS cf, CAST(max(tf) AS BIGINT) AS max_tf,
       CAST(min(dl) AS INTEGER) AS min_dl FROM postings GROUP BY term
""", "postings"))
def q_postings_terms(spark, sf_dir):
    """The dictionary of the index."""
    return _index(X(spark, sf_dir, False)).table("terms").select("term", "df", "cf", "max_tf", "min_dl")


@register("bm25_safe", O.sql("SELECT qid, docid, rank, round(score, 6) AS score FROM cut", "cut"))
def q_bm25_safe(spark, sf_dir):
    """The 100 best documents of every query, found with score bounds."""
    x = X(spark, sf_dir, False)
    run = P.safe_top_k(_index(x), x.title, K, qterm_bound=x.title_bound).run
    return run.select("qid", "docid", "rank", r6("score").alias("score"))


_PART = f"tf / (tf + {O.D('0.9')} * (({O.D('1.0')} - {O.D('0.4')}) + {O.D('0.4')} * dl / (SELECT avgdl FROM coll)))"
O.cte("safe_order", ("qw", "qtf", "coll"), f"""
SELECT *, coalesce(sum(df) OVER (PARTITION BY qid ORDER BY top DESC, term
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {P.FIRST_HITS * K} AS lead_,
       sum(top) OVER (PARTITION BY qid ORDER BY top DESC, term ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later
FROM (SELECT qid, term, qw, df, qw * max_part AS top FROM qw
      JOIN (SELECT term, count(*) AS df, max({_PART}) AS max_part FROM qtf GROUP BY term) USING (term))
""")
O.cte("safe_hit", ("safe_order", "qtf", "coll"), f"""
SELECT o.qid, p.docid, o.term, o.lead_, o.qw * ({_PART}) AS w FROM safe_order o JOIN qtf p ON p.term = o.term
""")


def _floor(sums: str) -> str:
    return f"""
SELECT qid, score AS low FROM (
  SELECT qid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid DESC) AS r FROM {sums}) WHERE r = {K}
"""


O.cte("safe_first", ("safe_hit",), "SELECT qid, docid, sum(w) AS score FROM safe_hit WHERE lead_ GROUP BY qid, docid")
O.cte("safe_floor1", ("safe_first",), _floor("safe_first"))
O.cte("safe_parted", ("safe_order", "safe_floor1"), f"""
SELECT o.*, (lead_ OR low IS NULL OR later >= low - {P.SLACK}) AS essential
FROM safe_order o LEFT JOIN safe_floor1 f ON f.qid = o.qid
""")
O.cte("safe_all", ("safe_hit", "safe_parted"), """
SELECT h.qid, h.docid, h.w, t.essential FROM safe_hit h JOIN safe_parted t ON t.qid = h.qid AND t.term = h.term
""")
O.cte("safe_sums", ("safe_all",), "SELECT qid, docid, sum(w) AS score FROM safe_all WHERE essential GROUP BY qid, docid")
O.cte("safe_floor2", ("safe_sums",), _floor("safe_sums"))
O.cte("safe_alive", ("safe_sums", "safe_floor2", "safe_parted"), f"""
SELECT s.qid, s.docid FROM safe_sums s LEFT JOIN safe_floor2 f ON f.qid = s.qid
LEFT JOIN (SELECT qid, sum(top) AS rest FROM safe_parted WHERE NOT essential GROUP BY qid) r ON r.qid = s.qid
WHERE low IS NULL OR score >= low - coalesce(rest, 0.0) - {P.SLACK}
""")


@register("bm25_safe_hits", O.sql("""
SELECT t.qid, CAST(t.hits AS BIGINT) AS hits, CAST(t.sure + coalesce(m.more, 0) AS BIGINT) AS scored
FROM (SELECT qid, sum(df) AS hits, sum(CASE WHEN essential THEN df ELSE 0 END) AS sure FROM safe_parted GROUP BY qid) t
LEFT JOIN (SELECT h.qid, count(*) AS more FROM safe_all h JOIN safe_alive a ON a.qid = h.qid AND a.docid = h.docid
           WHERE NOT h.essential GROUP BY h.qid) m ON m.qid = t.qid
""", "safe_parted", "safe_all", "safe_alive"))
def q_bm25_safe_hits(spark, sf_dir):
    """Per query, the postings of its terms and those of them that were scored."""
    x = X(spark, sf_dir, False)
    return P.safe_top_k(_index(x), x.title, K, qterm_bound=x.title_bound).hits
