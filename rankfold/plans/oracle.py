"""DuckDB SQL for every registered query (the correctness oracle).

Shared derivations are CTEs with dependencies; ``sql(body, *ctes)`` expands them
in order.  Floating outputs are rounded to 6 digits in both engines and ranks
use the same (rounded score desc, docid desc) order.
"""

from __future__ import annotations

# name -> (deps, definition)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}
# Those that DuckDB is told to compute once (a recursion would compute them every round).
MATERIALIZED: set[str] = set()


def cte(name: str, deps: tuple[str, ...], body: str, once: bool = False) -> None:
    CTES[name] = (deps, body)
    if once:
        MATERIALIZED.add(name)


def nudge_rounding(q: str) -> str:
    """``round(x, 6)`` -> ``round(x + 1e-9, 6)`` except in ORDER BY keys (see registry.r6)."""
    out, i = [], 0
    while True:
        j = q.find("round(", i)
        if j < 0:
            out.append(q[i:])
            return "".join(out)
        k, depth = j + len("round("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(q[k], 0)
            k += 1
        inner = q[j + 6:k - 1]
        head, _, digits = inner.rpartition(",")
        ordering = q[max(0, j - 40):j].upper().rstrip().endswith("BY") or "OVER" in q[j:k] \
            or q[max(0, j - 40):j].upper().rfind("ORDER BY") > q[max(0, j - 40):j].rfind(")")
        if digits.strip() == "6" and not ordering:
            out.append(q[i:j] + f"round(({nudge_rounding(head)}) + 1e-9, 6)")
        else:
            out.append(q[i:k])
        i = k


def sql(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return nudge_rounding(body.strip())
    parts = [f"{n} AS {'MATERIALIZED ' if n in MATERIALIZED else ''}(\n{CTES[n][1].strip()}\n)" for n in order]
    return nudge_rounding("WITH " + ",\n".join(parts) + "\n" + body.strip())


TOK = r"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def tok(c: str) -> str:
    return TOK.format(c=c)


D = "CAST({} AS DOUBLE)".format

# -- corpus -----------------------------------------------------------------
cte("dtok", (), f"""
SELECT CAST(doc_id AS VARCHAR) AS docid, doc_id, lang, {tok('text')} AS tokens FROM documents
""")
cte("coll", ("dtok",), "SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM dtok")
cte("postings", ("dtok",), """
SELECT docid, dl, term, count(*) AS tf
FROM (SELECT docid, len(tokens) AS dl, unnest(tokens) AS term FROM dtok) GROUP BY docid, dl, term
""")

# -- topics -------------------------------------------------------------------
cte("ttok", (), f"SELECT CAST(item_id AS VARCHAR) AS qid, item_id, text, {tok('text')} AS tokens FROM benchmark")
cte("title", ("ttok",), """
SELECT qid, item_id, array_to_string(tokens, ' ') AS query FROM ttok
""")
cte("qt", ("title",), f"""
SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tok('query')}) AS term FROM title) GROUP BY qid, term
""")
cte("qvocab", ("qt",), "SELECT DISTINCT term FROM qt")

# -- qrels ----------------------------------------------------------------------
cte("tterms", ("ttok",), "SELECT DISTINCT qid, item_id, unnest(tokens) AS term FROM ttok")
cte("tsize", ("tterms",), "SELECT qid, item_id, count(*) AS nt FROM tterms GROUP BY qid, item_id")
cte("dterms", ("dtok",), "SELECT DISTINCT docid, doc_id, unnest(tokens) AS term FROM dtok")
cte("qrels", ("tterms", "tsize", "dterms"), """
SELECT qid, docid, rel FROM (
  SELECT h.qid, h.docid,
         CASE WHEN h.nh / s.nt >= 0.95 THEN 2
              WHEN h.nh / s.nt >= 0.4 THEN 1
              WHEN h.nh / s.nt >= 0.2 THEN 0 END AS rel
  FROM (SELECT t.qid, t.item_id, d.docid, d.doc_id, count(*) AS nh
        FROM dterms d JOIN tterms t ON d.term = t.term GROUP BY ALL) h
  JOIN tsize s ON h.qid = s.qid AND h.item_id = s.item_id
) WHERE rel IS NOT NULL
""")

# -- BM25 run ---------------------------------------------------------------------
cte("qtf", ("postings", "qvocab"), "SELECT * FROM postings WHERE term IN (SELECT term FROM qvocab)")
cte("qdf", ("qtf",), "SELECT term, count(*) AS df FROM qtf GROUP BY term")
cte("qw", ("qt", "qdf", "coll"), f"""
SELECT qid, term, qtf * ln({D(1.0)} + ((SELECT n FROM coll) - df + {D(0.5)}) / (df + {D(0.5)})) AS qw
FROM qt JOIN qdf USING (term)
""")


def bm25_scored(k1: str = "0.9", b: str = "0.4") -> str:
    return f"""
SELECT qid, docid, sum(qw * (tf / (tf + {D(k1)} * (({D(1.0)} - {D(b)}) + {D(b)} * dl / (SELECT avgdl FROM coll))))) AS score
FROM qtf JOIN qw USING (term) GROUP BY qid, docid
"""


cte("bm25_scored", ("qtf", "qw", "coll"), bm25_scored())
cte("run", ("bm25_scored",), """
SELECT qid, docid, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT qid, docid, score,
         row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, docid DESC) AS rank
  FROM bm25_scored) WHERE rank <= 1000
""")
cte("cut", ("run",), "SELECT * FROM run WHERE rank <= 100")

# -- passages of the cut run and their BM25 scores -----------------------------------
cte("cutdocs", ("cut", "dtok"), "SELECT docid, tokens FROM dtok WHERE docid IN (SELECT docid FROM cut)")


def passages_of(src: str, cap: str | None = None) -> str:
    n = "greatest(1, CAST(ceil((len(tokens) - 150) / 75.0) AS BIGINT) + 1)"
    if cap:
        n = f"least({cap}, {n})"
    return f"""
SELECT docid, CAST(pidx AS INTEGER) AS pidx, CAST(pidx * 75 AS INTEGER) AS start,
       list_slice(tokens, pidx * 75 + 1, pidx * 75 + 150) AS ptokens
FROM (SELECT docid, tokens, unnest(range(0, {n})) AS pidx FROM {src})
"""


cte("cutpass", ("cutdocs",), passages_of("cutdocs"))
cte("ppairs", ("cut", "cutpass"), "SELECT c.qid, p.* FROM cut c JOIN cutpass p USING (docid)")


def bm25_passage_of(pairs: str, passages: str) -> str:
    """BM25 of every passage of the (qid, docid) pairs; a term counts as often as it occurs."""
    return f"""
SELECT qid, docid, pidx, coalesce(sum(qw * (tfp / (tfp + {D(0.9)} * (({D(1.0)} - {D(0.4)}) + {D(0.4)} * pl / {D(150.0)})))), 0.0) AS score
FROM (SELECT c.qid, p.docid, p.pidx, len(p.ptokens) AS pl, w.qw,
             CAST(len(list_filter(p.ptokens, lambda x: x = w.term)) AS DOUBLE) AS tfp
      FROM {pairs} c JOIN {passages} p ON p.docid = c.docid LEFT JOIN qw w ON w.qid = c.qid)
GROUP BY qid, docid, pidx
"""


cte("pscore_bm25", ("cut", "cutpass", "qw"), bm25_passage_of("cut", "cutpass"))
cte("agg_bm25", ("pscore_bm25",), """
SELECT qid, docid, max(score) AS score_max, min_by(score, pidx) AS score_first,
       sum(score) AS score_sum, avg(score) AS score_avg
FROM pscore_bm25 GROUP BY qid, docid
""")


def reranked(col: str) -> str:
    return f"""
SELECT qid, docid, {col} AS score,
       CAST(row_number() OVER (PARTITION BY qid ORDER BY round({col}, 6) DESC, docid DESC) AS INTEGER) AS rank
FROM agg_bm25
"""


cte("maxp", ("agg_bm25",), reranked("score_max"))


# -- metrics ------------------------------------------------------------------------------
def per_query_sql(run: str, qrels: str = "qrels", ks_p=(20,), ks_ndcg=(20,), ks_judged=(10, 20, 200),
                  group: tuple[str, ...] = (), level: int = 1) -> str:
    """Per-query metrics of ``run`` (g.., qid, docid, rank) in wide form."""
    g = ", ".join(group)
    gc = (g + ", ") if g else ""
    gj = "".join(f" AND s.{c} = a.{c}" for c in group)
    kmax = max(ks_ndcg) if ks_ndcg else 1
    ideal_cols = ", ".join(
        f"sum(CASE WHEN i <= {k} THEN rel / (ln(i + {D(1.0)}) / ln({D(2.0)})) ELSE {D(0.0)} END) AS idcg_{k}"
        for k in ks_ndcg) or "0 AS idcg_none"
    aggs = [
        f"sum(CASE WHEN is_rel = 1 THEN pos_r / rank ELSE {D(0.0)} END) AS ap",
        f"sum(CASE WHEN is_rel = 1 THEN (CASE WHEN N = 0 THEN {D(1.0)} ELSE {D(1.0)} - least(pos_j - pos_r, least(R, N)) / least(R, N) END) ELSE {D(0.0)} END) AS bp",
    ]
    aggs += [f"sum(CASE WHEN rank <= {k} AND is_rel = 1 THEN 1 ELSE 0 END) AS rel_{k}" for k in ks_p]
    aggs += [f"sum(CASE WHEN rank <= {k} THEN 1 ELSE 0 END) AS jud_{k}" for k in ks_judged]
    aggs += [f"sum(CASE WHEN rank <= {k} AND rel > 0 THEN rel / (ln(rank + {D(1.0)}) / ln({D(2.0)})) ELSE {D(0.0)} END) AS dcg_{k}"
             for k in ks_ndcg]
    outs = [
        f"CASE WHEN s.R > 0 THEN coalesce(a.ap, 0) / s.R ELSE {D(0.0)} END AS map",
        f"CASE WHEN s.R > 0 THEN coalesce(a.bp, 0) / s.R ELSE {D(0.0)} END AS bpref",
    ]
    outs += [f"coalesce(a.rel_{k}, 0) / {D(k)} AS P_{k}" for k in ks_p]
    outs += [f"CASE WHEN coalesce(i.idcg_{k}, 0) > 0 THEN coalesce(a.dcg_{k}, 0) / i.idcg_{k} ELSE {D(0.0)} END AS ndcg_cut_{k}"
             for k in ks_ndcg]
    outs += [f"coalesce(a.jud_{k}, 0) / {D(k)} AS judged_{k}" for k in ks_judged]
    sel_g = ", ".join(f"s.{c}" for c in group)
    sel_g = (sel_g + ", ") if sel_g else ""
    return f"""
(WITH qstats AS (
   SELECT qid, sum(CASE WHEN rel >= {level} THEN 1 ELSE 0 END) AS R,
          sum(CASE WHEN rel < {level} THEN 1 ELSE 0 END) AS N
   FROM {qrels} GROUP BY qid),
 qset AS (SELECT DISTINCT {gc}r.qid, qs.R, qs.N FROM {run} r JOIN qstats qs ON r.qid = qs.qid),
 j AS (
   SELECT {gc}qid, docid, rank, rel, R, N, CASE WHEN rel >= {level} THEN 1 ELSE 0 END AS is_rel,
          row_number() OVER (PARTITION BY {gc}qid ORDER BY rank, docid) AS pos_j,
          sum(CASE WHEN rel >= {level} THEN 1 ELSE 0 END) OVER (PARTITION BY {gc}qid ORDER BY rank, docid
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pos_r
   FROM (SELECT r.*, q.rel, qs.R, qs.N FROM (SELECT {gc}qid, docid, rank FROM {run}) r
         JOIN {qrels} q ON r.qid = q.qid AND r.docid = q.docid JOIN qstats qs ON r.qid = qs.qid)),
 a AS (SELECT {gc}qid, {', '.join(aggs)} FROM j GROUP BY ALL),
 ideal AS (SELECT qid, {ideal_cols} FROM (
   SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, docid DESC) AS i
   FROM {qrels} WHERE rel > 0) WHERE i <= {kmax} GROUP BY qid)
 SELECT {sel_g}s.qid, {', '.join(outs)}
 FROM qset s LEFT JOIN a ON s.qid = a.qid{gj} LEFT JOIN ideal i ON s.qid = i.qid)
"""
