"""Text preparation and document lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..sources import testbed
from . import oracle as O
from .registry import X, register


def _sql_html_to_text(col: str) -> str:
    """Written apart from the Spark patterns: one step per kind of block (RE2 has no back
    references), and the references that the pages hold."""
    c = f"regexp_replace({col}, '<!--(.|\\n)*?-->', ' ', 'g')"
    for tag in ("script", "style", "object", "applet", "iframe"):
        c = f"regexp_replace({c}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    c = f"regexp_replace({c}, '(?i)<(meta|embed|link)\\b[^>]*>', ' ', 'g')"
    c = f"""regexp_replace({c}, '<[A-Za-z/!?]("[^"]*"|''[^'']*''|[^''">])*>', ' ', 'g')"""
    c = f"regexp_replace({c}, '<[A-Za-z/!?][^>]*>', ' ', 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " "), ("copy", "©"),
                       ("middot", "·"), ("amp", "&")):
        c = f"replace({c}, '&{name};', '{char}')"
    return _sql_squash(c)


def _sql_squash(c: str) -> str:
    return f"trim(regexp_replace({c}, '{T.WS_RE}', ' ', 'g'))"


def _pages(spark, sf_dir):
    return testbed.table(spark, sf_dir, "pages")


@register("html_to_text", O.sql(f"SELECT page_id, {_sql_html_to_text('html')} AS text FROM pages"))
def q_html_to_text(spark, sf_dir):
    """T2 over every page."""
    return _pages(spark, sf_dir).select("page_id", T.html_to_text("html").alias("text"))


@register("ws_squash", O.sql(f"SELECT doc_id, {_sql_squash('text')} AS text FROM documents"))
def q_ws_squash(spark, sf_dir):
    """T3 over every document."""
    d = testbed.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.squash_ws("text").alias("text"))


@register("marker_lines", O.sql(f"""
SELECT page_id, CAST(len(string_split(html, chr(10))) AS INTEGER) AS n_lines,
       CAST(len(list_filter(string_split(html, chr(10)),
                            lambda l: regexp_matches(lower(l), '{T.MARKER_RE}'))) AS INTEGER) AS n_marker
FROM pages
"""))
def q_marker_lines(spark, sf_dir):
    """T4: lines of every page and how many hold a record tag."""
    lines = F.split(F.col("html"), "\n")
    return _pages(spark, sf_dir).select(
        "page_id", F.size(lines).alias("n_lines"),
        F.size(F.filter(lines, lambda l: T.has_marker(l))).alias("n_marker"))


# Layout of a trec-web id built from a numeric id (dir, file, record).
DOCID_FMT = "GX%03d-%02d-%07d"


def trec_docid(doc_id):
    c = F.col(doc_id)
    return F.format_string(DOCID_FMT, (c / 10000).cast("long"), ((c / 100).cast("long") % 100), c % 100)


@register("docid_parts", O.sql(f"""
SELECT doc_id, d[1] AS dir, d[2] AS file, d[3] AS record, d[1] || '/' || d[2] || '.gz' AS shard
FROM (SELECT doc_id, string_split(printf('{DOCID_FMT}', doc_id // 10000, (doc_id // 100) % 100, doc_id % 100), '-') AS d
      FROM documents)
"""))
def q_docid_parts(spark, sf_dir):
    """T5 on trec-style ids derived from every document id."""
    d = testbed.table(spark, sf_dir, "documents").select("doc_id", trec_docid("doc_id").alias("docid"))
    return d.select("doc_id", T.split_docid("docid").alias("p")).select("doc_id", "p.*")


@register("run_docids", O.sql("SELECT DISTINCT docid FROM run", "run"))
def q_run_docids(spark, sf_dir):
    """L1: every document the BM25 run needs."""
    return C.run_docids(X(spark, sf_dir, False).search_run)


@register("fetch_docs", O.sql("""
SELECT CAST(doc_id AS VARCHAR) AS docid, n_chars, text FROM documents
WHERE CAST(doc_id AS VARCHAR) IN (SELECT docid FROM cut)
""", "cut"))
def q_fetch_docs(spark, sf_dir):
    """L2: only the documents of the rerank cut (topics x 100, broadcast semi join)."""
    x = X(spark, sf_dir)
    d = testbed.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("docid"), "n_chars", "text")
    return C.fetch_docs(d, C.run_docids(x.cut), ids_bound=x.cut_bound)


@register("missing_docs", O.sql("""
SELECT docid FROM (SELECT docid FROM run UNION SELECT CAST(doc_id AS VARCHAR) FROM labels)
WHERE docid NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)
""", "run"))
def q_missing_docs(spark, sf_dir):
    """L2 check: asked ids (run and labels) that the corpus lacks; expected empty."""
    x = X(spark, sf_dir)
    asked = C.run_docids(x.search_run).unionByName(
        testbed.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("docid")))
    return C.missing_docs(x.docs.select("docid"), asked)


@register("missing_docs_absent", O.sql("""
SELECT DISTINCT 'new-' || doc_id AS docid FROM labels WHERE quality = 0
"""))
def q_missing_docs_absent(spark, sf_dir):
    """L2 check with ids that the corpus does not have: exactly those come out."""
    x = X(spark, sf_dir)
    labels = testbed.table(spark, sf_dir, "labels")
    asked = labels.select(F.col("doc_id").cast("string").alias("docid")).unionByName(
        labels.filter("quality = 0").select(F.concat(F.lit("new-"), F.col("doc_id").cast("string")).alias("docid")))
    return C.missing_docs(x.docs.select("docid"), asked)
