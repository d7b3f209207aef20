"""Queries of the operators that select documents and pages (4, 8, 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, mix, url_filter
from .q_tokens import documents

# The rules of the url query.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, taken = mix.plan(documents(spark, sf_dir))
    words = taken.groupBy("uid").agg(F.sum("size").alias("taken"))
    return docs.join(words, "uid", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


OP4_SQL = """
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size
           from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as source_no
      from d group by source),
w as (select *, (1 + (source_no - 1) % 3)::double as weight, 3.0 * source_size as lim from s),
o as (select *, sum(source_size) over () as total,
        coalesce(sum(lim) over (order by lim / weight, source_no rows between unbounded preceding and 1 preceding), 0) as full_,
        sum(weight) over (order by lim / weight, source_no rows between current row and unbounded following) as rest,
        row_number() over (order by lim / weight, source_no) as pos from w),
l as (select arg_min((total - full_) / rest, pos) as level from o where lim > weight * (total - full_) / rest),
t as (select o.source, source_no, source_size, total, coalesce(least(lim, weight * level), lim)::double as target from o, l),
c as (select d.doc_id, d.size, t.source_no, t.target, t.total, p.pass_no,
        md5('42|' || p.pass_no || '|' || d.doc_id) as h
      from d join t on d.source is not distinct from t.source, (select unnest([1, 2, 3]) as pass_no) p),
f as (select *, sum(size) over (partition by source_no order by pass_no, h, doc_id, size) / target as finish from c),
g as (select *, sum(size) over (order by finish, source_no, pass_no, doc_id, size) as upto from f)
select d.doc_id, d.size, t.source_size, t.target, k.taken from d
join t on d.source is not distinct from t.source
join (select doc_id, sum(case when upto <= total then size else 0 end)::bigint as taken from g group by doc_id) k
  on k.doc_id = d.doc_id
"""


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf_dir)).drop("n_chars")


OP8_SQL = """
with d as (select doc_id, length(coalesce(text, '')) as n,
                  regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as norm from documents),
g as (select norm, count(*) as group_size, first(doc_id order by n desc, doc_id) as keep_id from d group by norm)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.norm) as text_sha256
from d join g on d.norm = g.norm
"""


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages, url_filter.parse_rules(URL_RULES)).drop("url")


OP10_SQL = """
with u as (select page_id, case when url is null or instr(url, '://') = 0 then ''
                                else substr(url, instr(url, '://') + 3) end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(action, host, path) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
   ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m as (select h.*, (select arg_max({'rule': r.host || r.path, 'action': r.action}, [length(r.host || r.path), length(r.host)]) from r
                   where (h.host = r.host or ends_with(h.host, '.' || r.host)) and starts_with(h.path, r.path)) as won
      from h)
select page_id, host, path, won.rule as rule, coalesce(won.action, 'allow') as verdict from m
"""

QUERIES = {"op4_mix": op4_mix, "op8_exact": op8_exact, "op10_urls": op10_urls}
ORACLE = {"op4_mix": OP4_SQL, "op8_exact": OP8_SQL, "op10_urls": OP10_SQL}
