"""Operators 4, 8 and 10 against brute force and small edge tables."""

import hashlib
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from rankfold.llm import exact_dedup, mix, q_select, queries, url_filter
from tools.oracle_check import rows_of

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, size string"
EDGE = [(1, "a b c", "x", None), (2, "a  b\tc\n", "y", None), (3, None, "x", None), (4, "", None, None),
        (None, "abc", "x", None), (5, "z " * 50_000, None, None), (2, "a  b\tc\n", "y", None), (6, " \n", "x", None)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    got = queries.queries()[name](spark, DIR)
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())


# -- 8 ---------------------------------------------------------------------------------------
def brute_groups(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc))
    out = []
    for doc, text, *_ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        n, _, keep = min(groups[norm], key=lambda g: (g[0], g[1], g[2] or 0))
        out.append((doc, keep, len(groups[norm]), doc == keep and len(text or "") == -n,
                    hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact_groups_compare_content_even_if_digests_clash(spark, digest):
    rows = EDGE + [(100 + i, f"text {i % 40}" + " " * (i % 3), "x", None) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = exact_dedup.groups(df, salts=3, digest=digest).drop("n_chars").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_groups(rows)


def test_exact_keep_returns_one_row_per_group(spark):
    df = spark.createDataFrame(EDGE, SCHEMA)
    kept = exact_dedup.keep(df)
    assert kept.columns == df.columns
    clash = exact_dedup.keep(df.withColumn("_id", F.lit(7)).withColumn("row", F.lit("r")))
    assert {(r["_id"], r["row"]) for r in clash.collect()} == {(7, "r")}
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6]
    assert exact_dedup.keep(spark.createDataFrame([], SCHEMA)).count() == 0
    assert exact_dedup.groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_aggregations_stay_in_hash_tables(spark):
    plan = exact_dedup.groups(q_select.documents(spark, DIR))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Python" not in plan


# -- 4 ---------------------------------------------------------------------------------------
def fill(sizes, weights, cap, total):
    """Targets by raising a level until nothing is above its limit."""
    target, open_, left = {}, set(sizes), total
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level >= cap * sizes[s]}
        if not over:
            return target | {s: weights[s] * level for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_equal_repeated_sharing(spark):
    sizes = {"a": 10, "b": 500, "c": 0, "d": 40, "e": 1000, "é": 3, None: 77}
    t = mix.targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long"))
    got = {r.source: r for r in t.collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: 1 + i % 3 for i, s in enumerate(order)}
    want = fill(sizes, weights, 3, sum(sizes.values()))
    assert {s: r.weight for s, r in got.items()} == weights
    for s in sizes:
        assert got[s].target == pytest.approx(want[s])


def test_mix_follows_targets_and_repeats_whole_documents(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{0 if i % 3 else i % 5}", None) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    docs, taken = mix.plan(df)
    d, t = docs.toPandas(), taken.toPandas()
    words = t.groupby("uid")["size"].sum()
    d["taken"] = d.uid.map(words).fillna(0)
    assert (d.taken <= 3 * d["size"]).all() and t["size"].sum() <= d["size"].sum()
    assert t["size"].sum() > 0.99 * d["size"].sum()
    for _, g in d.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.03 * g.target.iloc[0] + 14
    again = mix.plan(df)[1].toPandas()
    assert sorted(again[["doc_id", "pass_no", "words_before"]].values.tolist()) == sorted(
        t[["doc_id", "pass_no", "words_before"]].values.tolist())
    assert sorted(t.words_before + t["size"])[-1] == t["size"].sum()
    out = mix.mix(df)
    assert out.columns == df.columns
    assert out.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict() == \
        t.groupby("doc_id").size().to_dict()


def test_mix_edge_tables(spark):
    df = spark.createDataFrame(EDGE, SCHEMA)
    out = mix.mix(df).collect()
    assert len(out) >= 1
    assert mix.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = spark.createDataFrame([(1, None, None, None), (2, "", "x", None)], SCHEMA)
    assert {r.target for r in mix.plan(nothing)[0].collect()} == {0.0}


# -- 10 --------------------------------------------------------------------------------------
def test_trie_equals_a_scan_of_all_rules(spark):
    rules = url_filter.parse_rules(q_select.URL_RULES + [
        ("block", "a.example.com/x/y"), ("allow", "a.example.com/x/yz/"), ("block", "org"), ("allow", "org"),
        ("allow", "www.org/a//b"), ("block", "/private/"),
        # more labels against more characters, and equally long ones
        ("block", "com/x/yz/1"), ("allow", "B.a.example.com/x"), ("block", "com/en/1"), ("allow", "a.example.com"),
        ("block", "x.net/e"), ("allow", "net/fr/e")])
    urls = [f"http://{h}{p}" for h in ("example.com", "WWW.example.com", "a.example.com", "b.a.example.com", "com",
                                       "xcom", "x.net", "org", "www.org", "", "example.com:80", "a..com")
            for p in ("", "/", "/en", "/en/", "/en/1?x#y", "/x/y", "/x/yz", "/x/yz/1", "/x/yy", "/es/a", "/fr/",
                      "/a//b", "/a//bc/d", "/private/q", "?q=/en/", "#/en/")] + [None, "", "no url", "ftp:/x", "x://"]
    df = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "page_id long, url string, extra string")
    rows = url_filter.judge(df, rules, default="none").collect()
    assert len(rows) == len(urls)
    for r in rows:
        rest = (r.url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.lower()
        fits = [x for x in rules if (not x.host or host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: (len(x.name), len(x.host), x.action == "block"), default=None)
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == ((best.name, best.action) if best else (None, "none")), r.url
    assert url_filter.judge(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(df, []).collect()} == {"allow"}
    clash = url_filter.judge(df.withColumnRenamed("extra", "Host"), rules)
    assert clash.columns == ["page_id", "url", "host", "path", "rule", "verdict"] and clash.count() == len(urls)
