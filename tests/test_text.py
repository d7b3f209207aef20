from pyspark.sql import functions as F

from rankfold.functions import text as T


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "v string").select(col.alias("o")).first()[0]


def test_tokenize_whole_text(spark):
    assert one(spark, T.tokenize("v"), "Hello, World! 42x  ÉTÉ--été") == ["hello", "world", "42x", "été", "été"]
    assert one(spark, T.tokenize("v"), "") == []
    long = " ".join(f"w{i}" for i in range(20000))
    assert len(one(spark, T.tokenize("v"), long)) == 20000


def test_squash_ws(spark):
    assert one(spark, T.squash_ws("v"), "  a \t\n b c  ") == "a b c"


def test_html_to_text(spark):
    html = ('<html><head><script>var t="</p>";</script><style>p{x}</style><meta charset="x"></head>'
            '<body><!-- hidden <b>x</b> --><p>Fish &amp; chips &lt;3<p>more&nbsp;text &copy; &amp;lt;</body>')
    assert one(spark, T.html_to_text("v"), html) == "Fish & chips <3 more text © &lt;"


def test_html_keeps_plain_text(spark):
    cases = {
        "<p>3 < 4 and 5 > 2</p>": "3 < 4 and 5 > 2",
        '<a title="x > y">in</a> <b class=\'a>b\'>bold</b>': "in bold",
        '<a title="never closed>text</a>': "text",
        "caf&eacute; &#8217; &ndash; &#x1F600; &amp;lt; &unknown; & x &#0;": "café ’ – 😀 &lt; &unknown; & x &#0;",
        "a<noscript>shown</noscript>b": "a shown b",
        "a<script>if (x < 1) y</style> hidden</script>b": "a b",
        "a<script>never closed": "a",
        "a<!-- x --> b <!-- never closed": "a b",
        "<iframe src=x>inner</iframe>y<embed src=z>": "y",
        "1 <2 and <3": "1 <2 and <3",
    }
    df = spark.createDataFrame(list(cases.items()), "html string, want string")
    for r in df.select("html", "want", T.html_to_text("html").alias("got")).collect():
        assert r.got == r.want, r.html


def test_has_marker(spark):
    assert one(spark, T.has_marker("v"), "x <DOCNO> y")
    assert one(spark, T.has_marker("v"), "</dochdr>")
    assert not one(spark, T.has_marker("v"), "<docs>")


def test_split_docid(spark):
    r = spark.createDataFrame([("GX000-10-0000001",)], "v string").select(T.split_docid("v").alias("p")).first()[0]
    assert (r.dir, r.file, r.record, r.shard) == ("GX000", "10", "0000001", "GX000/10.gz")


def test_fit_budget(spark):
    df = spark.createDataFrame([(["q"] * 10, ["p"] * 300)], "q array<string>, p array<string>")
    assert df.select(F.size(T.fit_budget("q", "p", 256))).first()[0] == 243
    df = spark.createDataFrame([(["q"] * 300, ["p"] * 5)], "q array<string>, p array<string>")
    assert df.select(F.size(T.fit_budget("q", "p", 256))).first()[0] == 0


def test_parse_trecweb_errors(spark):
    recs = [
        "<DOC>\n<DOCNO>GX1-00-1</DOCNO>\n<DOCHDR>\nhttp://x\n</DOCHDR>\n<p>body</p>",
        "<DOC>\n<DOCNO>GX1-00-2</DOCNO>\n<DOCHDR>\nhttp://x\n<p>no header end</p>",
        "<DOC>\njunk<DOCNO>GX1-00-3</DOCNO>",
        "<DOC>\n<DOCNO>GX1-00-4</DOCNO>\n</DOCHDR>x<DOCHDR>",
    ]
    df = spark.createDataFrame([(r,) for r in recs], "v string")
    d, h, e = T.parse_trecweb(F.col("v"))
    out = df.select(d.alias("d"), h.alias("h"), e.alias("e")).collect()
    assert (out[0].d, out[0].h, out[0].e) == ("GX1-00-1", "<p>body</p>", None)
    assert out[1].e == "missing </DOCHDR>" and out[1].d == "GX1-00-2" and out[1].h is None
    assert out[2].e == "record does not start with <DOCNO>" and out[2].d is None
    assert out[3].e == "</DOCHDR> before <DOCHDR>"


def test_uniform_is_stable(spark):
    df = spark.createDataFrame([("a", 1)], "k string, i int")
    u = df.select(T.uniform(42, "k", "i")).first()[0]
    import hashlib
    h = hashlib.md5(b"42|a|1").hexdigest()
    assert abs(u - int(h[:8], 16) / 2 ** 32) < 1e-15
