import gzip
import os

from rankfold.sources import files as S


def test_trecweb_edge_cases(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "GX000")
    os.makedirs(d)
    recs = (b"<DOC>\n<DOCNO>GX000-00-0000001</DOCNO>\n<DOCHDR>\nhttp://a\n</DOCHDR>\n<p>one \xff\xfe bad</p>\n</DOC>\n"
            b"<DOC>\n<DOCNO>GX000-00-0000002</DOCNO>\n<DOCHDR>\nhttp://b\n</DOCHDR>\n<p>text </DOC> inside</p>\n</DOC>\n"
            b"<DOC>\n<DOCNO>GX000-00-0000003</DOCNO>\n<DOCHDR>\nhttp://c\n<p>no header end</p>\n</DOC>\n"
            b"<DOC>\n<DOCNO>GX000-00-0000001</DOCNO>\n<DOCHDR>\nhttp://a2\n</DOCHDR>\nsecond copy\n</DOC>\n")
    with gzip.open(os.path.join(d, "00.gz"), "wb") as f:
        f.write(recs)
    with gzip.open(os.path.join(d, "01.gz"), "wb") as f:
        f.write(b"")
    got = {r.docid: r for r in S.read_trecweb(spark, tmpdir_path).collect()}
    assert set(got) == {"GX000-00-0000001", "GX000-00-0000002", "GX000-00-0000003"}
    assert got["GX000-00-0000001"].html == "second copy"          # repeated id: last record wins
    assert got["GX000-00-0000002"].html == "<p>text  inside</p>"  # a tag inside a line is dropped, its text stays
    assert got["GX000-00-0000003"].parse_error == "missing </DOCHDR>"


def test_trecweb_bad_bytes_dropped(spark, tmpdir_path):
    with gzip.open(os.path.join(tmpdir_path, "x.gz"), "wb") as f:
        f.write(b"<DOC>\n<DOCNO>A-1-1</DOCNO>\n<DOCHDR>\n</DOCHDR>\nok\xffok\n</DOC>\n")
    r = S.read_trecweb(spark, tmpdir_path).first()
    assert r.html == "okok"


def test_folds_json_set_semantics(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "f.json")
    with open(p, "w") as f:
        f.write('{"s1": {"train_qids": ["1", "1", "2"], "predict": {"dev": ["3"], "test": ["4", "4"]}}}')
    got = sorted((r.fold, r.split, r.qid) for r in S.read_folds(spark, p).collect())
    assert got == [("s1", "dev", "3"), ("s1", "test", "4"), ("s1", "train", "1"), ("s1", "train", "2")]


def test_folds_round_trip(spark, tmpdir_path):
    folds = spark.createDataFrame([("s1", "train", "1"), ("s1", "test", "2"), ("s2", "dev", "2")],
                                  "fold string, split string, qid string")
    S.write_folds(folds, tmpdir_path + "/out")
    assert sorted(map(tuple, S.read_folds(spark, tmpdir_path + "/out").collect())) == sorted(map(tuple, folds.collect()))


def test_qrels_and_run_files(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "q.txt"), "w") as f:
        f.write("301 0 d1 2\n301 0 d2 0\nbroken line\n\n")
    q = S.read_qrels(spark, os.path.join(tmpdir_path, "q.txt")).collect()
    assert [(r.qid, r.docid, r.rel) for r in q if r.parse_error is None] == [("301", "d1", 2), ("301", "d2", 0)]
    assert sum(r.parse_error is not None for r in q) == 1
    with open(os.path.join(tmpdir_path, "r.txt"), "w") as f:
        f.write("301 Q0 d1 1 12.5 bm25_k1=0.90_b=0.40\n301 Q0 d2 2 3.25 bm25_k1=0.90_b=0.40\n")
    r = S.read_run(spark, os.path.join(tmpdir_path, "r.txt"), expect={"k1": 0.9, "b": 0.4}).collect()
    assert [(x.qid, x.docid, x.rank, x.score, x.params_ok) for x in r] == [
        ("301", "d1", 1, 12.5, True), ("301", "d2", 2, 3.25, True)]
    bad = S.read_run(spark, os.path.join(tmpdir_path, "r.txt"), expect={"k1": 1.2}).first()
    assert bad.params_ok is False


def test_topics_file(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "t.txt")
    with open(p, "w") as f:
        f.write("<top>\n<num> Number: 301\n<title> foreign minorities\n<desc> Description:\nWhich groups\n"
                "are minorities?\n<narr> Narrative:\nAnything.\n</top>\n")
    got = {r.query_type: r.query for r in S.read_topics(spark, p).collect()}
    assert got == {"title": "foreign minorities", "desc": "Which groups are minorities?"}


def test_trecweb_record_start_and_later_header_ends(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "x.txt"), "w") as f:
        f.write("noise <DOC> not a start\n<DOC>\n<DOCNO>A-1-1</DOCNO>\n<DOCHDR>\nh\n</DOCHDR>\n"
                "keep this </DOCHDR> and that\n</DOC>\nmore <DOC> noise only\n</DOC>\n")
    rows = S.read_trecweb(spark, tmpdir_path).collect()
    assert [(r.docid, r.html, r.parse_error) for r in rows] == [("A-1-1", "keep this  and that", None)]


def test_trecweb_reader_starts_no_job_and_keeps_order(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "x.txt"), "w") as f:
        for i in range(500):
            f.write(f"<DOC>\n<DOCNO>A-1-{i % 100}</DOCNO>\n<DOCHDR>\n</DOCHDR>\ncopy {i}\n</DOC>\n")
    sc = spark.sparkContext
    sc.setJobGroup("reader", "reader")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = S.read_trecweb(spark, tmpdir_path)
        assert len(sc.statusTracker().getJobIdsForGroup("reader")) == 0
        got = {r.docid: r.html for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == {f"A-1-{k}": f"copy {400 + k}" for k in range(100)}
