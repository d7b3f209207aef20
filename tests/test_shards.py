"""Documents by id from a sharded corpus: only the asked shards are opened."""

import gzip
import os

from rankfold.sources import files as S


def corpus(spark, root, n=120):
    rows = [(f"GX{i // 40:03d}-{i // 10 % 4:02d}-{i:07d}", "http://x", f"text of {i}") for i in range(n)]
    S.write_shards(spark.createDataFrame(rows, "docid string, url string, html string"), root)
    return rows


def names(paths):
    return sorted("/".join(p.split("/")[-2:]) for p in paths)


def test_shards_are_written_under_their_names(spark, tmpdir_path):
    rows = corpus(spark, tmpdir_path)
    found = sorted(os.path.relpath(os.path.join(d, f), tmpdir_path) for d, _, fs in os.walk(tmpdir_path) for f in fs if f.endswith(".gz"))
    assert found == sorted({f"{r[0][:5]}/{r[0][6:8]}.gz" for r in rows})
    got = S.read_trecweb(spark, tmpdir_path).collect()
    assert sorted((r.docid, r.html, r.parse_error) for r in got) == sorted((r[0], r[2], None) for r in rows)
    with gzip.open(os.path.join(tmpdir_path, "GX001", "02.gz"), "rt") as f:
        ids = [line for line in f if line.startswith("<DOCNO>")]
    assert ids == sorted(ids) and len(ids) == 10


def test_fetch_opens_only_the_asked_shards(spark, tmpdir_path):
    corpus(spark, tmpdir_path)
    # any attempt to read another shard fails: it is no gzip file
    asked = ["GX000-01-0000012", "GX000-01-0000019", "GX002-03-0000111"]
    for d, _, fs in os.walk(tmpdir_path):
        for f in fs:
            if f.endswith(".gz") and f"{os.path.basename(d)}/{f}" not in ("GX000/01.gz", "GX002/03.gz"):
                open(os.path.join(d, f), "wb").write(b"\x1f\x8bbroken")
                crc = os.path.join(d, f".{f}.crc")
                if os.path.exists(crc):
                    os.remove(crc)
    ids = spark.createDataFrame([(a,) for a in asked] * 2, "docid string")
    got = S.fetch_from_shards(spark, tmpdir_path, ids, len(asked))
    assert names(got.inputFiles()) == ["GX000/01.gz", "GX002/03.gz"]
    assert sorted((r.docid, r.html) for r in got.collect()) == [(a, f"text of {int(a[9:])}") for a in asked]


def test_missing_shards_ids_and_odd_names(spark, tmpdir_path):
    corpus(spark, tmpdir_path, 20)
    odd = ["GX000-00-9999999", "GX777-00-0000001", "GX000-99-0000001", "../GX000-00-1", "GX0{0,1}-00-1", "noparts", "", "a-b", None,
           "GX000-00-0000003"]
    ids = spark.createDataFrame([(a,) for a in odd], "docid string")
    got = S.fetch_from_shards(spark, tmpdir_path, ids)
    assert names(got.inputFiles()) == ["GX000/00.gz"]
    assert [r.docid for r in got.collect()] == ["GX000-00-0000003"]
    assert S.fetch_from_shards(spark, tmpdir_path, ids.filter("docid = 'GX777-00-0000001'")).count() == 0
    assert S.fetch_from_shards(spark, tmpdir_path, ids.limit(0)).count() == 0


def test_too_many_shards_scan_the_corpus(spark, tmpdir_path):
    rows = corpus(spark, tmpdir_path)
    ids = spark.createDataFrame([(r[0],) for r in rows[::7]], "docid string")
    assert S.asked_shards(ids, 3) is None
    got = S.fetch_from_shards(spark, tmpdir_path, ids, max_shards=3)
    assert len(got.inputFiles()) == 12 and sorted(r.docid for r in got.collect()) == [r[0] for r in rows[::7]]


def test_a_repeated_record_counts_by_its_last(spark, tmpdir_path):
    os.makedirs(os.path.join(tmpdir_path, "GX000"))
    with gzip.open(os.path.join(tmpdir_path, "GX000", "00.gz"), "wt") as f:
        for text in ("first", "second"):
            f.write(f"<DOC>\n<DOCNO>GX000-00-1</DOCNO>\n<DOCHDR>\n</DOCHDR>\n{text}\n</DOC>\n")
    got = S.fetch_from_shards(spark, tmpdir_path, spark.createDataFrame([("GX000-00-1",)], "docid string"))
    assert [r.html for r in got.collect()] == ["second"]
