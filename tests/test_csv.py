import pytest

from dqspark.sources.csv import read_csv
from dqspark.sources.sinks import checksums


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin-1", "utf-16"])
def test_encodings(spark, tmp_path, encoding):
    p = tmp_path / f"enc_{encoding}.csv"
    p.write_bytes("name,n\ncafé,1\nthé,2\n".encode(encoding))
    df = read_csv(spark, str(p))
    assert df.columns == ["name", "n"]
    assert sorted(r.name for r in df.collect()) == ["café", "thé"]


def test_na_words_and_types(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('a,b,c,d,e,f,g\n"",5d,t,2020-01-01,1.5,True,\nNA,6d,f,2020-01-02,inf,False,\n'
                 'N/A,7,t,2020-01-03,-inf,True,\nnull,8,f,2020-01-04,NaN,False,\nx,9,t,2020-01-05,2,True,\n')
    df = read_csv(spark, str(p))
    types = dict(df.dtypes)
    assert types == {"a": "string", "b": "string", "c": "string", "d": "string", "e": "double",
                     "f": "boolean", "g": "double"}
    rows = df.collect()
    assert [r.a for r in rows] == [None, None, None, None, "x"]
    assert [r.e for r in rows][:4] == [1.5, float("inf"), float("-inf"), None]
    assert all(r.g is None for r in rows)


def test_header_only_and_guard(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text("a,b\n")
    assert read_csv(spark, str(p)).count() == 0
    q = tmp_path / "x.txt"
    q.write_text("a\n1\n")
    with pytest.raises(ValueError):
        read_csv(spark, str(q))


def test_quoted_line_breaks(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('id,txt\n1,"line one\nline two"\n2,plain\n')
    df = read_csv(spark, str(p))
    assert df.count() == 2 and df.first().txt == "line one\nline two"


def test_checksum(spark, tmp_path):
    import hashlib
    p = tmp_path / "c.csv"
    p.write_bytes(b"a,b\n1,2\n")
    r = checksums(spark, str(p)).first()
    assert r.checksum == hashlib.sha256(b"a,b\n1,2\n").hexdigest()[:12] and r.length == 8


def test_encoding_detection_over_split_files(spark, tmp_path):
    # files cut into many blocks: a Latin-1 byte far from the start, a UTF-16 file
    # whose later blocks carry no mark, and plain UTF-8, all in one folder
    from dqspark.sources.csv import detect_encodings
    body = "name,n\n" + "".join(f"row{i},{i}\n" for i in range(400))
    (tmp_path / "a_utf8.csv").write_bytes((body + "café,1\n").encode("utf-8"))
    (tmp_path / "b_latin.csv").write_bytes((body + "café,1\n").encode("latin-1"))
    (tmp_path / "c_utf16.csv").write_bytes((body + "café,1\n").encode("utf-16"))
    (tmp_path / "d_empty.csv").write_bytes(b"")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        enc = {k.rsplit("/", 1)[-1]: v for k, v in detect_encodings(spark, str(tmp_path)).items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert enc.pop("d_empty.csv", "UTF-8") == "UTF-8"      # zero-length files may not be listed
    assert enc == {"a_utf8.csv": "UTF-8", "b_latin.csv": "ISO-8859-1", "c_utf16.csv": "UTF-16"}


def test_blank_in_the_path_keeps_the_encoding(spark, tmp_path):
    (tmp_path / "a b.csv").write_bytes("name\ncafé\n".encode("latin-1"))
    assert [r.name for r in read_csv(spark, str(tmp_path)).collect()] == ["café"]


def test_differing_headers_are_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    (tmp_path / "y.csv").write_text("b,a\n20,10\n")
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(tmp_path)).collect()


def test_long_rows_are_an_error_and_short_ones_are_filled(spark, tmp_path):
    p = tmp_path / "long.csv"
    p.write_text("a,b\n3,4,5\n")
    with pytest.raises(Exception, match="more fields"):
        read_csv(spark, str(p)).collect()
    q = tmp_path / "short.csv"
    q.write_text("a,b\n3\n4,5\n")
    assert [(r.a, r.b) for r in read_csv(spark, str(q)).orderBy("a").collect()] == [(3, None), (4, 5)]


def test_truth_words_leading_blanks_and_repeated_headers(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("f,n,n\nTrue, 5,1\n,\u0020 6,2\nFalse, 7,3\n")
    df = read_csv(spark, str(p))
    assert df.dtypes == [("f", "string"), ("n", "bigint"), ("n.1", "bigint")]
    assert sorted(r[1] for r in df.collect()) == [5, 6, 7]


@pytest.mark.parametrize("multiline", [True, False])
@pytest.mark.parametrize("row", ["1,,3", "1,2,", "1,,\"3\"", "1,2,3,4", "\"a,b\",,x"])
def test_every_long_row_is_an_error(spark, tmp_path, row, multiline):
    p = tmp_path / "long.csv"
    p.write_text(f"a,b\n1,2\n{row}\n3\n")
    with pytest.raises(Exception, match="more fields"):
        read_csv(spark, str(p), multiline=multiline).collect()


@pytest.mark.parametrize("multiline", [True, False])
def test_rows_that_fit_are_no_error(spark, tmp_path, multiline):
    p = tmp_path / "fits.csv"
    p.write_text('a,b\n1,\n,\n3\n"4,5",\n"",6\n')
    rows = read_csv(spark, str(p), multiline=multiline).collect()
    assert len(rows) == 5 and {r.a for r in rows} == {"1", None, "3", "4,5"}


def test_checksum_of_large_files_holds_no_file_whole(spark, tmp_path, monkeypatch):
    import hashlib
    import random

    from dqspark.sources import sinks
    monkeypatch.setattr(sinks, "WHOLE_BYTES", 100)
    noise = random.Random(3).randbytes(300_000)
    bodies = {"noise.parquet": noise, "a b%é.csv": b"\xef\xbb\xbf" + b"x,y\r\n" * 50, "mark.csv": b"\xef\xbb\xbf" + b"1,2\n" * 50 + b"3",
              "feeds.csv": b"\n" * 500, "open.csv": b"q" * 101, "zeros.bin": bytes(5000), "bad.txt": b"\xff\xfe\n\xc3(\n\xed\xa0\x80" * 30,
              "stored.gz": noise[:5000], "stored.bz2": noise[5000:9000] + b"\n", "small.csv": b"1\n", "nosuffix": noise[:700],
              ".hid": noise[:10], "edge.csv": b"z" * 100}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")         # a split would break the chain
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")   # as 2 GB is: a file in one row may not be longer
    try:
        rows = {r.path.split("/")[-1]: r for r in sinks.checksums(spark, str(tmp_path)).collect()}
        whole = {r.path for r in spark.read.format("binaryFile").load(str(tmp_path)).select("path").collect()}
        plan = sinks.checksums(spark, str(tmp_path), "noise.*")._jdf.queryExecution().executedPlan().toString()
        assert {r.path.split("/")[-1] for r in sinks.checksums(spark, str(tmp_path), "*.csv").collect()} == {
            n for n in bodies if n.endswith(".csv")}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert {r.path for r in rows.values()} == whole
    assert {n: (r.length, r.checksum) for n, r in rows.items()} == {
        n: (len(b), hashlib.sha256(b).hexdigest()[:12]) for n, b in bodies.items() if n != ".hid"}
    assert "FileScan text" in plan
