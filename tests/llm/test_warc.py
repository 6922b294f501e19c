import gzip
import hashlib

import duckdb

from tesserae.llm import warc


def rows():
    big, wide = "p" * 150, "é" * 60
    return [(3, "http://a/", big, 1), (1, "http://b/x\r\ny", big, 1), (2, None, wide, 1), (9, "", wide, 1), (5, "http://c", "short", 1), (6, "http://c", "short", 1), (7, "u", None, 1), (8, "u", "", 1), (4, "u", "WARC/1.1\r\n\r\n" * 40, 1), (10, "z", "x" * 9_000_000, 1), (3, "http://a/", big, 1)]


def test_query(spark):
    p = spark.createDataFrame(rows(), "page_id long, url string, html string, digest int").repartition(3)
    got = sorted((tuple(r) for r in warc.op4_warc(spark, "", p).collect()), key=str)
    con = duckdb.connect()
    pages = p.select("page_id", "url", "html").toPandas()  # noqa: F841
    con.register("pages", pages)
    want = sorted((tuple(r) for r in con.sql(warc.ORACLES["op4_warc"]).fetchall()), key=str)
    assert got == want and len(got) == len(rows())
    assert warc.op4_warc(spark, "", p.limit(0)).count() == 0


def test_null_id(spark):
    p = spark.createDataFrame([(None, "u", "q" * 200), (2, "u", "q" * 200)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.op4_warc(spark, "", p).collect()}
    assert got[None].record_type == "revisit" and got[None].refers_to == 2 and got[2].record_type == "response"


def test_plain_and_chained_records(spark):
    a, b, c = warc.capture_records(1, "http://a", b"hello", hashlib.sha256(b"hello").hexdigest(), None)
    request_id = warc.capture_id(1, hashlib.sha256(b"hello").hexdigest(), "request")
    chained = warc._record("metadata", "<m2>", "http://a", "application/warc-fields", b"k: v", f"WARC-Concurrent-To: {request_id}\r\n")
    lonely = warc._record("request", "<r9>", "http://z", "application/http", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <gone:response>\r\n")
    frame = spark.createDataFrame([("x", bytearray(a + b + chained)), ("y", bytearray(gzip.compress(lonely) + gzip.compress(b"WARC/1.1\r\nbroken"))), ("z", None)], "path string, content binary")
    got = {r.capture_id: r for r in warc.assemble(warc.read_records(frame)).collect()}
    one = got[warc.capture_id(1, hashlib.sha256(b"hello").hexdigest(), "response")]
    assert one.response.payload == b"hello" and one.metadata.fields == {"k": "v"} and one.request.record_id == request_id
    assert got["<gone:response>"].response is None


def test_revisits_resolve(spark):
    p = spark.createDataFrame([(i, "u", "w" * 120) for i in range(5)], "page_id long, url string, html string")
    captures = warc.assemble(warc.read_records(warc.write_archives(warc.plan_captures(p))))
    got = warc.resolve_revisits(captures).collect()
    assert len(got) == 5 and {bytes(r.full_payload) for r in got} == {b"w" * 120}


def test_files(spark, tmp_path):
    """Real .warc.gz files: written by tasks, read with Spark's reader of binary files, and member by member with gzip alone."""
    p = spark.createDataFrame([(i, f"http://host{i}/a/b?q={i}" if i else "http://[broken", "w" * 40 * i) for i in range(8)], "page_id long, url string, html string").repartition(2)
    saved = warc.save_archives(warc.write_archives(warc.plan_captures(p)), f"file://{tmp_path}/out").collect()
    files = sorted((tmp_path / "out").iterdir())
    assert sorted(r.path for r in saved) == [f"file://{f}" for f in files] and all(f.name.endswith(".warc.gz") for f in files)
    for f, r in zip(files, sorted(saved)):
        whole = gzip.decompress(f.read_bytes())
        assert f.stat().st_size == r.n_bytes and whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and f"WARC-Filename: {f.name}\r\n".encode() in whole
    records = warc.read_records(spark.read.format("binaryFile").load(f"file://{tmp_path}/out"))
    assert {r.type: r["count"] for r in records.groupBy("type").count().collect()} == {"warcinfo": len(files), "request": 8, "response": 8, "metadata": 8}
    got = {int(c.metadata.fields["page-id"]): c for c in warc.assemble(records).collect()}
    assert all(bytes(c.response.payload) == b"w" * 40 * i for i, c in got.items()) and len(got) == 8
    assert got[3].request.http.startswith("GET /a/b?q=3 HTTP/1.1\r\nHost: host3") and got[0].request.http.startswith("GET / HTTP/1.1")
