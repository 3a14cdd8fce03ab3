"""WARC round trip: payloads that look like records, oversized ones, revisits."""
import hashlib
import re
import uuid

from pyspark.sql import functions as F

from vigil.llm import warc

V = "WARC/1.1\r\n"
BIG = "x" * 70_000
PAGES = [(1, "u", None), (2, None, ""), (3, "a\r\nb c", BIG), (5, "u", BIG), (4, "u", BIG), (6, "u", V),
         (7, "u", "\r\n\r\n" + V + V + "q\r\n\r\n" + V), (8, "u", "é" * 40_000 + "\r\n\r\n"), (None, "u", "null id " * 30),
         (None, "u", "null id " * 30), (9, "u", "null id " * 30), (10, "u", "x" * 99), (11, "u", "x" * 99), (12, "u", "x" * 100),
         (13, "u", "x" * 100), (14, "u", "\r\n" * 5), (14, "u", "\r\n" * 5), (15, "", ("ab\r\n\r\n" + V) * 900), (16, "u", BIG * 30)]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload_bytes", F.lit("x"))


def test_round_trip(spark, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    warc.write_archive(pages(spark).repartition(3), path)
    rows = warc.read_archive(spark, path).collect()
    sha = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in rows), key=str) == \
        sorted(((i, len((h or "").encode()), sha(h)) for i, _, h in PAGES), key=str)
    assert all(r.digest_ok for r in rows) and key
    assert {r.page_id: r.refers_to for r in rows if r.record_type == "revisit"} == {4: 3, 5: 3, 13: 12}
    assert {r.n_chunks for r in rows if r.page_id == 16} == {-(-len(BIG) * 30 // warc.CHUNK)}


def test_records_are_valid_warc(spark, tmp_path):
    path = f"{tmp_path}/one"
    warc.write_archive(pages(spark).coalesce(1), path)
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "one").glob("part-*")))
    at, ids, kinds = 0, [], []
    while at < len(data):                       # a plain reader: version line, headers, Content-Length, two line ends
        assert data.startswith(V.encode(), at)
        head_end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:head_end].decode().split("\r\n")[1:])
        at = head_end + 4 + int(head["Content-Length"])
        assert data[at:at + 4] == b"\r\n\r\n"
        at += 4
        ids.append(head["WARC-Record-ID"])
        kinds.append(head["WARC-Type"])
        assert re.fullmatch(r"[!-~]*", head.get("WARC-Target-URI", ""))
    assert kinds.count("revisit") == 3 and kinds.count("response") == len(PAGES) - 3


def test_empty_table(spark, tmp_path):
    path = f"{tmp_path}/none"
    warc.write_archive(pages(spark).limit(0), path)
    assert warc.read_archive(spark, path).count() == 0


def test_query_matches_sql(spark):
    import duckdb
    sf = "/root/testdata/sf0.01"
    from vigil.llm.queries import ORACLE
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(ORACLE["op7_warc_chunked_records"]).fetchall()
    cols = [d[0] for d in con.description]
    got = warc.op7_query(spark, sf).select(*cols).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
