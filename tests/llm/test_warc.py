import base64
import gzip
import hashlib

import duckdb
import pytest
from fixtures import TESTDATA, same
from pyspark.sql import functions as F

from vacantia.llm import warc
from vacantia.llm.common import shared_path

SCHEMA = "page_id long, url string, html string, record string, payload int"


def brute(rows, least=0):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= least and first.get(html or "", i) != i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if revisit else "response", first[html or ""] if revisit else None))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


ROWS = [
    (5, "http://a/", "same"),
    (3, None, "same"),
    (9, "http://b/\r\nX: y", "same"),
    (1, "http://c/", None),
    (2, "http://d/", ""),
    (4, "http://ü/", "\r\n\r\nWARC/1.1\r\n\r\n" * 3000),
    (6, "http://e/", "日本語 🎉 " * 20_000),
    (7, "http://f/", "0\r\n\r\n"),
    (8, "http://g/", "x" * 4096),
    (8, "http://g/", "x" * 4096),
    (None, None, "same"),
    (None, None, "alone"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    got = warc.archived(table(spark, ROWS), shared_path(spark, "warc"), least).collect()
    same(got, brute(ROWS, least))


def test_empty_table(spark):
    assert warc.archived(table(spark, []), shared_path(spark, "warc")).count() == 0


def test_segments_are_checked(spark):
    rows = warc.records(warc.with_revisits(table(spark, ROWS)), segment=1000)
    path = shared_path(spark, "warc")
    warc.write_warc(rows, path)
    recs = warc.read_records(spark, path).persist()
    assert recs.where("record_type = 'continuation'").count() > 100
    pages = lambda r: {x.page_id for x in warc.with_payloads(warc.reassembled(r)).collect()}
    assert 4 in pages(recs)
    assert 4 not in pages(recs.where("NOT (number = 3 AND octet_length(block) = 1000)"))  # a gap
    torn = recs.withColumn("block", F.when(F.col("number") == 2, F.expr("substring(block, 1, 999)")).otherwise(F.col("block")))
    assert 4 not in pages(torn)  # another length
    whole = warc.with_payloads(warc.reassembled(recs.orderBy(F.rand(1)))).where("page_id = 6").first()
    assert bytes(whole.payload).decode() == ROWS[6][2]


def test_framing():
    for payload in (b"", b"a", b"\r\n" * 5000, bytes(range(256)) * 40):
        assert warc.dechunked(warc.chunked(payload, 1000)) == payload
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")


ONE = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"


def test_archives_in_parts():
    archive = ONE + ONE.replace(b"abcd", b"\r\n\r\n") + ONE.replace(b"abcd", b"a\r\nb") + ONE.replace(b"abcd", b"ab\r\n")
    for size in (1, 3, 7, 1000):
        parts = [archive[i : i + size] for i in range(0, len(archive), size)]
        assert [b for _, b, _ in warc.parsed(parts)] == [b"abcd", b"\r\n\r\n", b"a\r\nb", b"ab\r\n"]
    assert [(b, f) for _, b, f in warc.parsed([ONE[:-6]])] == [(b"", "the archive ends inside a record")]


def test_broken_records_are_left_out():
    """What follows a broken record is read, in parts of any size."""
    headless = b"some words\r\n\r\nmore of them\r\n\r\n"
    unknown = ONE.replace(b"Content-Length: 4", b"Content-Length: four")
    archive = headless + ONE + unknown + ONE + ONE.replace(b"Content-Length: 4", b"Content-Length: 4000") + ONE
    for size in (1, 5, 64, 10_000):
        got = [(b, f) for _, b, f in warc.parsed(archive[i : i + size] for i in range(0, len(archive), size))]
        good = (b"abcd", None)
        assert got == [(b"", "no version line"), good, (b"", "no length"), good, (b"", "the archive ends inside a record"), good]


def test_rejects(spark, tmp_path):
    """Good records are read whatever stands between them; the others are listed with their faults."""
    chunks = lambda n, body: foreign(n, body).replace(b"HTTP/1.1 200 OK\r\n\r\n", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n").replace(b"Content-Length: %d" % (19 + len(body)), b"Content-Length: %d" % (47 + len(body)))
    broken = [chunks(1, b"zz\r\n"), foreign(2, b"x").replace(b"WARC-Record-ID: <u:2>\r\n", b""), foreign(3, b"x").replace(b"X-Page-ID: 3", b"X-Page-ID: three"), foreign(4, b"x").replace(b"WARC-Type: response\r\n", b""), foreign(5, b"x" * 50)[:-20]]
    archive = b"".join(foreign(10 + i, b"page %d" % i) + b for i, b in enumerate(broken))
    (tmp_path / "a.warc").write_bytes(archive)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(archive.replace(b"<u:", b"<v:")))
    recs = warc.read_records(spark, str(tmp_path)).persist()
    faults = {(r.record_id, r.fault) for r in warc.rejects(recs).collect()}
    each = [("<u:1>", "broken chunks"), (None, "no record id"), ("<u:3>", "a number that is none"), ("<u:4>", "no type"), ("<u:5>", "the archive ends inside a record")]
    assert faults == {(i and i.replace("u", k), f) for i, f in each for k in "uv"}
    assert sorted(r.page_id for r in warc.read_pages(spark, str(tmp_path)).collect()) == sorted([10, 11, 12, 13, 14] * 2)


def test_large_plain_archives_are_split(spark, tmp_path):
    """Parts of one file come back in order; records with separators in them stay whole."""
    bodies = [b"line %d\r\n\r\n" % i * (i % 40) for i in range(400)]
    (tmp_path / "plain.warc").write_bytes(b"".join(foreign(i, b) for i, b in enumerate(bodies)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        recs = warc.read_records(spark, str(tmp_path))
        got = {r.page_id: bytes(r.payload) for r in warc.with_payloads(warc.reassembled(recs)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(enumerate(bodies))


def foreign(number, body):
    head = b"HTTP/1.1 200 OK\r\n\r\n" + body
    digest = base64.b32encode(hashlib.sha1(body).digest())
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <u:%d>\r\nX-Page-ID: %d\r\nWARC-Payload-Digest: sha1:%b\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (number, number, digest, len(head), head)


def test_foreign_archives(spark, tmp_path):
    """Gzip members of one record each, binary payloads with separators in them, plain files, and several files a task."""
    bodies = [bytes(range(256)) * 20, b"\r\n\r\n\r\n", b"", b"\r\n", b"x" * 100_000, b"\xff\r\n\r\n\r\n\r\n\xfe", b"\r\r\n\r\n\n"]
    for k in range(4):
        members = [gzip.compress(ONE)] + [gzip.compress(foreign(10 * k + i, b)) for i, b in enumerate(bodies)]
        (tmp_path / f"part-{k}.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "plain.warc").write_bytes(ONE + b"".join(foreign(90 + i, b) for i, b in enumerate(bodies)))
    got = {r.page_id: bytes(r.payload) for r in warc.with_payloads(warc.reassembled(warc.read_records(spark, str(tmp_path)))).collect()}
    assert got == {10 * k + i: b for k in (0, 1, 2, 3, 9) for i, b in enumerate(bodies)}
    assert warc.read_pages(spark, str(tmp_path)).count() == 35


def test_a_blank_page_everywhere(spark):
    rows = [(i, f"http://p/{i}", "" if i % 3 == 0 else f"page {i % 500}") for i in range(3000)]
    same(warc.archived(table(spark, rows), shared_path(spark, "warc")).collect(), brute(rows))


def test_oracle_sql_agrees(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{TESTDATA}/pages.parquet')")
    query = warc.op7_warc(spark, TESTDATA)
    same(query.collect(), con.execute(f"SELECT {', '.join(query.columns)} FROM ({warc.OP7_SQL})").fetchall())
