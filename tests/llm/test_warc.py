"""WARC: exact round trips, revisits, and records skipped unread."""

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import functions as F

from siltweb.llm import warc as W


class Counted:
    def __init__(self, data):
        self.file, self.read_bytes = pa.BufferReader(data), 0

    def size(self):
        return self.file.size()

    def seek(self, n):
        self.file.seek(n)

    def read(self, n):
        got = self.file.read(n)
        self.read_bytes += len(got)
        return got


def archive_of(n, size):
    return b"".join(W.member(W.record("response" if k % 10 else "revisit", f"<urn:page:{k}>", f"http://h/{k}", "d", "00" * 20, size, hashlib.sha256(str(k).encode()).hexdigest().encode() * (size // 64), None)) for k in range(n))


def test_unwanted_records_are_skipped():
    data = archive_of(60, 640_000)
    every = list(W.records(Counted(data), lambda h: True, True))
    assert len(every) == 60 and every[1][1] == hashlib.sha256(b"1").hexdigest().encode() * 10_000
    some = Counted(data)
    got = list(W.records(some, lambda h: h["warc-record-id"] == "<urn:page:41>", True))
    assert [h["warc-target-uri"] for h, _ in got] == ["http://h/41"] and got[0][1] == every[41][1]
    assert [h for h, _ in W.records(Counted(data), lambda h: True, False)] == [h for h, _ in every]


def test_other_writers_files():
    plain = b"".join(W.record("response", f"<urn:page:{k}>", None, "d", "00" * 20, 3, b"abc", None) for k in range(5))
    assert [p for _, p in W.records(Counted(plain), lambda h: True, True)] == [b"abc"] * 5
    packed = b"".join(gzip.compress(W.record("response", f"<urn:page:{k}>", None, "d", "00" * 20, 3, b"abc" * 50_000, None)) for k in range(5))
    assert [h["warc-record-id"] for h, _ in W.records(Counted(packed), lambda h: h["warc-record-id"] > "<urn:page:2>", True)] == ["<urn:page:3>", "<urn:page:4>"]
    assert gzip.GzipFile(fileobj=io.BytesIO(archive_of(3, 64))).read().count(b"WARC/1.1") == 3


def test_round_trip_with_odd_rows(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/1", big, 9), (2, "http://a/2\n", big, 9), (3, None, big, 9), (4, "u", None, 9), (5, "u", "", 9), (6, "u", "short", 9), (7, "u", "short", 9), (None, "u", big, 9), (8, "http://b/ü", "x" * 3_000_000, 9), (3, None, big, 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    path = f"file://{tmp_path}/w"
    W.archive(pages, path)
    read = spark.read.format("warc").load(path)
    got = sorted(((r["record_id"], r["record_type"], r["refers_to"]) for r in read.collect()), key=str)
    assert got == sorted(
        [("<urn:page:1>", "revisit", "<urn:page:3>"), ("<urn:page:2>", "revisit", "<urn:page:3>"), ("<urn:page:>", "revisit", "<urn:page:3>")]
        + [(f"<urn:page:{k}>", "response", None) for k in (3, 3, 4, 5, 6, 7, 8)],
        key=str,
    )
    assert {r["payload"].decode() for r in read.where("record_id = '<urn:page:3>'").collect()} == {big}
    eight = read.where(F.col("target_uri").startswith("http://b/") & (F.col("record_type") == "response"))
    assert [len(r["payload"]) for r in eight.collect()] == [3_000_000]
    heads = spark.read.format("warc").schema("record_id string, payload_bytes long").load(path)
    assert {tuple(r) for r in heads.where("record_id in ('<urn:page:1>', '<urn:page:4>')").collect()} == {("<urn:page:1>", 1200), ("<urn:page:4>", 0)}
    empty = f"file://{tmp_path}/e"
    W.archive(pages.limit(0), empty)
    assert spark.read.format("warc").load(empty).count() == 0
