"""WARC files as a Spark data source: planned by file, filtered on headers, payloads decoded only where they are asked for."""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import fresh_path, table

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, headers map<string,string>, payload binary"
#: Header of each column that predicates are pushed to; these are compared before anything else of a record is read.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to"}
MANIFEST = "_manifest.json"
_CHUNK = 1 << 16
_MOST_HEAD = 1 << 20


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


# ---- one record ----


def member(block: bytes) -> bytes:
    """A gzip member whose extra field `sl` holds its own and its content's length, so that a reader can skip it unread."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(block) + packer.flush()
    total = 12 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(block))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def _line(value: str) -> str:
    return "".join(c if c >= " " else "%%%02X" % ord(c) for c in value)


def record(kind: str, record_id: str, uri: str | None, date: str, digest: str, size: int, payload: bytes, refers_to: str | None) -> bytes:
    """A response or a revisit. A revisit keeps the HTTP head and refers to the record that holds its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("X-Payload-Length", str(size)),
        ("WARC-Refers-To", refers_to),
        # Fixed value: the profile that the WARC 1.1 standard names for equal payloads.
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in head if v is not None) + "\r\n"
    return text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out.setdefault(last, value.strip())
    return out


def hex_digest(value: str | None) -> str | None:
    """Lower-case hex of a SHA-1 header, given in base 32 or hex; null for other algorithms."""
    algorithm, _, text = (value or "").partition(":")
    if algorithm.lower() != "sha1":
        return None
    try:
        return base64.b32decode(text.upper()).hex() if len(text) == 32 else bytes.fromhex(text).hex()
    except ValueError:
        return None


# ---- reading ----


class _Source:
    """Bytes of a file in order, with skips."""

    def __init__(self, file):
        self.file, self.size, self.at, self.buffer = file, file.size(), 0, b""

    def need(self, n: int) -> bytes:
        if len(self.buffer) < n:
            self.buffer += self.file.read(max(n - len(self.buffer), _CHUNK))
        return self.buffer[:n]

    def drop(self, n: int) -> None:
        self.at += n
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.buffer = b""
            self.file.seek(self.at)

    def done(self) -> bool:
        return not self.need(1)


class _Inflated:
    """The content of one gzip member, unpacked only as far as it is read."""

    def __init__(self, source: _Source):
        self.source, self.begin = source, source.at
        head = source.need(24)
        self.total = struct.unpack("<I", head[16:20])[0] if len(head) == 24 and head[3] == 4 and head[10:14] == b"\x0c\0sl" else None
        self.unpack, self.out = zlib.decompressobj(31), b""

    def need(self, n: int) -> bytes:
        while len(self.out) < n and not self.unpack.eof:
            data = self.unpack.unconsumed_tail
            if not data:
                data = self.source.need(_CHUNK)
                self.source.drop(len(data))
                if not data:
                    raise ValueError(f"gzip member at byte {self.begin} is cut off")
            self.out += self.unpack.decompress(data, max(n - len(self.out), 1 << 12))
        return self.out[:n]

    def drop(self, n: int) -> None:
        while n:
            step = min(n, _CHUNK)
            if not self.need(step):
                return
            got = min(step, len(self.out))
            self.out = self.out[got:]
            n -= got

    def close(self) -> None:
        """Go to the next member: by the length in the header, else by unpacking the rest unread."""
        if self.total is None:
            while not self.unpack.eof:
                self.out = b""
                self.need(1)
            left = len(self.unpack.unused_data)
            self._seek(self.source.at - left)
        else:
            self._seek(self.begin + self.total)

    def _seek(self, to: int) -> None:
        if to != self.source.at:
            self.source.buffer = b""
            self.source.at = to
            self.source.file.seek(to)


def _head_of(stream) -> bytes | None:
    n = 1 << 10
    while True:
        seen = stream.need(n)
        end = seen.find(b"\r\n\r\n")
        if end >= 0:
            stream.drop(end + 4)
            return seen[:end]
        if len(seen) < n or n > _MOST_HEAD:
            if not seen.strip():
                return None
            raise ValueError("a record's header doesn't end")
        n *= 2


def records(file, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers, and payload if asked for, of the records that ``wanted(headers)`` lets pass. The rest is skipped undecoded."""
    source = _Source(file)
    while not source.done():
        if source.need(2) == b"\x1f\x8b":
            stream: _Inflated | _Source = _Inflated(source)
        else:
            while source.need(2) == b"\r\n":
                source.drop(2)
            if source.done():
                return
            stream = source
        head = _head_of(stream)
        if head is None:
            return
        headers = parse_head(head)
        length = int(headers.get("content-length", "0"))
        if not wanted(headers):
            payload, keep = None, False
        else:
            payload, keep = None, True
            if with_payload:
                block = stream.need(length)
                if len(block) < length:
                    raise ValueError("a record's block is cut off")
                if headers.get("content-type", "").startswith("application/http"):
                    block = block.partition(b"\r\n\r\n")[2]
                payload = block
        if isinstance(stream, _Inflated):
            stream.close()
        else:
            stream.drop(length + 4)
        if keep:
            yield headers, payload


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.columns = options["path"], schema.names
        self.target = int(options.get("partitionBytes", 64 << 20))
        self.equal: list[tuple[str, frozenset]] = []
        self.prefixes: list[tuple[str, str]] = []
        self.schema = schema

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, IsNotNull):
                self.equal.append((HEADERS[name], frozenset()))
            elif name in HEADERS and isinstance(f, EqualTo):
                self.equal.append((HEADERS[name], frozenset([f.value])))
            elif name in HEADERS and isinstance(f, In) and f.value:
                self.equal.append((HEADERS[name], frozenset(f.value)))
            elif name in HEADERS and isinstance(f, StringStartsWith):
                self.prefixes.append((HEADERS[name], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _filesystem(self.path)
        if system.get_file_info(root).type == fs.FileType.File:
            return [Files([root])]
        found = {i.path: i.size for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File}
        manifest = f"{root.rstrip('/')}/{MANIFEST}"
        if manifest in found:
            with system.open_input_stream(manifest) as f:
                names = json.loads(f.read())
            found = {p: found[p] for p in (f"{root.rstrip('/')}/{n}" for n in names)}
        else:
            found = {p: s for p, s in found.items() if p.endswith((".warc", ".warc.gz"))}
        out: list[InputPartition] = []
        held, size = [], 0
        for path in sorted(found):
            if held and size + found[path] > self.target:
                out.append(Files(held))
                held, size = [], 0
            held.append(path)
            size += found[path]
        return [*out, Files(held)]

    def _wanted(self, headers: dict[str, str]) -> bool:
        return all(h in headers and (not values or headers[h] in values) for h, values in self.equal) and all(headers.get(h, "").startswith(p) and h in headers for h, p in self.prefixes)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        system, _ = _filesystem(self.path)
        rows: list[tuple] = []
        size = 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for headers, payload in records(file, self._wanted, "payload" in self.columns):
                    rows.append(tuple(self._value(c, headers, payload) for c in self.columns))
                    size += len(payload or b"") + 500
                    if size > 8 << 20:
                        yield self._batch(rows, schema)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows, schema)

    def _batch(self, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(col), f.type) for col, f in zip(zip(*rows), schema)], schema=schema)

    @staticmethod
    def _value(column: str, headers: dict[str, str], payload: bytes | None):
        if column == "payload":
            return payload
        if column == "headers":
            return list(headers.items())
        if column == "payload_digest":
            return hex_digest(headers.get("warc-payload-digest"))
        if column == "payload_bytes":
            return int(headers["x-payload-length"]) if "x-payload-length" in headers else len(payload) if payload is not None else None
        return headers.get(HEADERS[column])


# ---- writing ----


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own names; the manifest that the commit leaves lists those of the tasks that succeeded."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.roll = int(options.get("rollBytes", 64 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        names: list[str] = []
        file, size = None, 0
        task = TaskContext.get().partitionId()
        for batch in iterator:
            for r in batch.to_pylist():
                if file is None or size > self.roll:
                    if file is not None:
                        file.close()
                    names.append(f"part-{task:05d}-{len(names):03d}-{uuid.uuid4().hex}.warc.gz")
                    # The records are packed one by one; the name must not make the file system pack them again.
                    file, size = system.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                data = member(record(r["record_type"], r["record_id"], r["target_uri"], r["date"], r["payload_digest"], r["payload_bytes"], (r["payload"] or "").encode("utf-8", "surrogatepass") if isinstance(r["payload"], str) else r["payload"] or b"", r["refers_to"]))
                file.write(data)
                size += len(data)
        if file is not None:
            file.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _filesystem(self.path)
        for m in messages:
            for name in m.names if m else []:
                system.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; ``df.write.format("warc").mode("append").save(path)``.

    Reading: a file or a folder. Filters on record_type, record_id, target_uri, date and refers_to (equality, in, prefix)
    are answered from headers; a record that they reject is skipped without unpacking its payload, by the length in its
    gzip header. Payloads aren't unpacked either where the schema given to the reader leaves them out.

    Writing: columns record_type (response or revisit), record_id, target_uri, date, payload_digest (hex SHA-1),
    payload_bytes, payload (string or binary, null: empty), refers_to. One folder takes one write.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(pages: DataFrame, path: str, least_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for every row of ``page_id, url, html`` to the WARC files of a new folder.

    Of pages with equal payloads of at least ``least_bytes``, the one with the largest page_id holds it and the others
    revisit it; rows that repeat that page_id all hold it. Null html is an empty payload, a null url leaves the header
    out. A null page_id revisits an equal page that has one, and else is a response. Control characters in urls are
    percent-encoded. An empty table leaves a folder without records; other columns are left out.
    """
    register(pages.sparkSession)
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("string").alias("page"), F.col("page_id").alias("number"), "url", body.alias("payload"), F.sha1(body.cast("binary")).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    large = rows.where(F.col("payload_bytes") >= least_bytes)
    holders = large.groupBy("payload_digest").agg(F.max("number").alias("holder"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(holders, "payload_digest", "left")
    revisits = (F.col("payload_bytes") >= least_bytes) & F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("number"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c, F.lit("")), F.lit(">"))
    out = joined.select(
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        "payload_digest",
        "payload_bytes",
        F.when(~revisits, F.col("payload")).alias("payload"),
        F.when(revisits, urn(F.col("holder").cast("string"))).alias("refers_to"),
    )
    out.write.format("warc").mode("append").save(path)


def page_of(record_id):
    return F.regexp_extract(record_id, "^<urn:page:(-?[0-9]*)>$", 1).try_cast("long")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, then read them back: responses by their payloads, revisits by their headers."""
    path = fresh_path(spark, "warc")
    archive(table(spark, sf_dir, "pages"), path)
    read = spark.read.format("warc").load(path)
    responses = read.where("record_type = 'response'").select(page_of(F.col("record_id")).alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    heads = spark.read.format("warc").schema("record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string").load(path)
    revisits = heads.where("record_type = 'revisit'").select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
    return responses.union(revisits)


ORACLE = """
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, cast(strlen(h) as bigint) payload_bytes, sha1(h) payload_digest from p),
m as (select payload_digest, max(page_id) holder, count(*) n from d where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, d.payload_digest,
  case when holder is null or n = 1 or holder = page_id then 'response' else 'revisit' end record_type,
  case when n > 1 and holder <> page_id then holder end refers_to
from d left join m on m.payload_digest = d.payload_digest
"""
