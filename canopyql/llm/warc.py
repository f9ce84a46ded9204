"""WARC archives as a chunked record table.

An archive is written as rows (archive, record, chunk, data, digest): the data of a record's chunks, in
order, are the bytes of its WARC/1.1 record, chunk 0 its headers. A payload longer than ``CHUNK`` takes
as many rows as it needs, and each row carries the digest of the payload so far, so neither writer nor
reader ever holds a whole record's bytes again, and a reader notices a lost or changed chunk at once.
Records with equal payloads are written once: the least page id responds, the others revisit it.

Defined results: a null html is the empty payload, and empty payloads are deduplicated too unless
``least_bytes`` says otherwise; rows that repeat a page id and its payload are alike (both respond or
both revisit); a null page id counts as the least id; an empty table gives an empty result; only
page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyql.llm.flat import flat
from canopyql.session import scratch, stage, table

CHUNK = 256 << 10
DATE = "2020-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BROADCAST_COPIES = 50_000
SALTS = 16
LEAST_ID = -(1 << 62)
TABLE = "archive int, record string, chunk int, data binary, digest binary"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def headers(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, revisit: bool, record: str) -> bytes:
    """All of a record before its payload, with the HTTP headers that belong to its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{record}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines.append(f"WARC-Profile: {REVISIT}")
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-Id: {refers_to}")
    lines.append(f"Content-Length: {len(http) + (0 if revisit else size)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    archive, ordinal = TaskContext.get().partitionId(), 0
    names = ["archive", "record", "chunk", "data", "digest"]
    rows: list[tuple] = []
    held = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=names)

    for batch in batches:
        data, offsets = flat(batch.column("html"))
        view = memoryview(data)
        info = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "sha1", "refers_to", "revisit")), strict=True)
        for i, (page_id, url, sha1, refers_to, revisit) in enumerate(info):
            record = str(uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id}/{archive}/{ordinal}"))
            ordinal += 1
            begin, end = int(offsets[i]), int(offsets[i + 1])
            head = headers(page_id, url, base64.b32encode(sha1).decode(), end - begin, refers_to, revisit, record)
            so_far = hashlib.sha1()
            rows.append((archive, record, 0, head, so_far.digest()))
            held += len(head)
            if not revisit:
                for n, at in enumerate(range(begin, end, CHUNK), 1):
                    part = view[at : min(at + CHUNK, end)]
                    so_far.update(part)
                    rows.append((archive, record, n, bytes(part), so_far.digest()))
                    held += len(part)
                    if held > 4 << 20:
                        yield out()
                        rows, held = [], 0
            if held > 4 << 20 or len(rows) > 4096:
                yield out()
                rows, held = [], 0
    if rows:
        yield out()


def plan(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, sha1, revisit, refers_to) for each page."""
    html = F.coalesce("html", F.lit(""))
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("sha1"))
    own = F.coalesce("page_id", F.lit(LEAST_ID))
    copies = d.where(F.octet_length("html") >= least_bytes).groupBy("sha1").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("n"))
    copies = stage(copies.where("n > 1").select(F.col("sha1").alias("of"), "first"), "copies")
    if copies.count() <= BROADCAST_COPIES:
        out = d.join(F.broadcast(copies), F.col("sha1") == F.col("of"), "left")
    else:
        many = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = d.withColumn("own", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(many, (F.col("sha1") == F.col("of")) & (F.col("own") == F.col("salt")), "left")
    revisit = F.coalesce(own != F.col("first"), F.lit(False))
    return out.select("page_id", "url", "html", "sha1", revisit.alias("revisit"), F.when(revisit & (F.col("first") != LEAST_ID), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> str:
    """Writes the archives of pages; returns the path of their table."""
    path = path or scratch(pages.sparkSession, "warc")
    planned = plan(pages, least_bytes)
    planned.mapInArrow(_write, TABLE).write.parquet(path)
    return path


def _fields(head: bytes) -> tuple[dict[str, str], dict[str, str]]:
    """The WARC and HTTP header fields before a payload."""
    warc, _, http = head.partition(b"\r\n\r\n")
    read = lambda b: {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in b.split(b"\r\n")[1:]) if _}
    return read(warc), read(http)


class _Record:
    """A record while its chunks pass by."""

    def __init__(self, head: bytes):
        self.warc, self.http = _fields(head)
        self.sha1, self.size = hashlib.sha1(), 0

    def add(self, data: bytes, digest: bytes) -> None:
        self.sha1.update(data)
        self.size += len(data)
        if self.sha1.digest() != digest:
            raise ValueError(f"a chunk of record {self.warc['warc-record-id']} is lost or changed")

    def row(self) -> tuple:
        revisit = self.warc["warc-type"] == "revisit"
        told, size = self.warc["warc-payload-digest"].removeprefix("sha1:"), int(self.http["content-length"])
        if not revisit and (base64.b32encode(self.sha1.digest()).decode(), self.size) != (told, size):
            raise ValueError(f"the payload of record {self.warc['warc-record-id']} is not what its headers say")
        number = lambda k: int(self.warc[k]) if k in self.warc else None
        return number("x-page-id"), self.warc.get("warc-target-uri"), size, told, self.warc["warc-type"], number("x-refers-to-page-id")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    record, name, rows = None, None, []
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [x.split()[0] for x in RECORDS.split(", ")]
    out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    for batch in batches:
        for key, chunk, data, digest in zip(batch.column("record").to_pylist(), batch.column("chunk").to_pylist(), batch.column("data"), batch.column("digest"), strict=True):
            if key != name:
                if record is not None:
                    rows.append(record.row())
                if chunk != 0:
                    raise ValueError(f"record {key} has no headers")
                record, name = _Record(data.as_py()), key
            else:
                record.add(data.as_buffer(), digest.as_py())
        if len(rows) > 4096:
            yield out()
            rows = []
    if record is not None:
        rows.append(record.row())
    if rows:
        yield out()


def read_archives(spark, path: str) -> DataFrame:
    """The records of an archive table, their payloads checked chunk by chunk: see ``RECORDS``."""
    chunks = spark.read.schema(TABLE).parquet(path).select("record", "chunk", "data", "digest")
    return chunks.repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(_read, RECORDS)


def payloads(spark, path: str) -> DataFrame:
    """(record, chunk, data) of all payloads, for readers that take them as streams."""
    return spark.read.schema(TABLE).parquet(path).where("chunk > 0").select("record", "chunk", "data")


def to_file(rows: Iterable[tuple[str, int, bytes]]) -> Iterator[bytes]:
    """The bytes of one .warc file from its (record, chunk, data) rows in order."""
    last = None
    for record, _, data in rows:
        if last is not None and record != last:
            yield b"\r\n\r\n"
        last = record
        yield bytes(data)
    if last is not None:
        yield b"\r\n\r\n"


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(WARC fields, block) of each record of a .warc file."""
    while True:
        head = bytearray()
        while not head.endswith(b"\r\n\r\n"):
            line = stream.readline()
            if not line:
                return
            if head or line.strip():
                head += line
        fields, _ = _fields(bytes(head))
        yield fields, stream.read(int(fields["content-length"]))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    path = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of a SHA-1 in SQL: four groups of ten hexadecimal digits, eight letters each.
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {at}, 10))::BIGINT >> {shift}) & 31)::INT + 1, 1)"
OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       {" || ".join(_LETTER.format(at=at, shift=shift) for at in (1, 11, 21, 31) for shift in range(35, -1, -5))} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (h)
"""
