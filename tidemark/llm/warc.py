"""WARC archives: a deduplicating writer and a splittable reader.

Writing: of records whose payloads are equal and have at least ``min_revisit``
bytes, the one with the largest page id is a response and the others are revisits
of it (identical payload digest); all other records are responses.  A task writes
its records, each a gzip member of its own, into archives that appear under their
final name only when they are whole; the manifest names the archives that count.

Reading: an archive is cut into byte ranges.  A task scans its range for the gzip
magic, takes a candidate for a member only if it decodes to a WARC header, and then
follows the members from end to start.  It owns the records that start inside its
range, also where they end beyond it, so every record is read once whatever the cuts.

Record headers beyond the standard: ``X-Page-ID`` and, for revisits,
``X-Refers-To-Page-ID``.  A revisit's block holds the HTTP headers, whose
Content-Length is that of the full payload.

Defined results: a null page has an empty payload; null ids and urls are left out of
the header and read back as null; a null id is never the largest, and a group without
ids has responses only; rows that repeat the largest id are responses each; damaged
members and wrong digests are errors; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import batches_of, filesystem, publish, shared_folder, split_hot_join, written

MANIFEST = "path string, bytes long, records long"
RECORDS = "record_type string, record_id string, page_id long, target_uri string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_MAGIC = b"\x1f\x8b\x08"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LINE_END = re.compile(rb"\r\n")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}|{digest}'.encode()).digest(), version=4)}>"


def _member(kind: str, headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _page_member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool, date: str, level: int) -> bytes:
    coded = base64.b32encode(bytes.fromhex(digest)).decode()
    headers = [("WARC-Record-ID", record_id(page_id, digest) if not revisit else f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{coded}")]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if revisit:
        headers += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", record_id(refers, digest)), ("X-Refers-To-Page-ID", str(refers))]
        return _member("revisit", headers, http, level)
    return _member("response", headers, http + payload, level)


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 1000, archive_bytes: int = 1 << 30, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write a record per row of ``pages`` and return the manifest: path, bytes and records of each archive."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    body = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), body.alias("body"), F.sha1(body).alias("digest"))
    groups = rows.where(F.length("body") >= min_revisit).groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("response")).where("n > 1 AND response IS NOT NULL")
    groups = written(groups, "warc-groups")
    marked = split_hot_join(rows, groups, ["digest"], "n", how="left")
    marked = marked.select("id", "url", "body", "digest", "response", (F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response"))).alias("revisit"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = (
            _page_member(r["id"], r["url"], r["body"], r["digest"], r["response"], r["revisit"], date, level)
            for batch in batches_of(batches, "body", 8 << 20)
            for r in batch.to_pylist()
        )
        member = next(members, None)
        while member is not None:
            path, sizes = f"{folder}/{uuid.uuid4().hex}.warc.gz", [0, 0]

            def fill(out) -> None:
                nonlocal member
                info = _member("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level)
                out.write(info)
                sizes[0] += len(info)
                while member is not None and sizes[0] < archive_bytes:
                    out.write(member)
                    sizes[0] += len(member)
                    sizes[1] += 1
                    member = next(members, None)

            publish(path, fill)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([sizes[0]]), pa.array([sizes[1]])], names=["path", "bytes", "records"])

    return written(marked.mapInArrow(write, MANIFEST), "warc-manifest")


def archives(spark: SparkSession, *paths: str) -> DataFrame:
    """path and bytes of archives by path or glob; their contents are not read."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.col("length").alias("bytes"))


class _Source:
    """Bytes of a file by position, read in blocks."""

    def __init__(self, uri: str, block: int = 1 << 18):
        files, path = filesystem(uri)
        self.file, self.block = files.open_input_file(path), block
        self.size = self.file.size()

    def read(self, at: int) -> bytes:
        return self.file.read_at(min(self.block, self.size - at), at) if at < self.size else b""


def _head(source: _Source, at: int) -> bool:
    """Whether the bytes at ``at`` decode to the start of a WARC record."""
    try:
        return zlib.decompressobj(31).decompress(source.read(at)[:4096], 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _scan(source: _Source, start: int, end: int) -> int | None:
    """Where the first member that starts in [start, end) is."""
    at = start
    while at < end:
        data = source.read(at)
        found = data.find(_MAGIC)
        while found >= 0 and at + found < end:
            if _head(source, at + found):
                return at + found
            found = data.find(_MAGIC, found + 1)
        if at + len(data) >= source.size:
            return None
        at += max(1, len(data) - len(_MAGIC) + 1)
    return None


def _inflate(source: _Source, at: int) -> tuple[bytes, int]:
    """The whole member at ``at``, and where it ends."""
    unpacker, parts = zlib.decompressobj(31), []
    while not unpacker.eof:
        data = source.read(at)
        if not data:
            raise ValueError("an archive ends inside a member")
        parts.append(unpacker.decompress(data))
        at += len(data) - len(unpacker.unused_data)
    return b"".join(parts), at


def _fields(data: bytes) -> tuple[dict[str, str], int]:
    """Header fields by lower-case name, and where the block starts."""
    end = data.index(b"\r\n\r\n")
    lines = _LINE_END.split(data[:end])[1:]
    return {k.decode().strip().lower(): v.decode().strip() for k, _, v in (x.partition(b":") for x in lines)}, end + 4


def _parsed(data: bytes, with_payload: bool) -> tuple | None:
    """A row of RECORDS from a record's bytes; None for kinds other than response and revisit."""
    fields, start = _fields(data)
    if fields.get("warc-type") not in ("response", "revisit"):
        return None
    block = data[start : start + int(fields["content-length"])]
    http, body = _fields(block)
    number = lambda name: int(fields[name]) if name in fields else None
    stated = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    if fields["warc-type"] == "revisit":
        size, payload = int(http["content-length"]), None
    else:
        payload = block[body:]
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != stated:
            raise ValueError(f"the payload of {fields['warc-record-id']} does not have the digest that its header states")
    return fields["warc-type"], fields["warc-record-id"], number("x-page-id"), fields.get("warc-target-uri"), number("x-refers-to-page-id"), size, stated, payload if with_payload else None


def records_in(uri: str, start: int, end: int, with_payload: bool = True) -> Iterator[tuple]:
    """Rows of RECORDS that start in bytes [start, end) of an archive."""
    source = _Source(uri)
    at = _scan(source, start, end)
    while at is not None and at < end:
        data, after = _inflate(source, at)
        row = _parsed(data, with_payload)
        if row:
            yield row
        at = after if after >= end or (after < source.size and source.read(after)[:3] == _MAGIC) else _scan(source, after, end)
    source.file.close()


def read_archives(found: DataFrame, split_bytes: int = 32 << 20, with_payload: bool = True) -> DataFrame:
    """RECORDS of every archive in ``found`` (path, bytes); payload is null for revisits and without ``with_payload``."""
    splits = found.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    count = max(1, splits.count())

    def read(batches):
        for batch in batches:
            for split in batch.to_pylist():
                rows, size = [], 0
                for row in records_in(split["path"], split["start"], split["start"] + split_bytes, with_payload):
                    rows.append(row)
                    size += row[5] + 200
                    if size >= 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return splits.repartition(count).mapInArrow(read, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
