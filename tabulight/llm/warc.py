"""Web archives in ZIP packages: WARC records written and read back by range.

An archive is a ZIP file of stored members: gzip-compressed WARC records one after the
other, and an index with the place of each. A reader finds the members through the end
record (ZIP64 too) and the central directory, and fetches a record by its byte range;
nothing is extracted. Files are opened with Arrow's file systems, so the shared folder
may be local, HDFS or an object store.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .frames import shared_folder, stage, to_batch

ARCHIVE_BYTES = 8 << 20
LEAST_REVISIT = 100
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
# Fixed values of the WARC and ZIP formats.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def record(page: dict) -> bytes:
    """One WARC record; a revisit has no payload, only its digest, length and the record it refers to."""
    revisit = page["refers_to"] is not None
    payload = page["body"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "" if page["page_id"] is None else page["page_id"]
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Payload-Digest: sha256:{page['digest']}", "Content-Type: application/http; msgtype=response",
    ]
    if page["url"] is not None:
        lines.append("WARC-Target-URI: " + page["url"].replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{page['refers_to']}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode()
    return VERSION + b"\r\n" + head + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """What a record says: page_id, url, payload (None for a revisit), its bytes and digest, type and reference."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION:
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.decode().partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.lower().split(b"content-length:")[1].split(b"\r\n")[0])
    kind = fields["warc-type"]
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload does not match its record")

    def page(name):
        text = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    return {
        "page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"),
        "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": digest,
        "record_type": kind, "refers_to": page("warc-refers-to"),
    }


def package(records: list[tuple[int | None, bytes]], force_zip64: bool = False) -> bytes:
    """A ZIP file of stored members with the records of (page id, record) and their index."""
    data, index = io.BytesIO(), []
    for page_id, plain in records:
        member = gzip.compress(plain, 1, mtime=0)
        index.append(json.dumps({"page_id": page_id, "offset": data.tell(), "length": len(member)}))
        data.write(member)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        for name, content in ((DATA, data.getvalue()), (INDEX, "\n".join(index).encode())):
            with archive.open(zipfile.ZipInfo(name), "w", force_zip64=force_zip64) as member:
                member.write(content)
    return out.getvalue()


def read_range(file, start: int, size: int) -> bytes:
    file.seek(start)
    return file.read(size)


def directory(file, size: int) -> dict[str, tuple[int, int]]:
    """The place and size of each stored member's bytes, from the central directory."""
    tail_at = max(0, size - 65_557)
    tail = read_range(file, tail_at, size - tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end record")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if FULL16 == count or FULL32 in (length, start):
        place = tail_at + at - 20
        locator = read_range(file, place, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        end64 = read_range(file, struct.unpack("<Q", locator[8:16])[0], 56)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack("<QQQ", end64[32:56])
    entries = read_range(file, start, length)
    found, at = {}, 0
    for _ in range(count):
        if entries[at : at + 4] != ENTRY:
            raise ValueError("a bad directory entry")
        method = struct.unpack("<H", entries[at + 10 : at + 12])[0]
        packed, plain, name_size, extra_size, note_size = struct.unpack("<IIHHH", entries[at + 20 : at + 34])
        local = struct.unpack("<I", entries[at + 42 : at + 46])[0]
        name = entries[at + 46 : at + 46 + name_size].decode()
        extra = entries[at + 46 + name_size : at + 46 + name_size + extra_size]
        wide = wide_fields(extra)
        plain, packed, local = (
            wide.pop(0) if value == FULL32 else value for value in (plain, packed, local)
        )
        if method != 0 or plain != packed:
            raise ValueError(f"{name} is not stored")
        head = read_range(file, local, 30)
        if head[:4] != LOCAL:
            raise ValueError("a bad local header")
        found[name] = (local + 30 + sum(struct.unpack("<HH", head[26:30])), packed)
        at += 46 + name_size + extra_size + note_size
    return found


def wide_fields(extra: bytes) -> list[int]:
    """The 64-bit values of a ZIP64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack("<HH", extra[at : at + 4])
        if kind == 1:
            return [struct.unpack("<Q", extra[p : p + 8])[0] for p in range(at + 4, at + 4 + size - 7, 8)]
        at += 4 + size
    return []


def read_archive(file, size: int) -> Iterator[dict]:
    """The records of an open archive, each fetched by the range its index gives."""
    members = directory(file, size)
    start, length = members[INDEX]
    base = members[DATA][0]
    for line in read_range(file, start, length).decode().splitlines():
        entry = json.loads(line)
        yield parse_record(gzip.decompress(read_range(file, base + entry["offset"], entry["length"])))


def mark(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, body, digest, refers_to): of equal payloads of LEAST_REVISIT bytes or more, which to revisit.

    The smallest page id of a payload is the response, in all rows that have it; rows with
    a null page id are responses. A null payload is empty.
    """
    body = F.coalesce(F.col(html).cast("string").cast("binary"), F.lit(b""))
    plain = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("body")
    ).withColumn("digest", F.sha2("body", 256))
    heads = (
        plain.filter(F.octet_length("body") >= LEAST_REVISIT).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    )
    return plain.join(heads, "digest", "left").select(
        "page_id", "url", "body", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to")
    )


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Write the records and return (path, size, records) of each archive, staged.

    A task starts a new file when one has ARCHIVE_BYTES. Names are new in every attempt,
    and only the archives in the returned table count, so a task that is lost or run
    twice leaves files that nothing reads.
    """
    parsed = StructType.fromDDL("path string, size long, records long")
    target = to_arrow_schema(parsed)

    def run(batches):
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        held: list = []
        size = 0

        def flush():
            name = f"{uuid.uuid4().hex}.wacz"
            data = package(held)
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            return to_batch({"path": [f"{folder}/{name}"], "size": [len(data)], "records": [len(held)]}, target)

        for batch in batches:
            for row in range(batch.num_rows):
                page = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
                plain = record(page)
                held.append((page["page_id"], plain))
                size += len(plain)
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return stage(marked.mapInArrow(run, parsed))


def read_archives(archives: DataFrame, payload: bool = False) -> DataFrame:
    """The records of (path, size) archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    ``payload`` adds the payload itself (null for revisits).
    """
    parsed = StructType.fromDDL(
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
        + ", payload binary" * payload
    )
    target = to_arrow_schema(parsed)
    names = [f.name for f in parsed]

    def run(batches):
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_file(name) as file:
                    rows = list(read_archive(file, size))
                yield to_batch({n: [r[n] for r in rows] for n in names}, target)

    count = max(1, archives.count())
    return archives.select("path", "size").repartition(min(count, 10_000)).mapInArrow(run, parsed)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    folder = shared_folder(pages.sparkSession) + "-wacz"
    return read_archives(write_archives(mark(pages, key, url, html), folder))
