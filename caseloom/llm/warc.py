"""Writing and sequential reading of WARC archives with one gzip member per record.

Archives are written by the tasks through Arrow's file systems into the shared folder, under names of their own, and
listed in a table; an attempt that failed leaves a file that no list names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.base import as_bytes, column, settle
from caseloom.session import work_path

CHUNK = 1 << 20  # bytes read at a time
ARCHIVE_BYTES = 64 << 20  # an archive is closed beyond this size
DATE = "2000-01-01T00:00:00Z"
RECORD = "urn:page:"


class DamagedArchive(ValueError):
    """A record whose frame or digest does not hold."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(text: str) -> str:
    """``text`` on one line: control characters and blanks as percent codes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(kind: str, page: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP header of the page, which tells its length, and no body."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{RECORD}{page}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {header_value(url)}")
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <{RECORD}{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += [
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other, each decompressed piece by piece."""
    unpack, parts = None, []
    rest = b""
    while True:
        data = rest or stream.read(CHUNK)
        rest = b""
        if not data:
            if unpack is not None:
                raise DamagedArchive("the archive ends inside a record")
            return
        if unpack is None:
            unpack, parts = zlib.decompressobj(31), []
        try:
            parts.append(unpack.decompress(data))
        except zlib.error as error:
            raise DamagedArchive("a record is not a gzip member") from error
        if unpack.eof:
            rest = unpack.unused_data
            yield b"".join(parts)
            unpack = None


def headers_of(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse(member: bytes) -> dict:
    """A record's fields; frame and digests are checked."""
    head, blank, rest = member.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not blank:
        raise DamagedArchive("a record has no header")
    fields = headers_of(head)
    size = int(fields.get("content-length", -1))
    if size < 0 or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise DamagedArchive("a record is not as long as it says")
    block = rest[:size]
    if fields.get("warc-block-digest") != "sha1:" + digest_of(block):
        raise DamagedArchive("a block does not match its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and digest_of(payload) != stated:
        raise DamagedArchive("a payload does not match its digest")

    def page(name: str) -> str | None:
        value = fields.get(name, "").strip("<>").removeprefix(RECORD)
        return value or None

    return {
        "page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"),
        "payload_bytes": int(headers_of(http)["content-length"]), "payload_digest": stated, "record_type": kind,
        "refers_to": page("warc-refers-to"), "payload": payload if kind == "response" else None,
    }


def file_system(path: str):
    """The file system and path of a place in the shared folder, named with or without a scheme."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def plan_records(pages: DataFrame, min_bytes: int, page_id: str, url: str, html: str) -> DataFrame:
    """Page, url, payload and the page its record refers to (null: a response).

    Digests are grouped without payloads; rows join their group's largest id on the digest.
    """
    rows = pages.select(
        column(page_id).cast("long").alias("page"), column(url).cast("string").alias("url"), F.coalesce(as_bytes(html), F.lit(b"")).alias("payload")
    ).withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    first = rows.filter(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(first, ["digest", "size"], "left").select(
        "page", "url", "payload", F.when(~F.col("first").eqNullSafe(F.col("page")), F.col("first")).alias("refers_to")
    )


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the planned records as archives in ``folder``; returns the settled list (path, n_records)."""

    def run(batches):
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        out = name = None
        size = count = 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                ref = row["refers_to"]
                page = "" if row["page"] is None else str(row["page"])
                data = record("response" if ref is None else "revisit", page, row["url"], row["payload"], None if ref is None else str(ref))
                out.write(data)
                size += len(data)
                count += 1
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [count]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [count]})

    return settle(records.mapInArrow(run, "path string, n_records long"), "archives")


def read_archives(spark: SparkSession, archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the listed archives (column path), each archive read from its start by one task.

    Returns page_id, url, payload_bytes, payload_digest, record_type and refers_to; with ``with_payload`` also payload,
    which is null for revisits. A damaged record raises DamagedArchive.
    """
    n = max(archives.count(), 1)
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = file_system(path)
                with system.open_input_stream(place, compression=None) as stream:
                    rows, held = [], 0
                    for member in members(stream):
                        row = parse(member)
                        row["page_id"], row["refers_to"] = (None if row[k] is None else int(row[k]) for k in ("page_id", "refers_to"))
                        payload = row["payload"] if with_payload else row.pop("payload")
                        rows.append(row)
                        held += len(payload) if with_payload and payload else 0
                        if len(rows) >= 500 or held > 8 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    schema = pa.schema([*kinds.items(), *([("payload", pa.binary())] if with_payload else [])])
    return archives.select("path").repartition(min(n, 10_000)).mapInArrow(run, ddl)


def archive_pages(
    pages: DataFrame, folder: str | None = None, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", with_payload: bool = False
) -> DataFrame:
    """Write a record for each row of ``pages`` and read the archives back.

    Of records with equal payloads of at least ``min_bytes`` bytes, those with the largest page id are responses and the
    others revisit it; smaller payloads are all responses. Null html is an empty payload, a null url has no target
    header. Rows that repeat the largest id are all responses; a null id is never the largest. Other columns are not
    archived. An empty table gives no archive and no rows.
    """
    spark = pages.sparkSession
    place = folder or work_path(spark, "warc")
    return read_archives(spark, write_archives(plan_records(pages, min_bytes, page_id, url, html), place), with_payload)
