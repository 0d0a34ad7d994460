"""WARC archives: one gzip member a record, written and read back one record after another.

Of pages with equal payloads (UTF-8 html; null is empty) the one with the smallest page_id becomes a response, the
others revisits that refer to it. A revisit keeps the HTTP header of its page, so its payload's length is known.
Archives are closed at ARCHIVE_BYTES and lie in a folder that all executors share. Each task writes files of names of
its own, and only files in the manifest of finished tasks are read, so tasks that are lost or run twice do no harm.

The reader decompresses in chunks, takes headers up to the empty line and then as many bytes as the content length
says, and recomputes the digests of responses. What can't be read ends that archive with a row that has `error`.

Cases: rows that repeat the smallest id of a payload are all responses; a null page_id comes after all others; a null
url has no target.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm import shared

ARCHIVE_BYTES = 64 << 20
CHUNK = 64 << 10
MAX_HEADER = 1 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """A gzip member: a response with the payload, or a revisit with the header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def assigned(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit). The payload is shuffled once, by its hash; a hash that many pages
    share is split by the adaptive skew join, and the smallest id of each hash is aggregated before its shuffle."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("hash", F.sha2("payload", 256))
    first = p.groupBy("hash").agg(F.min("page_id").alias("first"))  # null only if all are
    revisit = ~F.col("page_id").eqNullSafe(F.col("first"))
    return p.join(first, "hash").select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def written(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives for pages(page_id, url, html) and returns their manifest (path, records, bytes)."""
    target = f"{folder or shared.folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(target)
        store.create_dir(top, recursive=True)
        out, name, records, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page_id, url, payload, refers_to, revisit in zip(*(c for c in batch.columns), strict=True):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                member = record(page_id.as_py(), url.as_py(), payload.as_py().encode(), refers_to.as_py(), revisit.as_py())
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    done.append((f"{target}/{name}", records, size))
        if out is not None:
            out.close()
            done.append((f"{target}/{name}", records, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return shared.checkpointed(assigned(pages).mapInArrow(run, "path string, records long, bytes long"))


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder as Hadoop names it, for Arrow."""
    if uri.startswith("dbfs:/"):
        uri = "/dbfs/" + uri.removeprefix("dbfs:").lstrip("/")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


class Broken(ValueError):
    pass


def members(stream: BinaryIO) -> Iterator[tuple[int, Iterator[bytes]]]:
    """(offset, chunks of decompressed bytes) of each gzip member; each member's chunks must be used up before the next."""
    held, at = b"", 0

    def chunks() -> Iterator[bytes]:
        nonlocal held, at
        z = zlib.decompressobj(31)
        while not z.eof:
            data = held or stream.read(CHUNK)
            if not data:
                raise Broken("the archive ends inside a member")
            try:
                plain = z.decompress(data, CHUNK)
            except zlib.error as e:
                raise Broken(str(e)) from e
            held = z.unused_data if z.eof else z.unconsumed_tail
            at += len(data) - len(held)
            if plain:
                yield plain

    while True:
        held = held or stream.read(CHUNK)
        if not held:
            return
        yield at, chunks()


def _head(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")
    return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parsed(chunks: Iterator[bytes]) -> tuple[dict[str, str], bytes]:
    """Header and block of a record; the rest of the member must be the two line ends."""
    data = bytearray()
    while (end := data.find(b"\r\n\r\n")) < 0:
        if len(data) > MAX_HEADER or (more := next(chunks, None)) is None:
            raise Broken("a record without a header")
        data += more
    head = _head(bytes(data[:end]))
    if not head[""].startswith("WARC/") or not head.get("content-length", "").isdigit():
        raise Broken("not a record's header")
    del data[: end + 4]
    length = int(head["content-length"])
    for more in chunks:
        data += more
        if len(data) > length + 4:
            break
    if len(data) != length + 4 or data[length:] != b"\r\n\r\n":
        raise Broken("the content length doesn't fit the record")
    return head, bytes(data[:length])


_COLUMNS = "archive string, offset long, record_type string, page_id long, target string, payload_bytes long, payload_digest string, refers_to long, verified boolean, payload binary, error string"


def _id(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", value or "")
    return int(m[1]) if m else None


def rows(path: str, stream: BinaryIO, payloads: bool) -> Iterator[tuple]:
    offset = 0
    try:
        for offset, chunks in members(stream):
            head, block = parsed(chunks)
            http, _, payload = block.partition(b"\r\n\r\n")
            claimed = head.get("warc-payload-digest", "").removeprefix("sha1:")
            whole = head.get("warc-block-digest", "sha1:" + digest(block)) == "sha1:" + digest(block)
            if head["warc-type"] == "revisit":
                length = _head(http).get("content-length", "")
                yield path, offset, "revisit", _id(head.get("warc-record-id")), head.get("warc-target-uri"), int(length) if length.isdigit() else None, claimed, _id(head.get("warc-refers-to")), whole, None, None
            else:
                found = digest(payload)
                yield path, offset, head["warc-type"], _id(head.get("warc-record-id")), head.get("warc-target-uri"), len(payload), found, None, whole and claimed in ("", found), payload if payloads else None, None
    except (Broken, KeyError) as e:
        yield path, offset, None, None, None, None, None, None, False, None, str(e)


def records(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in manifest(path, ...), each archive read from its start by one task."""
    names = [x.split()[0] for x in _COLUMNS.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.string()]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = _store(path)
                with store.open_input_stream(at, compression=None) as stream:
                    found, size = [], 0
                    for row in rows(path, stream, payloads):
                        found.append(row)
                        size += len(row[9] or b"") + 200
                        if size > 4 << 20:
                            yield batch(found)
                            found, size = [], 0
                    yield batch(found)

    many = max(1, min(manifest.count(), 4000))
    return manifest.select("path").repartition(many).mapInArrow(run, _COLUMNS)
