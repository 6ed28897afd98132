"""WARC archives: one gzip member per record, written by executors and read back in sequence.

Writing: equal payloads are found by digest; the page with the smallest id is a `response`, the others are `revisit`
records that refer to it and keep the HTTP header of the full payload. Only ids and digests are grouped, never pages.
Each task writes its own files into the shared folder under a name of its own attempt; the manifest, itself a written
table, names the files of the attempts that succeeded, so a repeated task leaves no record twice.

Reading: a task streams its file, decompresses it incrementally, frames each block by its content length and checks
the block and payload digests. Memory is bounded by the read size and the header, whatever a record's length.

Rows: null html is an empty payload; a null url is not written and is read back as null. An id of any type is written as
its text, percent-encoded. A null page_id is written without an id and read back as null; it never is the
record that others refer to. Of repeated rows with the smallest id, each is a response.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import save, scratch, texts_of

MIN_REVISIT_BYTES, FILE_BYTES, READ_BYTES, LEVEL, SMALL_TABLE = 0, 256_000_000, 1 << 16, 4, 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _id(page_id: object) -> str:
    return "<urn:page-without-id>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def encode(page_id: object, url: str | None, payload: bytes, refers_to: object) -> bytes:
    """One record as one gzip member."""
    digest = _base32(hashlib.sha1(payload).digest())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_id(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).digest())}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(refers_to)}"]
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n") + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


@dataclass
class Record:
    headers: dict[str, str]
    payload_bytes: int
    payload_digest: str
    payload: bytes | None

    @property
    def page_id(self) -> str | None:
        return _page(self.headers["warc-record-id"])

    @property
    def refers_to(self) -> str | None:
        return _page(self.headers["warc-refers-to"]) if "warc-refers-to" in self.headers else None


def _page(uri: str) -> str | None:
    value = uri.strip("<>")
    return unquote(value.removeprefix("urn:page:")) if value.startswith("urn:page:") else None


class _Member:
    """The plain bytes of one gzip member, as they come."""

    def __init__(self, stream: BinaryIO, rest: bytes):
        self.stream, self.rest, self.have = stream, rest, b""
        self.unzip = zlib.decompressobj(31)

    def _more(self) -> bool:
        """Take in some more plain bytes; False at the member's end."""
        while not self.unzip.eof:
            raw = self.unzip.unconsumed_tail or self.rest or self.stream.read(READ_BYTES)
            self.rest = b""
            if not raw:
                raise ValueError("the archive ends inside a record")
            if got := self.unzip.decompress(raw, READ_BYTES):
                self.have += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """What stands before the mark, of any length: the writer puts whole urls into headers."""
        begin = 0
        while (at := self.have.find(mark, begin)) < 0:
            begin = max(0, len(self.have) - len(mark) + 1)
            if not self._more():
                raise ValueError("a header doesn't end")
        out, self.have = self.have[:at], self.have[at + len(mark) :]
        return out

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.have and not self._more():
                raise ValueError("a record is shorter than its content length")
            out, self.have = self.have[:size], self.have[size:]
            size -= len(out)
            yield out

    def close(self) -> bytes:
        """Check what follows the block; returns the compressed bytes after this member."""
        while self._more():
            pass
        if self.have != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its content length says")
        return self.unzip.unused_data


def records(stream: BinaryIO, keep: bool = True) -> Iterator[Record]:
    """The records of an archive, one after another. keep: hold payloads (else only their length and digest)."""
    rest = stream.read(READ_BYTES)
    while rest:
        m = _Member(stream, rest)
        lines = m.until(b"\r\n\r\n").decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block, payload = hashlib.sha1(), hashlib.sha1()
        http, kept, size, inside = b"", [], 0, False
        for part in m.take(int(headers["content-length"])):
            block.update(part)
            if not inside:
                http += part
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                part, http, inside = http[at + 4 :], http[: at + 4], True
            payload.update(part)
            size += len(part)
            if keep:
                kept.append(part)
        rest = m.close() or stream.read(READ_BYTES)
        if headers["warc-block-digest"] != f"sha1:{_base32(block.digest())}":
            raise ValueError(f"block digest of {headers['warc-record-id']} is wrong")
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        if headers["warc-type"] == "revisit":
            length = re.search(rb"\r\nContent-Length: (\d+)\r\n", http)
            yield Record(headers, int(length[1]), digest, None)
        else:
            if digest != _base32(payload.digest()):
                raise ValueError(f"payload digest of {headers['warc-record-id']} is wrong")
            yield Record(headers, size, digest, b"".join(kept) if keep else None)


def plan(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, refers_to: null for a response. Pages only cross a shuffle to meet the table of revisits where
    that has more than `SMALL_TABLE` rows; up to there it goes to the pages."""
    body = F.coalesce("html", F.lit(""))
    meta = pages.select("page_id", F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("size")).filter(F.col("size") >= least)
    first = meta.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    again = meta.select("page_id", "digest").distinct().join(first, "digest").filter(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    again = save(again.select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "refers_to"), "warc-revisits")
    if again.count() <= SMALL_TABLE:
        again = F.broadcast(again)
    mine = pages.select("page_id", "url", "html", F.sha1(body.cast("binary")).alias("digest"))
    return mine.join(again, mine["page_id"].eqNullSafe(again["again_id"]) & (mine["digest"] == again["again_digest"]), "left").select("page_id", "url", "html", "refers_to")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives; returns the manifest (path, records, bytes), a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        n = size = 0
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        row = lambda: pa.RecordBatch.from_pylist([{"path": path, "records": n, "bytes": size}], schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))
        for batch in batches:
            bodies = texts_of(batch.column("html"))
            for page_id, url, body, refers in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), bodies, batch.column("refers_to").to_pylist(), strict=True):
                if out is None:
                    path, n, size = f"{root}/part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                member = encode(page_id, url, body, refers)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    yield row()
        if out is not None:
            out.close()
            yield row()

    return save(plan(pages).mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read(manifest: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record; one task per archive."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, n = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for r in records(stream, keep=False):
                        rows.append((r.page_id, r.payload_bytes, r.payload_digest, r.headers["warc-type"], r.refers_to, r.headers.get("warc-target-uri")))
                        n += 1
                        if len(rows) == 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                if n != expected:
                    raise ValueError(f"{path} has {n} records, the manifest says {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    got = manifest.repartition(max(manifest.count(), 1)).mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string")
    return got.withColumns({n: F.col(n).cast(id_type) for n in ("page_id", "refers_to")})


def report(pages: DataFrame) -> DataFrame:
    """Round trip of the whole table: write the archives, then return what reading them gives."""
    folder = scratch(pages.sparkSession, "warc")
    return read(write(pages, folder), folder, pages.schema["page_id"].dataType.simpleString())
