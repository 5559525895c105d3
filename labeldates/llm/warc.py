"""WARC records in ZIP-packaged archives: written by the executors, read back by range without extraction.

A package is a ZIP file whose members are stored, not deflated: ``archive/data.warc.gz`` (each record a gzip member of
its own), ``indexes/index.cdxj`` (a JSON line per record with its offset and length) and ``datapackage.json``. The reader
goes from the end record through the ZIP64 locator, where there is one, to the central directory, finds where the stored
members' bytes lie, reads the index and then each record by its own byte range. Files are reached by ``pyarrow.fs`` from
the URI of the shared folder, so any store that it opens will do.

Of records with equal payloads, that of the largest page id is a response and holds the payload; the others are revisits
that refer to it. The choice is made on digests: a payload never travels for it. Digests are grouped with partial
aggregation, and joined back to the pages by ``common.join_named``, so a digest that many pages share (an empty payload,
an error page) never brings its rows into one task. A task writes packages of at most
``PACKAGE_BYTES`` and gives back their names; names hold the attempt, so a second attempt of a task writes files of its
own and only the files of the attempt that counted are in the manifest. The manifest is a table, not a list at the
driver.

Defined cases: null html is an empty payload. A null page id orders below all others; pages with the response's own id
and payload (repeated rows) are responses too. Payloads of fewer bytes than ``least`` are all responses. Extra columns
are ignored; a null url is written as an empty target.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PACKAGE_BYTES = 64 << 20
DATA, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC record. A revisit has the HTTP head, with the payload's length, and no payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + CRLF + CRLF
    block = head if revisit else head + payload
    target = "".join(c for c in url or "" if c.isprintable() and c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return CRLF.join([*(x.encode("utf-8", "surrogatepass") for x in lines), b"Content-Length: " + str(len(block)).encode(), b"", block, b"", b""])


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; checks its block digest."""
    head, _, rest = raw.partition(CRLF + CRLF)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if (said := headers.get("warc-block-digest")) and said != f"sha1:{digest(block)}":
        raise ValueError(f"block digest of {headers.get('warc-record-id')} does not match")
    return headers, block


# --- ZIP

class ZipWriter:
    """Members stored one after the other to a stream that only appends; ZIP64 fields where sizes need them."""

    def __init__(self, out, wide: bool = False):
        self.out, self.at, self.wide, self.entries = out, 0, wide, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, size, at = name.encode(), zlib.crc32(data), len(data), self.at
        big = self.wide or size >= FULL32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        self._write(struct.pack("<4sHHHHHIIIHH", LOCAL, 45 if big else 20, 0x800, 0, 0, 0x21, crc, FULL32 if big else size, FULL32 if big else size, len(raw), len(extra)) + raw + extra)
        self._write(data)
        self.entries.append((raw, crc, size, at))

    def finish(self) -> None:
        start = self.at
        for raw, crc, size, at in self.entries:
            big = self.wide or size >= FULL32 or at >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
            n, o = (FULL32, FULL32) if big else (size, at)
            self._write(struct.pack("<4sHHHHHHIIIHHHHHII", ENTRY, 45 if big else 20, 45 if big else 20, 0x800, 0, 0, 0x21, crc, n, n, len(raw), len(extra), 0, 0, 0, 0, o) + raw + extra)
        size, count = self.at - start, len(self.entries)
        if self.wide or start >= FULL32 or size >= FULL32 or count >= FULL16:
            there = self.at
            self._write(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, count, count, size, start))
            self._write(struct.pack("<4sIQI", LOCATOR64, 0, there, 1))
            count, size, start = FULL16, FULL32, FULL32
        self._write(struct.pack("<4sHHHHIIH", END, 0, 0, count, count, size, start, 0))


class ZipReader:
    """Where the stored members of a ZIP lie. ``read(at, n)`` reads a byte range; nothing else of the file is read."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - 22 - FULL16)
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at)  # those bytes can also stand in a comment
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if FULL16 == count or FULL32 in (length, start):
            locator = read(tail_at + at - 20, 20) if tail_at + at >= 20 else b""
            if locator[:4] == LOCATOR64:
                end = read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if end[:4] != END64:
                    raise ValueError("no ZIP64 end record where its locator points")
                count, length, start = struct.unpack_from("<QQQ", end, 32)
        self.members = dict(self._entries(read(start, length), count))

    def _entries(self, raw: bytes, count: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        at = 0
        for _ in range(count):
            if raw[at : at + 4] != ENTRY:
                raise ValueError("broken central directory")
            method, = struct.unpack_from("<H", raw, at + 10)
            packed, size, n, e, c = struct.unpack_from("<IIHHH", raw, at + 20)
            offset, = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + n].decode()
            extra, x = raw[at + 46 + n : at + 46 + n + e], 0
            while x + 4 <= len(extra):
                kind, length = struct.unpack_from("<HH", extra, x)
                if kind == 1:  # holds, in this order, the fields that are full above
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, x + 4))
                    size = next(wide) if size == FULL32 else size
                    packed = next(wide) if packed == FULL32 else packed
                    offset = next(wide) if offset == FULL32 else offset
                x += 4 + length
            yield name, (method, packed, offset)
            at += 46 + n + e + c

    def stored(self, name: str) -> tuple[int, int]:
        """Offset and size of a stored member's bytes in the file."""
        method, size, at = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; its records have no byte ranges")
        local = self.read(at, 30)
        if local[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        n, e = struct.unpack_from("<HH", local, 26)
        return at + 30 + n + e, size


class Package:
    """Reads records of a package by their index lines."""

    def __init__(self, read, size: int):
        self.zip = ZipReader(read, size)
        self.data_at, self.data_size = self.zip.stored(DATA)
        at, n = self.zip.stored(INDEX)
        self.lines = [json.loads(x) for x in read(at, n).decode().splitlines()]

    def record(self, line: dict) -> tuple[dict[str, str], bytes]:
        if line["offset"] < 0 or line["offset"] + line["length"] > self.data_size:
            raise ValueError("an index line points outside the archive")
        return parse(gzip.decompress(self.zip.read(self.data_at + line["offset"], line["length"])))

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for line in self.lines:
            yield self.record(line)


def opened(uri: str):
    """``read(offset, n)`` over a file, and its size."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    f = store.open_input_file(path)
    return (lambda at, n: f.read_at(n, at)), f.size()


# --- tables

def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([digest(x) for x in raw], pa.string())], names=["page_id", "n", "sha"])


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id``, ``sha`` and ``refers_to`` of the pages that are to be revisits, each once."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).transform(common.in_arrow, _digests, "page_id long, n long, sha string").where(F.col("n") >= least)
    rows = common.stash(rows, "digests")
    largest = rows.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.min(F.coalesce("page_id", F.lit(-(2**63)))).alias("low"), F.count(F.lit(1)).alias("n"))
    largest = common.stash(largest.where("refers_to is not null and low < refers_to").drop("low"), "largest")
    return common.join_named(rows, largest, "sha", rows.count()).where("page_id is null or page_id < refers_to").select("page_id", "sha", "refers_to").distinct()


def _writing(folder: str, package_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        body, lines, names = bytearray(), [], []

        def close() -> None:
            name = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}-{len(names):05d}.wacz"
            with store.open_output_stream(f"{path}/{name}") as out:
                z = ZipWriter(out)
                z.add(DATA, bytes(body))
                z.add(INDEX, "".join(json.dumps(x) + "\n" for x in lines).encode())
                z.add(ABOUT, json.dumps({"profile": "data-package", "records": len(lines)}).encode())
                z.finish()
            names.append((name, len(lines)))
            body.clear()
            lines.clear()

        for batch in batches:
            for page_id, url, html, sha, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = gzip.decompress(html)
                raw = gzip.compress(record(page_id, url, payload, sha, refers_to, revisit), compresslevel=4, mtime=0)
                lines.append({"page": page_id, "url": url, "digest": f"sha1:{sha}", "offset": len(body), "length": len(raw)})
                body += raw
                if len(body) >= package_bytes:
                    close()
        if lines:
            close()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n, _ in names]), pa.array([k for _, k in names], pa.int64())], names=["package", "records"])

    return run


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with their payload compressed, so that what a join moves is small."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            raw = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([gzip.compress(x, compresslevel=4, mtime=0) for x in raw], pa.binary()), pa.array([digest(x) for x in raw], pa.string())], names=["page_id", "url", "payload", "sha"])


def write(pages: DataFrame, folder: str, least: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write all pages as packages under ``folder``; the manifest, ``package`` and ``records``, is a written table."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    again = common.stash(revisits(rows, least).select(F.col("page_id").alias("__id"), F.col("sha").alias("__sha"), "refers_to"), "revisits")
    packed = rows.transform(common.in_arrow, _payloads, "page_id long, url string, payload binary, sha string")
    typed = packed.join(again, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha")), "left")
    return common.stash(typed.select("page_id", "url", "payload", "sha", F.col("__sha").isNotNull().alias("revisit"), "refers_to").transform(common.in_arrow, _writing(folder, package_bytes), "package string, records long"), "manifest")


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda urn: int(urn) if (urn := urn.removeprefix("<urn:page:").removesuffix(">")) else None
    kinds = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()))
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            rows = []
            for headers, block in Package(*opened(uri)).records():
                head, _, payload = block.partition(CRLF + CRLF)
                http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
                said, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                if kind == "response" and (digest(payload) != said or len(payload) != int(http["content-length"])):
                    raise ValueError(f"payload of {headers['warc-record-id']} in {uri} is not what was written")
                rows.append((number(headers["warc-record-id"]), int(http["content-length"]), said, kind, number(headers["warc-refers-to"]) if kind == "revisit" else None, headers["warc-target-uri"]))
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])


def read(manifest: DataFrame) -> DataFrame:
    """A row per record of the packages that the manifest names."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("package").repartition(parts, "package").transform(common.in_arrow, _reading, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
