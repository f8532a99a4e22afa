"""Web archives in ZIP packages: written from pages, read back by ranges without extraction.

A package is a ZIP file whose members are stored, not compressed: archive/data.warc.gz, where every WARC record is a gzip
member of its own, indexes/index.cdxj with a line per record (offset, length), and datapackage.json. The reader knows its
file only through read(offset, length): it finds the end record, follows ZIP64 records where the 32-bit fields are full,
walks the central directory, takes a member's place from its local header, and then fetches the index and each record by
itself.

Packages are rows of a binary column in a table in the shared folder, of at most PACKAGE_BYTES of payload unless one page
is larger; files from elsewhere can be read with Spark's binaryFile source, whose content column fits.

Of records with equal payloads of MIN_REVISIT bytes or more, the one with the smallest page_id is a response, the others
are revisits that refer to it and have no payload. Null html is the empty payload; a null page_id is written without an id,
read back as null, and comes after all others when a response is chosen. Rows that repeat a page_id and a payload are all
responses if that id is the smallest. An empty table gives an empty table. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligo.session import cut_lineage

c = F.col

MIN_REVISIT = 0
PACKAGE_BYTES = 16 << 20
DATE = "2020-01-01T00:00:00Z"  # pages carry none
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEX = set("0123456789abcdef")

Read = Callable[[int, int], bytes]


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header: int  # offset of the local header


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


# Writing

def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, size: int, payload: bytes | None, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit (payload None); both keep the HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = {"WARC-Type": "response" if payload is not None else "revisit", "WARC-Date": DATE}
    if page_id is not None:
        headers["WARC-Record-ID"] = f"<urn:page:{page_id}>"
    if url is not None:
        headers["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    headers["WARC-Payload-Digest"] = f"sha1:{digest}"
    if payload is None:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    block = http + (payload or b"")
    headers |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def package(rows: list[tuple]) -> bytes:
    """A ZIP package of pages (page_id, url, html bytes or None for a revisit, size, digest, refers_to)."""
    warc, lines = io.BytesIO(), []
    for page_id, url, payload, size, digest, refers_to in rows:
        at = warc.tell()
        warc.write(gzip.compress(_record(page_id, url, size, payload, digest, refers_to), LEVEL, mtime=0))
        lines.append(json.dumps({"url": url, "digest": f"sha1:{digest}", "offset": at, "length": warc.tell() - at}))
    index = "".join(f"{i:010d} {DATE} {line}\n" for i, line in enumerate(lines)).encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((WARC, warc.getbuffer()), (INDEX, index)):
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), data)
        z.writestr(zipfile.ZipInfo("datapackage.json", (2020, 1, 1, 0, 0, 0)), json.dumps({"profile": "data-package", "resources": [
            {"path": name, "bytes": len(data), "hash": "sha256:" + hashlib.sha256(data).hexdigest()} for name, data in ((WARC, warc.getbuffer()), (INDEX, index))]}))
    return out.getvalue()


# Reading

def members(read: Read, size: int) -> Iterator[Member]:
    """The central directory of a ZIP file of ``size`` bytes."""
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and end + 22 + int.from_bytes(tail[end + 20:end + 22], "little") != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)  # the signature may occur in the comment
    if end < 0:
        raise ValueError("not a ZIP file")
    count, length, start = struct.unpack("<HII", tail[end + 10:end + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = read(tail_at + end - 20, 20)
        if locator[:4] == b"PK\x06\x07":
            at, = struct.unpack("<Q", locator[8:16])
            large = read(at, 56)
            if large[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 end record is missing")
            count, length, start = struct.unpack("<QQQ", large[32:56])
    directory, at = read(start, length), 0
    for _ in range(count):
        if directory[at:at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack("<HH", directory[at + 8:at + 12])
        packed, plain, n_name, n_extra, n_comment = struct.unpack("<IIHHH", directory[at + 20:at + 34])
        header, = struct.unpack("<I", directory[at + 42:at + 46])
        name = directory[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, at = directory[at + 46 + n_name:at + 46 + n_name + n_extra], at + 46 + n_name + n_extra + n_comment
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # 64-bit values, only of the fields that are full, in this order
                wide, values = extra[4:4 + n], []
                for value in (plain, packed, header):
                    if value == 0xFFFFFFFF:
                        value, wide = int.from_bytes(wide[:8], "little"), wide[8:]
                    values.append(value)
                plain, packed, header = values
            extra = extra[4 + n:]
        yield Member(name, method, packed, header)


def stored(read: Read, member: Member) -> Read:
    """Reads ranges of a stored member."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; ranges of it cannot be read")
    head = read(member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.name} has no local header")
    n_name, n_extra = struct.unpack("<HH", head[26:30])
    begin = member.header + 30 + n_name + n_extra

    def part(offset: int, length: int) -> bytes:
        return read(begin + offset, max(0, min(length, member.size - offset)))
    return part


def parse_record(data: bytes) -> Record:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return Record(headers, rest[:int(headers["content-length"])])


def records(read: Read, size: int) -> Iterator[Record]:
    """The records of a package, each fetched by the range its index line gives."""
    found = {m.name: m for m in members(read, size)}
    index, warc = stored(read, found[INDEX]), stored(read, found[WARC])
    for line in index(0, found[INDEX].size).decode().splitlines():
        at = json.loads(line.split(" ", 2)[2])
        yield parse_record(zlib.decompress(warc(at["offset"], at["length"]), wbits=31))


def _page(r: Record) -> tuple:
    def number(name: str) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", r.headers.get(name, ""))
        return int(m[1]) if m else None

    head, _, payload = r.block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", head)[1])
    digest = r.headers["warc-payload-digest"].removeprefix("sha1:")
    kind = r.headers["warc-type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("a payload differs from its digest")
    return number("warc-record-id"), size, digest, kind, number("warc-refers-to")


# Over tables

def decided(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, size, digest (hex), refers_to (null for responses), html (null for revisits)."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({
        "size": F.octet_length("html").cast("long"), "digest": F.sha1(c("html").cast("binary"))})
    # only payloads that several pages have; the first id is found before rows meet, so a common payload is no hot group
    firsts = p.filter(c("size") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter(
        "n > 1 and first is not null").select(c("digest").alias("_digest"), "first")
    met = p.join(firsts, c("digest") == c("_digest"), "left")
    revisit = c("first").isNotNull() & ~c("page_id").eqNullSafe(c("first"))
    return met.select("page_id", "url", "size", "digest", F.when(revisit, c("first")).alias("refers_to"),
                      F.when(~revisit, c("html")).alias("html"))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for b in batches:
        for r in b.to_pylist():
            payload = None if r["html"] is None else r["html"].encode()
            if rows and held + len(payload or b"") > PACKAGE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([package(rows)], pa.binary())], names=["content"])
                rows, held = [], 0
            digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
            rows.append((r["page_id"], r["url"], payload, r["size"], digest, r["refers_to"]))
            held += len(payload or b"") + 200
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([package(rows)], pa.binary())], names=["content"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column("content"):
            data = memoryview(content.as_buffer())
            rows = [_page(r) for r in records(lambda at, n: bytes(data[at:at + n]), len(data))]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)],
                                             names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def write_packages(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """The packages, one row each, in a written table."""
    return cut_lineage(decided(pages, min_revisit).mapInArrow(_write, "content binary"), "warc-packages")


def read_packages(packages: DataFrame) -> DataFrame:
    """A row per record of the packages in column ``content``."""
    return packages.select("content").mapInArrow(
        _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
