"""WARC records in ZIP-packaged archives, written and read by range.

An archive is a ZIP whose members are stored: ``archive/data.warc.gz`` (one gzip member a record)
and ``indexes/index.cdxj`` (a line for each record with its offset and length). The reader finds the
end of the central directory, follows the ZIP64 one where sizes or places need it, locates the two
members and reads single records by range; nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_local, local_path, shared_dir, ship, stored

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 16 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A page whose copies are at least this share of all large pages is marked by broadcast.
HEAVY = 1000
#: Fixed values of the ZIP format: signatures of the local header, central entry, ends and ZIP64 parts.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
Reader = Callable[[int, int], bytes]


def zip_stored(members: dict[str, bytes], zip64: bool = False) -> bytes:
    """A ZIP of stored members, ended by a one-byte comment, a newline, which a text writer adds.

    The newline itself is not among the bytes. ``zip64`` writes the 64-bit fields even where
    32 bits would do.
    """
    out, directory, at = [], [], 0
    for name, data in members.items():
        raw, crc = name.encode(), zlib.crc32(data)
        wide = zip64 or len(data) >= 0xFFFFFFFF or at >= 0xFFFFFFFF
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        n = 0xFFFFFFFF if wide else len(data)
        head = struct.pack("<IHHHHHIIIHH", LOCAL, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, n, n, len(raw), len(extra)) + raw + extra
        more = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        directory.append(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, n, n, len(raw), len(more), 0, 0, 0, 0, 0xFFFFFFFF if wide else at) + raw + more)
        out += [head, data]
        at += len(head) + len(data)
    entries = b"".join(directory)
    wide = zip64 or len(members) >= 0xFFFF or at + len(entries) >= 0xFFFFFFFF
    if wide:
        entries64 = struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, len(members), len(members), len(entries), at)
        entries64 += struct.pack("<IIQI", LOCATOR64, 0, at + len(entries), 1)
        tail = struct.pack("<IHHHHIIH", END, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 1)
        return b"".join([*out, entries, entries64, tail])
    return b"".join([*out, entries, struct.pack("<IHHHHIIH", END, 0, 0, len(members), len(members), len(entries), at, 1)])


def zip_members(read: Reader, size: int) -> dict[str, tuple[int, int]]:
    """Name to (place of the data, bytes) of the stored members, from the central directory."""
    tail_at = max(0, size - 22 - 0xFFFF - 20)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(struct.pack("<I", END))
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(struct.pack("<I", END), 0, end)
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, place = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, place):
        signature, _, at64, _ = struct.unpack_from("<IIQI", read(tail_at + end - 20, 20))
        if signature != LOCATOR64:
            raise ValueError("no locator of a ZIP64 directory")
        wide = read(at64, 56)
        if struct.unpack_from("<I", wide)[0] != END64:
            raise ValueError("no ZIP64 directory")
        count, length, place = struct.unpack_from("<QQQ", wide, 32)
    entries, at, out = read(place, length), 0, {}
    for _ in range(count):
        if struct.unpack_from("<I", entries, at)[0] != CENTRAL:
            raise ValueError("broken central directory")
        method, packed, full, n_name, n_extra, n_note, header = struct.unpack_from("<10xH8xIIHHH8xI", entries, at)
        name = entries[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra = entries[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        if method == 0 and packed == full:
            signature, n1, n2 = struct.unpack_from("<I22xHH", read(header, 30))
            if signature != LOCAL:
                raise ValueError("broken local header")
            out[name] = (header + 30 + n1 + n2, full)
        at += 46 + n_name + n_extra + n_note
    return out


def _field(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page: int | None, url: str | None, html: bytes, digest: str, refers: int | None) -> bytes:
    """A response, or a revisit of page ``refers``; the date is fixed so that a rerun writes the same bytes."""
    kind = "response" if refers is None else "revisit"
    name = "http://archive.invalid/unknown" if url is None else _field(url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http + html if refers is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{_identity(page, url, digest)}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {name}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _identity(page: int | None, url: str | None, digest: str) -> uuid.UUID:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page}\n{url}\n{digest}")


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page, payload bytes, payload digest, record type, page referred to) of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("cut WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    page = int(fields["x-page-id"]) if "x-page-id" in fields else None
    if fields["warc-type"] == "revisit":
        refers = fields.get("x-refers-to-page-id")
        return page, int(_fields(http)["content-length"]), digest, "revisit", None if refers is None else int(refers)
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload differs from its digest")
    return page, len(payload), digest, "response", None


def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives of (page, url, html, digest, refers) rows, each closed at ``ARCHIVE_BYTES``."""
    data, index, at = [], [], 0

    def closed() -> pa.RecordBatch:
        blob = zip_stored({DATA: b"".join(data), INDEX: "".join(index).encode()})
        data.clear()
        index.clear()
        return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["file"])

    for batch in batches:
        for page, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            packer = zlib.compressobj(1, zlib.DEFLATED, 31)
            member = packer.compress(record(page, url, html or b"", digest, refers)) + packer.flush()
            data.append(member)
            index.append(f"{_field(url or '-')} 20000101000000 {json.dumps({'offset': str(at), 'length': str(len(member)), 'filename': DATA})}\n")
            at += len(member)
            if at >= ARCHIVE_BYTES:
                yield closed()
                at = 0
    if data:
        yield closed()


def records(read: Reader, size: int) -> Iterator[bytes]:
    """The records of an archive, each read by the range that the index gives."""
    members = zip_members(read, size)
    begin, _ = members[DATA]
    place, length = members[INDEX]
    for line in read(place, length).decode().splitlines():
        entry = json.loads(line.split(" ", 2)[2])
        yield zlib.decompress(read(begin + int(entry["offset"]), int(entry["length"])), 31)


def readers(batch: pa.RecordBatch) -> Iterator[tuple[Reader, int]]:
    """Range readers of a batch's archives: on mounted files in place, else on what Spark loaded."""
    if batch.num_columns > 2:
        for value in batch.column(2):
            view = memoryview(value.as_buffer())
            yield (lambda at, n, view=view: bytes(view[at : at + n])), len(view)
    else:
        for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with open(local_path(name), "rb") as f:

                def ranged(at: int, n: int, f=f) -> bytes:
                    f.seek(at)
                    return f.read(n)

                yield ranged, size


def write(pages: DataFrame, where: str) -> None:
    """Write a record for every row of (page_id, url, html) into archives below ``where``.

    Among rows with equal payloads of at least ``REVISIT_BYTES`` bytes, the largest page_id (all of its
    rows, should it be repeated) is a response and the others revisit it. A null page_id never wins
    over another. Null html is an empty payload, a null url gets a placeholder. page_id is an integer. Other columns are ignored.
    """
    ship(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page"), "url", html.cast("binary").alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    large = rows.filter(F.octet_length("html") >= REVISIT_BYTES).select("page", "digest")
    largest = stored(large.groupBy(F.col("digest").alias("same")).agg(F.max("page").alias("top"), F.count("*").alias("n")).filter("n > 1"))
    total = F.lit(max(large.count(), HEAVY))
    # Copies that are a great share of all pages are marked by broadcast, so that no page's copies are dealt to one task.
    heavy = F.broadcast(largest.filter(F.col("n") * HEAVY >= total).drop("n"))  # at most HEAVY rows
    known = rows.join(heavy, F.col("digest") == F.col("same"), "left")
    rest = known.filter("same IS NULL").drop("same", "top").join(largest.filter(F.col("n") * HEAVY < total).drop("n"), F.col("digest") == F.col("same"), "left")
    marked = known.filter("same IS NOT NULL").unionByName(rest)
    refers = F.when(F.col("top").isNotNull() & ~F.col("page").eqNullSafe(F.col("top")), F.col("top"))
    ready = marked.select("page", "url", "html", "digest", refers.alias("refers"))
    files = ready.mapInArrow(archives, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(where)


def read(spark, where: str) -> DataFrame:
    """One row per record of all archives below ``where``."""
    ship(spark)
    columns = ["path", "length"] if is_local(spark, where) else ["path", "length", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for reader, size in readers(batch):
                held = []
                for raw in records(reader, size):
                    held.append(parse(raw))
                    if len(held) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(where).filter("length > 0").select(*columns)  # no rows leave an empty file
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a new folder of the shared storage and read the archives back."""
    where = shared_dir(pages.sparkSession)
    write(pages, where)
    return read(pages.sparkSession, where)
