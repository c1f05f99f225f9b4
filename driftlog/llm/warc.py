"""WARC records in ZIP packages, written and range-read in Spark.

A package is a ZIP file of stored (uncompressed) members: an archive of
individually gzipped WARC records and a CDXJ index with one line per record.  The
reader only fetches byte ranges: the end of the file, the central directory
(ZIP64 or not), the members' local headers, the index, and then the records it
names.  Nothing is extracted or read as a whole.

Packages of other writers may hold several archives, gzipped or plain, CDX or
CDXJ indexes that name them, or none, and records of any type.  An archive that
no index line names is walked from record to record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.llm.blobs import RangeReader, list_blobs, write_blobs

PACKAGE_BYTES = 8 << 20
READ_AHEAD = 1 << 20
HEAD_BYTES = 4_096
ARCHIVE = "archive/data.warc.gz"
INDEX = "indexes/index.cdxj"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
_COMPACT = "20240101000000"


# ------------------------------------------------------------------ packages


def build_package(members: list[tuple[str, bytes]], comment: bytes = b"\n") -> bytes:
    """A ZIP file of stored members with ZIP64 sizes, offsets and directory."""
    body, directory = bytearray(), bytearray()
    for name, data in members:
        spelled, crc, at = name.encode(), zlib.crc32(data), len(body)
        sizes = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        body += struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 0, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(spelled), len(sizes))
        body += spelled + sizes + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        directory += struct.pack(
            "<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF,
            len(spelled), len(extra), 0, 0, 0, 0, 0xFFFFFFFF,
        )
        directory += spelled + extra
    start, end = len(body), len(body) + len(directory)
    count = len(members)
    tail = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, len(directory), start)
    tail += struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    tail += struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(comment))
    return bytes(body + directory + tail + comment)


class Member(NamedTuple):
    name: str
    start: int
    size: int


def members(reader: RangeReader, path: str, length: int) -> list[Member]:
    """The stored members of a package, from its central directory."""
    tail_size = min(length, 65_535 + 22 + 20)
    tail = reader.read(path, length - tail_size, tail_size)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError(f"{path} is not a ZIP package")
    count, size, start = struct.unpack("<H2I", tail[at + 10 : at + 20])
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        (place,) = struct.unpack("<Q", tail[at - 12 : at - 4])
        count, size, start = struct.unpack("<32x3Q", reader.read(path, place, 56))
    directory = reader.read(path, start, size)
    found, at = [], 0
    for _ in range(count):
        flags, method = struct.unpack("<2H", directory[at + 8 : at + 12])
        packed, plain, named, extras, noted = struct.unpack("<2I3H", directory[at + 20 : at + 34])
        (local,) = struct.unpack("<I", directory[at + 42 : at + 46])
        name = directory[at + 46 : at + 46 + named].decode()
        extra = directory[at + 46 + named : at + 46 + named + extras]
        while len(extra) >= 4:
            kind, width = struct.unpack("<2H", extra[:4])
            if kind == 1:
                # Only fields that do not fit their 32 bits stand here, in order.
                long = list(struct.unpack(f"<{width // 8}Q", extra[4 : 4 + width // 8 * 8]))
                plain = long.pop(0) if plain == 0xFFFFFFFF else plain
                packed = long.pop(0) if packed == 0xFFFFFFFF else packed
                local = long.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + width :]
        at += 46 + named + extras + noted
        if method == 0 and not flags & 1:
            head = reader.read(path, local, 30)
            found.append(Member(name, local + 30 + sum(struct.unpack("<2H", head[26:30])), plain))
    return found


# ------------------------------------------------------------------- records


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    named = "none" if page_id is None else str(page_id)
    block = _HTTP if refers_to is not None else _HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{named}>",
        # A line end in a URL would end the field.
        f"WARC-Target-URI: {(url or '').replace('%', '%25').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{_digest(payload)}",
        f"Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _page(identity: str | None) -> int | None:
    """The page id in a record id of this module's own form."""
    named = (identity or "").removeprefix("<urn:page:").removesuffix(">")
    return int(named) if named.lstrip("-").isdigit() and (identity or "").startswith("<urn:page:") else None


def parse_record(raw: bytes) -> dict[str, object]:
    """The fields of a record of any type.

    The payload of a response or request is its HTTP body, that of a revisit is
    missing, that of any other record its block.  Size and digest are taken from
    the payload, a revisit's from its header, where they may be unknown; a
    response whose header states another SHA-1 is refused.
    """
    head, _, rest = raw.lstrip(b"\r\n").partition(b"\r\n\r\n")
    lines = [line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]]
    fields = {name.strip().lower(): value.strip() for name, _, value in lines}
    block = rest[: int(fields["content-length"])]
    kind = fields.get("warc-type", "unknown")
    http = fields.get("content-type", "").startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    stated = fields.get("warc-payload-digest", "")
    size: int | None = len(payload)
    if kind == "revisit":
        size = int(fields["payload-length"]) if "payload-length" in fields else None
        digest = stated.removeprefix("sha1:") or None
    else:
        digest = _digest(payload)
        if kind == "response" and stated.startswith("sha1:") and stated.removeprefix("sha1:") != digest:
            raise ValueError(f"payload of record {fields.get('warc-record-id')} does not match its digest")
    url = fields.get("warc-target-uri")
    identity, refers = fields.get("warc-record-id"), fields.get("warc-refers-to")
    own = (identity or "").startswith("<urn:page:")
    return {
        "page_id": _page(identity),
        "url": url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if url and own else url,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page(refers),
        "record_id": identity,
        "payload": None if kind == "revisit" else payload,
    }


def index_places(lines: list[str]) -> Iterator[tuple[str, int, int]]:
    """(file name, offset, length) of the lines of a CDX or CDXJ index.  A CDX
    index names its columns in its first line; lines without length are left
    out, so their archives are walked."""
    columns = {"S": 8, "V": 9, "g": 10}
    for line in lines:
        if line.startswith(" CDX"):
            columns = {letter: i for i, letter in enumerate(line.split()[1:])}
        elif line.rstrip().endswith("}"):
            about = json.loads(line[line.index("{") :])
            if "offset" in about and "length" in about:
                yield str(about.get("filename", "")), int(about["offset"]), int(about["length"])
        else:
            parts = line.split()
            if len(parts) > max(columns.get(c, 1 << 30) for c in "SVg") and parts[columns["S"]].isdigit():
                yield parts[columns["g"]], int(parts[columns["V"]]), int(parts[columns["S"]])


# --------------------------------------------------------------------- Spark


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): pages whose payload an earlier page has.

    The page with the least page_id of a payload is its response and refers to
    nothing.  Only digests that occur twice are joined back.
    """
    named = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.when(F.octet_length("html") >= least_bytes, F.sha1("html")))
    again = (
        named.filter("digest is not null")
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    return named.join(again, "digest", "left").select(
        "page_id", "url", "html", F.expr("case when not page_id <=> first then first end").alias("refers_to")
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> None:
    """Write a record per row of ``pages`` into packages below ``path``.

    Payloads of at least ``least_bytes`` bytes that occur again become revisit
    records.  A package is closed at ``package_bytes``; a longer record has one
    of its own.  NULL html is an empty payload, a NULL page_id an unnamed
    record, and a NULL url an empty one.  Rows repeating a page_id and payload
    are all responses.  An empty table writes no package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, index = bytearray(), []

        def package() -> pa.RecordBatch:
            whole = build_package([(ARCHIVE, bytes(archive)), (INDEX, "".join(index).encode())])
            archive.clear()
            index.clear()
            return pa.RecordBatch.from_arrays([pa.array([whole[:-1]], pa.binary())], ["package"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, html, refers_to = (c[i].as_py() for c in columns)
                record = gzip.compress(build_record(page_id, url, html.encode(), refers_to), 1, mtime=0)
                about = {"filename": ARCHIVE, "offset": str(len(archive)), "length": str(len(record))}
                index.append(f"{'none' if page_id is None else page_id} {_COMPACT} {json.dumps(about)}\n")
                archive += record
                if len(archive) >= package_bytes:
                    yield package()
        if index:
            yield package()

    write_blobs(mark_revisits(pages, least_bytes).mapInArrow(run, "package binary"), "package", path)


def locate_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, length) of every record of the packages below ``path``.

    Offsets count from the start of the package file.  The places come from the
    index members, each line for the archive it names, by its full or its last
    name, or for the only one; an archive without a line is walked record by
    record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader()
        for batch in batches:
            for name, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stored = members(reader, name, length)
                archives = [m for m in stored if m.name.endswith((".warc.gz", ".warc"))]
                named = {m.name.rsplit("/", 1)[-1]: m for m in archives} | {m.name: m for m in archives}
                known: dict[Member, list[tuple[int, int]]] = {}
                for index in [m for m in stored if m.name.endswith((".cdx", ".cdxj"))]:
                    lines = reader.read(name, index.start, index.size).decode("utf-8", "replace").split("\n")
                    for file, offset, size in index_places(lines):
                        archive = named.get(file) or named.get(file.rsplit("/", 1)[-1])
                        archive = archive or (archives[0] if len(archives) == 1 and not file else None)
                        if archive is not None:
                            known.setdefault(archive, []).append((offset, size))
                for archive in archives:
                    places = known.get(archive) or list(_walk(reader, name, archive))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(places), pa.string()),
                            pa.array([archive.start + p[0] for p in places], pa.int64()),
                            pa.array([p[1] for p in places], pa.int64()),
                        ],
                        ["path", "offset", "length"],
                    )

    return list_blobs(spark, path).mapInArrow(run, "path string, offset bigint, length bigint")


def _walk_plain(reader: RangeReader, path: str, archive: Member) -> Iterator[tuple[int, int]]:
    """Borders of the records of an uncompressed archive, by their lengths."""
    at = 0
    while at < archive.size:
        head, ask = b"", HEAD_BYTES
        while b"\r\n\r\n" not in head.lstrip(b"\r\n") and len(head) < archive.size - at:
            head = reader.read(path, archive.start + at, min(ask, archive.size - at))
            ask *= 4
        begun = at + len(head) - len(head.lstrip(b"\r\n"))
        fields = head.lstrip(b"\r\n").partition(b"\r\n\r\n")
        if not fields[1]:
            return
        sizes = [line.partition(b":")[2] for line in fields[0].split(b"\r\n") if line.lower().startswith(b"content-length:")]
        end = begun + len(fields[0]) + 4 + int(sizes[0])
        yield begun, end - begun
        at = end


def _walk(reader: RangeReader, path: str, archive: Member) -> Iterator[tuple[int, int]]:
    """Borders of the records of an archive without index: those of its gzip
    members, or of plain records."""
    if reader.read(path, archive.start, min(2, archive.size)) != b"\x1f\x8b":
        yield from _walk_plain(reader, path, archive)
        return
    at, fetched = 0, 0
    waiting = b""
    unpack, begun = zlib.decompressobj(31), 0
    while True:
        if not waiting:
            waiting = reader.read(path, archive.start + fetched, min(READ_AHEAD, archive.size - fetched))
            fetched += len(waiting)
            if not waiting:
                return
        unpack.decompress(waiting)
        waiting = unpack.unused_data
        if unpack.eof:
            at = fetched - len(waiting)
            yield begun, at - begun
            begun = at
            unpack = zlib.decompressobj(31)


_FIELDS = {
    "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
    "record_type": pa.string(), "refers_to": pa.int64(),
}


def read_records(places: DataFrame, with_payload: bool = True, with_ids: bool = False) -> DataFrame:
    """The records at (path, offset, length), each read as a byte range.

    Neighbouring ranges are fetched together, up to ``READ_AHEAD`` bytes.  Size
    and digest are those of the full payload; a revisit has no payload of its
    own.  Records of other writers and types have no page_id; ``with_ids`` adds
    every record's record_id.  An empty table gives an empty result.
    """
    kinds = _FIELDS | ({"payload": pa.binary()} if with_payload else {}) | ({"record_id": pa.string()} if with_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader()
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            rows.sort()
            at = 0
            while at < len(rows):
                path, start, length = rows[at]
                stop, end = at + 1, start + length
                while stop < len(rows) and rows[stop][0] == path and rows[stop][1] == end and end - start < READ_AHEAD:
                    end += rows[stop][2]
                    stop += 1
                data = memoryview(reader.read(path, start, end - start))
                parts = [data[o - start : o - start + n] for _, o, n in rows[at:stop]]
                records = [parse_record(gzip.decompress(p) if p[:2] == b"\x1f\x8b" else bytes(p)) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[name] for r in records], kind) for name, kind in kinds.items()], list(kinds)
                )
                at = stop

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    schema += (", payload binary" if with_payload else "") + (", record_id string" if with_ids else "")
    return places.select("path", "offset", "length").mapInArrow(run, schema)
