"""Packages that other writers may make."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json

from driftlog.llm import warc
from driftlog.llm.blobs import write_blobs
from driftlog.session import scratch_path

BODY = b"<p>caf\xc3\xa9</p>\r\n\r\nmore"


def record(kind: str, block: bytes, **fields: str) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}>"]
    lines += [f"{name.replace('_', '-')}: {value}" for name, value in fields.items()]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def foreign_records() -> list[bytes]:
    http = "application/http; msgtype=response"
    digest = "sha1:" + base64.b32encode(hashlib.sha1(BODY).digest()).decode()
    return [
        record("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"),
        record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", Content_Type="application/http; msgtype=request", WARC_Target_URI="http://a/"),
        record("response", b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n" + BODY, Content_Type=http, WARC_Payload_Digest=digest, WARC_Target_URI="http://a/%41"),
        record("revisit", b"HTTP/1.1 200 OK\r\n\r\n", content_type=http, WARC_Payload_Digest=digest, WARC_Refers_To="<urn:uuid:response>"),
        record("resource", b"", Content_Type="text/plain"),
    ]


def read(spark, packages: list[bytes]):
    path = scratch_path(spark, "foreign")
    # The text sink ends a file in a line feed, which is the package's comment.
    assert all(p.endswith(b"\n") for p in packages)
    write_blobs(spark.createDataFrame([(bytearray(p[:-1]),) for p in packages], "package binary"), "package", path)
    places = warc.locate_records(spark, path)
    rows = sorted((r.record_type, r.payload_bytes, r.page_id, r.refers_to, r.url, bytes(r.payload) if r.payload is not None else None)
                  for r in warc.read_records(places).collect())
    return places.count(), rows


WANT = sorted([
    ("warcinfo", 13, None, None, None, b"software: x\r\n"), ("request", 0, None, None, "http://a/", b""),
    ("response", len(BODY), None, None, "http://a/%41", BODY), ("revisit", None, None, None, None, None), ("resource", 0, None, None, None, b""),
])


def test_plain_and_gzipped_archives_without_index(spark):
    records = foreign_records()
    packed = b"".join(gzip.compress(r) for r in records)
    package = warc.build_package([("archive/a.warc.gz", packed), ("archive/b.warc", b"".join(records)), ("notes.txt", b"x")])
    count, rows = read(spark, [package])
    assert count == 10 and rows == sorted(WANT * 2)


def test_an_index_only_speaks_for_the_archives_it_names(spark):
    records = foreign_records()
    packed = [gzip.compress(r) for r in records]
    lines, at = [], 0
    for p in packed[:3]:
        lines.append("a,b)/ 20240101000000 " + json.dumps({"url": "http://a/", "offset": str(at), "length": len(p), "filename": "a.warc.gz"}))
        at += len(p)
    cdx, at = [" CDX N b a m s k r M S V g"], 0
    for p in packed[:2]:
        cdx.append(f"a,b)/ 20240101000000 http://a/ text/html 200 ABC - - {len(p)} {at} c.warc.gz")
        at += len(p)
    archive = b"".join(packed)
    package = warc.build_package([
        ("archive/a.warc.gz", archive), ("archive/b.warc.gz", archive), ("archive/c.warc.gz", archive),
        ("indexes/a.cdxj", "\n".join(lines).encode()), ("indexes/c.cdx", "\n".join(cdx).encode()),
    ])
    count, rows = read(spark, [package, warc.build_package([("archive/d.warc", b"\r\n" + b"".join(records))])])
    assert count == 3 + 5 + 2 + 5
    assert [r[0] for r in rows].count("warcinfo") == 4 and [r[0] for r in rows].count("resource") == 2


def test_a_wrong_digest_is_refused():
    bad = record("response", b"HTTP/1.1 200 OK\r\n\r\nx", Content_Type="application/http", WARC_Payload_Digest="sha1:AAAA")
    try:
        warc.parse_record(bad)
    except ValueError:
        return
    raise AssertionError
