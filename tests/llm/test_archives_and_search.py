"""WARC packages and exact search."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zipfile

import pytest

from driftlog.llm import balltree, warc
from driftlog.llm.blobs import RangeReader

PAGES = [
    (5, "http://a", "<p>x</p>"), (2, "http://b%0D\nc", "<p>x</p>"), (9, None, None), (3, "u", ""), (None, "n", "<p>x</p>"),
    (7, "v", "é" * 50_000), (8, "w", "é" * 50_000), (8, "w", "é" * 50_000), (1, "q", "a\r\n\r\nb\n"), (None, None, "only"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 digest", "2 first", "3 refers_to")


def test_round_trip(spark, pages, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_archives(pages.repartition(3), path, package_bytes=400)
    got = sorted(map(tuple, warc.read_records(warc.locate_records(spark, path)).collect()), key=repr)
    want = []
    for i, url, html in PAGES:
        data = (html or "").encode()
        same = [j for j, _, other in PAGES if (other or "") == (html or "") and j is not None]
        first = min(same, default=None)
        refers = None if first is None or i == first else first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, url or "", len(data), digest, "response" if refers is None else "revisit", refers, bytearray(data) if refers is None else None))
    assert got == sorted(want, key=repr)


def test_small_payloads_are_not_deduplicated(spark, pages, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, least_bytes=100)
    got = warc.read_records(warc.locate_records(spark, path), with_payload=False)
    assert got.filter("record_type = 'revisit' and payload_bytes < 100").count() == 0


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_records(warc.locate_records(spark, path)).count() == 0


def test_packages_are_zip64_files_others_can_read(tmp_path):
    members = [("a.txt", b"hello"), (warc.ARCHIVE, b"x" * 1000)]
    blob = warc.build_package(members)
    with zipfile.ZipFile(io.BytesIO(blob)) as file:
        assert file.testzip() is None and [(n, file.read(n)) for n in file.namelist()] == members
    (tmp_path / "p.zip").write_bytes(blob)
    path = f"file:{tmp_path}/p.zip"
    found = warc.members(RangeReader(), path, len(blob))
    assert [(m.name, RangeReader().read(path, m.start, m.size)) for m in found] == members


def test_foreign_package_without_index_or_zip64(spark, tmp_path):
    records = [warc.build_record(i, f"u{i}", b"z" * i, None) for i in range(5)]
    packed = b"".join(gzip.compress(r) for r in records)
    with zipfile.ZipFile(tmp_path / "f.wacz", "w", zipfile.ZIP_STORED) as file:
        file.writestr("archive/other.warc.gz", packed)
        file.writestr("pages.jsonl", b"{}", zipfile.ZIP_DEFLATED)
        file.comment = b"PK\x05\x06 in a comment"
    got = warc.read_records(warc.locate_records(spark, str(tmp_path))).orderBy("page_id").collect()
    assert [(r.page_id, r.url, bytes(r.payload)) for r in got] == [(i, f"u{i}", b"z" * i) for i in range(5)]


# -------------------------------------------------------------------- search


def brute(rows, k, every):
    import math

    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            cells = [math.floor(256 * x) for x in v]
            usable[i] = min(usable[i], cells) if i in usable else cells
    out = set()
    for q, a in usable.items():
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in usable.items() if i != q and len(a) == len(b))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("shard_rows", [40, 10_000])
def test_top_k(spark, shard_rows):
    import random

    rng = random.Random(6)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.25]) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 6) for i in range(30)]
    rows += [(400, None), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (550, [float("inf")] + [0.0] * 5)]
    rows += [(None, [1.0] * 6), (600, [1.0] * 3), (601, [2.0] * 3), (7, rows[7][1]), (650, []), (20, [9.0] * 6), (700, [1e9] * 6), (701, [-1e9] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 v", "2 shard", "3 dim", "4 block")
    got = {tuple(r) for r in balltree.top_k(df, 5, 10, shard_rows, 16).collect()}
    assert got == brute(rows, 5, 10)


def test_top_k_of_nothing(spark):
    assert balltree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
