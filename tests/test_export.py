"""Timelines written as files by tasks, as Spark's own writer places them."""

from __future__ import annotations

import os

import pytest

from driftlog.session import scratch_path
from driftlog.sources import readers, sinks

LINES = "session_id string, seq long, value string"


def tree(path):
    found = {}
    for folder, _, names in os.walk(path):
        for name in (n for n in names if not n.startswith((".", "_"))):
            with open(os.path.join(folder, name), encoding="utf-8") as file:
                found.setdefault(os.path.relpath(folder, path), []).append(file.read())
    return found


def test_parts_stand_where_spark_writes_them(spark, monkeypatch):
    names = ["a", "b/c:d", "é %", "x=y", "", None, "tab\t[1]"]
    rows = [(n, i, None if i == 3 else f"{n} {i} ü") for n in names for i in range(5)]
    lines = spark.createDataFrame(rows, LINES)
    own, plain = scratch_path(spark, "own"), scratch_path(spark, "plain")
    sinks.write_timeline(lines, own, part_rows=2)
    assert not os.path.exists(os.path.join(own, "_SUCCESS"))  # not by Spark's writer, a file at a time
    monkeypatch.setattr(sinks.export, "is_local", lambda path: False)
    sinks.write_timeline(lines, plain, part_rows=2)
    # NULL and '' share a folder; Spark numbers its files.
    assert {k: sorted("".join(v).splitlines()) for k, v in tree(own).items()} == {
        k: sorted("".join(v).splitlines()) for k, v in tree(plain).items()}
    strip = lambda df: sorted((r.file.rsplit("/", 1)[1], r.line_no, r.value) for r in df.collect())
    same = ~readers.F.col("file").contains("__HIVE")
    assert strip(readers.read_lines(spark, own).filter(same)) == strip(readers.read_lines(spark, plain).filter(same))
    with pytest.raises(ValueError, match="there already"):
        monkeypatch.undo()
        sinks.write_timeline(lines, own)


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    lines = spark.range(20).selectExpr("concat('s', id) session_id", "0L seq", "if(id = 13, raise_error('lost'), 'x') value")
    with pytest.raises(Exception, match="lost"):
        sinks.write_timeline(lines, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []
