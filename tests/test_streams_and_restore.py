"""Streamed activity windows, and restores."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from driftlog.operators import trees, windows
from driftlog.operators.segments import Debounce
from driftlog.session import scratch_path
from driftlog.sources import readers, restore, sinks
from driftlog.streaming.activity import activity_rows, activity_stream
from driftlog.streaming.runs import run_available, use_rocksdb

NOTES = (
    "session_id string, notif_id long, t_ms long, kind string, rename_mode string, paths array<string>, "
    "need_rescan boolean, error string"
)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def streamed(spark, parts, rule, **limits):
    use_rocksdb(spark)
    path = scratch_path(spark, "activity")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)
    return run_available(activity_stream(stream, rule, **limits), "activity-out")


def ends(spark, sessions):
    none = windows.observe(spark.createDataFrame([], NOTES), "/w")
    return activity_rows(none, ends=spark.createDataFrame([(s,) for s in sessions], "session_id string"))


def test_the_stream_equals_the_batch(spark):
    rng = random.Random(7)
    rule = Debounce(40, 150)
    notes, commands = [], []
    for session in ("a", "b"):
        for i in range(120):
            paths = [f"/w/p{rng.randrange(9)}" for _ in range(rng.randrange(1, 4))]
            notes.append((session, i, rng.randrange(3_000), rng.choice(["create", "modify", "remove"]), None, paths,
                          rng.random() < 0.2, "broken" if rng.random() < 0.05 else None))
        for i in range(14):
            commands.append((session, i, 200 * i + rng.randrange(150), rng.choice(["pause", "resume", "snap", "mark", "flush"])))
    raw = spark.createDataFrame(notes, NOTES)
    asked = spark.createDataFrame(commands, "session_id string, command_id long, t_ms long, command string")
    touches, overflows = windows.observe(raw, "/w"), windows.overflow_reports(raw)
    everything = activity_rows(touches, overflows, asked)
    cuts = [everything.filter(f"t_ms >= {a} and t_ms < {a + 700}") for a in range(0, 3_500, 700)]
    got = streamed(spark, [*cuts, ends(spark, "ab")], rule, max_paths=4, max_reports=2)

    assigned = windows.debounce(touches, rule, overflows, asked)
    bounds = windows.window_bounds(assigned, rule)
    assert rows(got.filter("kind = 'window'"), "session_id", "window_start", "last_ms", "closed_ms") == rows(
        bounds, "session_id", "window_start", "last_ms", "closed_ms")
    paths = windows.window_paths(windows.in_windows(touches, assigned))
    kept, limits, _ = windows.cap_paths(paths, 4)
    assert rows(got.filter("kind = 'path'"), "session_id", "window_start", "path", "place", "operation_bits") == rows(
        kept, "session_id", "window_start", "path", "rank", "operation_bits")
    reports, _ = windows.cap_overflows(windows.in_windows(overflows, assigned), 2)
    want = rows(reports, "session_id", "window_start", "place", "source", "raw_events")
    want += rows(limits.withColumn("place", F.lit(-1)), "session_id", "window_start", "place", "source", "raw_events")
    assert rows(got.filter("kind = 'overflow'"), "session_id", "window_start", "place", "source", "raw_events") == sorted(want, key=repr)
    assert limits.count() and reports.count()


def test_late_rows_join_the_open_window(spark):
    rule = Debounce(100, 1_000)
    def touch(i, t, path):
        return activity_rows(windows.observe(spark.createDataFrame([("s", i, t, "modify", None, [path], False, None)], NOTES), "/w"))
    got = streamed(spark, [touch(1, 500, "/w/a"), touch(2, 450, "/w/b"), touch(3, 2_000, "/w/c"), touch(4, 100, "/w/d"), ends(spark, "s")], rule)
    counts = rows(got.filter("kind = 'window'"), "window_start", "raw_events")
    assert sorted(counts) == [(500, 2), (2000, 2)]
    assert rows(got.filter("kind = 'path'"), "path") == [("a",), ("b",), ("c",), ("d",)]


# ---------------------------------------------------------------- restore

FILES = "path string, entry_type string, executable boolean, content binary"


def test_links_are_restored_or_refused(spark, tmp_path):
    files = spark.createDataFrame(
        [("bin/run", "file", True, bytearray(b"#!")), ("latest", "symlink", False, bytearray(b"bin/run")),
         ("bin/up", "symlink", False, bytearray(b"../bin/run")), ("out", "symlink", False, bytearray(b"../etc")),
         ("abs", "symlink", False, bytearray(b"/etc/passwd")), ("../x", "file", False, bytearray(b"x")),
         ("gone", "file", False, None), ("empty", "file", False, bytearray(b""))], FILES)
    target = str(tmp_path / "out")
    plan = dict(rows(restore.restore(files, target, str(tmp_path / "session")), "path", "outcome"))
    assert plan == {"bin/run": "write", "latest": "link", "bin/up": "link", "out": "link_escapes", "abs": "link_escapes",
                    "../x": "unsafe_path", "gone": "missing_content", "empty": "write"}
    assert os.readlink(f"{target}/latest") == "bin/run" and os.access(f"{target}/bin/up", os.X_OK)
    assert sorted(os.listdir(target)) == ["bin", "empty", "latest"] and os.listdir(tmp_path) == ["out"]
    assert rows(restore.restore_plan(files, links=False).filter("path = 'latest'"), "outcome") == [("link_unsupported",)]
    with pytest.raises(ValueError):
        sinks.restore(files, str(tmp_path / "other"), str(tmp_path / "session"))


def test_a_failed_restore_leaves_nothing(spark, tmp_path):
    files = spark.range(20).repartition(4).selectExpr(
        "concat('d/', id) path", "'file' entry_type", "false executable", "if(id = 13, raise_error('lost'), cast('x' as binary)) content")
    target = str(tmp_path / "out")
    with pytest.raises(Exception, match="lost"):
        restore.restore(files, target, str(tmp_path / "session"))
    assert not os.path.exists(target) and os.listdir(tmp_path) == []


def test_a_materialized_operation_is_restored(spark, tmp_path):
    versions = spark.createDataFrame(
        [("s", "a/run", "file", "b1", True, 1, 0, None), ("s", "link", "symlink", "b2", False, 5, 1, None), ("s", "old", "file", "b1", False, 1, 0, 1)],
        "session_id string, path string, entry_type string, blob string, executable boolean, bytes long, valid_from long, valid_to long")
    blobs = spark.createDataFrame([("b1", bytearray(b"x")), ("b2", bytearray(b"a/run"))], "blob string, content binary")
    known = spark.createDataFrame([("s", "op:0", 0), ("s", "op:1", 1), ("s", "op:2", 2)], "session_id string, op string, seq long")
    marks = spark.createDataFrame([("s", 1)], "session_id string, durable_seq long")
    asked = known.select("session_id", "op")
    files = trees.materialize(versions, asked, known, blobs, marks)
    assert rows(files.filter("outcome <> 'ok'"), "op", "outcome") == [("op:2", "not_durable")]
    target = str(tmp_path / "one")
    assert sinks.restore(files.filter("op = 'op:1' and outcome = 'ok'"), target, str(tmp_path / "s")) == 2
    assert os.readlink(f"{target}/link") == "a/run"
    found = readers.scan_tree(spark, f"file://{target}").filter("path = 'a/run'")
    assert rows(found, "path", "bytes") == [("a/run", 1)]


def test_small_files_are_read_by_few_tasks(spark, tmp_path, monkeypatch):
    """Spark deals files out by an opening cost; a tree is read by fewer tasks
    than that, with the same rows."""
    for i in range(300):
        (tmp_path / f"{i}.txt").write_text(str(i))
    monkeypatch.setattr(readers, "PARTITIONS_A_TASK", 8)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        found = readers.scan_tree(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() <= max(4 * spark.sparkContext.defaultParallelism, 38)
        assert {(r.path, bytes(r.content)) for r in found.collect()} == {(f"{i}.txt", str(i).encode()) for i in range(300)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
