"""Small literal cases, one per documented behaviour."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from driftlog.functions.paths import glob_regex, ignore_list, recorded_path
from driftlog.functions.values import (
    change_kind, checkpoint_hex, clock_ns, event_object_name, response_class, touch_operation, valid_object_id,
)
from driftlog.operators import measure, publish, timeline, trees, validate, windows
from driftlog.operators.segments import Debounce
from driftlog.session import name_shared_root, scratch_path, shared_root
from driftlog.sources import readers, sinks
from driftlog.streaming.runs import run_available, use_rocksdb
from driftlog.streaming.windows import debounce_stream


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("out")).first().out


def event(seq, session="s", kind="mark", data=None, **more):
    body = {"label": "x", "meta": {}, "ref_op": "op:aa"} if data is None else data
    return json.dumps({"v": 0, "seq": seq, "session_id": session, "ts": "x", "type": kind, "data": body, **more})


def lines(spark, *values, file="f"):
    return spark.createDataFrame([(file, i + 1, v) for i, v in enumerate(values)], "file string, line_no bigint, value string")


def verdict(df):
    r = df.first()
    return r.ok, r.error_class, r.line_no, r.expected, r.actual


# ------------------------------------------------------------- functions


def test_touch_operations(spark):
    df = spark.createDataFrame(
        [("access", None), ("create", None), ("remove", None), ("modify", None), ("modify", "from"), ("any", None)],
        "kind string, mode string")
    got = [r.op for r in df.select(touch_operation(F.col("kind"), F.col("mode")).alias("op")).collect()]
    assert got == [None, "create", "remove", "modify", "rename", "other"]


@pytest.mark.parametrize("path,want", [
    ("/w/src/lib.rs", "src/lib.rs"), ("src/lib.rs", "src/lib.rs"), ("/w", None), ("/other/a", None), ("/wx/a", None),
    ("/w/.git/config", None), ("/w/a/.git/x", None), ("/w/build.tmp", None), ("/w/a.tmp/b", None),
    ("/w/spool/events.ndjson", None), ("/w/spool/events.ndjson2", "spool/events.ndjson2"),
    ("/w//a/./b", "a/b"), ("/w/a\\b", "a/b"), ("/w/dir/", "dir"),
])
def test_path_filter(spark, path, want):
    column = recorded_path(F.col("p"), "/w", ("/w/spool/events.ndjson",), ignore_list(["*.tmp"]))
    assert one(spark, column, p=path) == want


def test_globs():
    import re
    def match(glob, text):
        return re.fullmatch(glob_regex(glob), text) is not None
    assert match("*.tmp", "a/b.tmp") and match("target/**", "target/x/y") and not match("target/**", "target")
    assert match("**/node", "node") and match("**/node", "a/b/node") and match("a/**/b", "a/b") and match("a/**/b", "a/x/y/b")
    assert match("[!a]?", "bc") and not match("[!a]?", "ac") and match("{x,y}.rs", "y.rs") and match("a\\*", "a*")
    with pytest.raises(ValueError):
        glob_regex("[a")


def test_clock_is_exact(spark):
    assert one(spark, clock_ns(F.col("t")), t="1970-01-01T00:00:01.123456789Z") == 1_123_456_789
    assert one(spark, clock_ns(F.col("t")), t="1970-01-01T01:00:01.123+01:00") == 1_123_000_000
    assert one(spark, clock_ns(F.col("t")), t="1970-01-01T00:00:01.5") is None
    assert one(spark, clock_ns(F.col("t")), t="x") is None
    assert one(spark, clock_ns(F.col("t")), t="1970-01-01T00:00:02Z") == 2_000_000_000


def test_identifiers(spark):
    assert one(spark, checkpoint_hex(F.col("c")), c="c:" + "AB" * 20) == "ab" * 20
    assert one(spark, checkpoint_hex(F.col("c")), c="ab" * 19) is None
    assert one(spark, valid_object_id(F.col("c")), c="op:abcd") is True
    assert one(spark, valid_object_id(F.col("c")), c="op:abc") is False
    assert one(spark, event_object_name(F.col("s")), s=9) == "events/00000000000000000009.ndjson"


def test_response_classes(spark):
    df = spark.createDataFrame([(s,) for s in (200, 204, 409, 429, 503, 404, 301)], "status int")
    assert [r.c for r in df.select(response_class(F.col("status")).alias("c")).collect()] == [
        "success", "success", "conflict", "retry", "retry", "permanent", "permanent"]


# ------------------------------------------------------------ validation


def test_reader_reports_a_gap(spark):
    assert verdict(validate.validate_timeline(lines(spark, event(0), event(2)))) == (False, "sequence", 2, "1", "2")


def test_reader_order_and_blank_lines(spark):
    ok = lines(spark, event(0), "   ", event(1, future=True))
    assert verdict(validate.validate_timeline(ok)) == (True, None, None, None, None)
    wrong_version = event(0).replace('"v": 0', '"v": 1')
    assert verdict(validate.validate_timeline(lines(spark, wrong_version, "nope"))) == (False, "version", 1, None, "1")
    both = event(5, session="t").replace('"v": 0', '"v": 1')
    assert verdict(validate.validate_timeline(lines(spark, event(0), both)))[1] == "version"
    assert verdict(validate.validate_timeline(lines(spark, event(0), event(1, session="t")))) == (False, "session", 2, "s", "t")


@pytest.mark.parametrize("bad", [
    "nope", '{"v":0}', event(0).replace('"v": 0', '"v": 256'), event(0).replace('"seq": 0', '"seq": "0"'),
    event(0).replace('"seq": 0', '"seq": 18446744073709551615'), event(0, kind="unknown"),
    event(0, kind="flush", data={"op": "op:1"}), event(0, kind="flush", data={"op": "op:1", "through_seq": -1}),
    event(0, kind="touched_paths", data={"paths": [{"path": "a", "operations": ["fly"]}], "raw_events": 1,
                                         "window_started_at": "", "window_ended_at": ""}),
    event(0) + " x", event(0) + "," + event(1),
])
def test_reader_is_strict(spark, bad):
    assert verdict(validate.validate_timeline(lines(spark, bad)))[:3] == (False, "json", 1)


def test_reader_accepts_every_type(spark):
    stats = {k: 0 for k in ("added", "removed", "modified", "renamed", "mode_changed")}
    bodies = [
        ("session_start", {"roots": ["/w"], "baseline_op": "op:", "baseline_tree": "t:", "ignore": []}),
        ("snapshot", {"op": "o", "parent_op": "p", "commit": "c", "tree": "t", "stats": stats, "truncated": False,
                      "changes": [{"path": "a", "kind": "added", "bytes": 3}]}),
        ("touched_paths", {"paths": [{"path": "a", "operations": ["create"]}], "raw_events": 1,
                           "window_started_at": "", "window_ended_at": ""}),
        ("mark", {"label": "x", "ref_op": "o"}), ("flush", {"op": "o", "through_seq": 4}),
        ("session_end", {"final_op": "o", "reason": "r", "snapshots": 1, "events": 5}),
        ("error", {"scope": "s", "message": "m", "fatal": False, "retrying": True}),
        ("overflow", {"source": "s", "raw_events": 0, "recovery": "full_scan_snapshot", "future": 1}),
    ]
    text = [event(i, kind=k, data=d) for i, (k, d) in enumerate(bodies)]
    assert verdict(validate.validate_timeline(lines(spark, *text)))[0] is True


def test_spool_rules(spark):
    expected = spark.createDataFrame([("f", "s", 0, True)], "file string, spool_session string, spool_version int, complete boolean")
    def run(*values, exp=expected):
        return verdict(validate.validate_spool(lines(spark, *values), exp))
    assert run(event(0), "", event(1))[0] is True
    assert run(event(0), " ")[1:3] == ("json", 2)
    assert run(event(1, session="t"))[1] == "sequence"
    assert run(event(0, session="t"))[1:] == ("session", 1, "s", "t")
    assert run(event(0), exp=expected.withColumn("complete", F.lit(False)))[1] == "incomplete"


def test_viewer_rules(spark):
    def run(*values):
        return verdict(validate.validate_records(lines(spark, *values)))
    assert run('{"seq":0,"session_id":"s"}', "", '{"seq":1,"session_id":"s"}')[0] is True
    assert run('{"seq":0}', "nope")[1:3] == ("json", 2)  # before the missing session of line 1
    assert run('{"seq":0,"session_id":"s"}', '{"seq":2,"session_id":"s"}')[1:] == ("sequence", 2, "1", "2")
    assert run('{"seq":-1,"session_id":"s"}')[1] == "sequence_value"
    assert run("[1]")[1] == "record"
    assert run('{"seq":0,"session_id":""}')[1] == "session_missing"
    assert run('{"seq":0,"session_id":"s"}', '{"seq":1,"session_id":"t"}')[1] == "session"


def test_measurement_rules(spark):
    marks = spark.createDataFrame([("f", "s", 0)], "file string, manifest_session string, durable_seq bigint")
    def run(*values):
        text = lines(spark, *values) if values else lines(spark, "x").limit(0)
        return verdict(validate.validate_for_summary(text, marks))
    touched = {"paths": [{"path": "a", "operations": ["modify"]}], "raw_events": 2}
    assert run(event(0, kind="touched_paths", data=touched))[0] is True
    assert run()[1] == "empty"
    assert run(event(0, session="t"))[1:] == ("manifest_session", None, "s", "t")
    assert run(event(0), event(1))[1:] == ("durable", None, "0", "1")
    assert run(event(0).replace('"mark"', '""'))[1] == "type"
    assert run(event(0, data=[]))[1] == "data"
    assert run(event(0, kind="touched_paths", data={**touched, "raw_events": -1}))[1] == "raw_events"
    assert run(event(0, kind="touched_paths", data={**touched, "paths": 1}))[1] == "paths"
    assert run(event(0, kind="touched_paths", data={**touched, "paths": [1]}))[1] == "path_entry"
    assert run(event(0, kind="touched_paths", data={**touched, "paths": [{"path": 1}]}))[1] == "path"
    assert run(event(0, kind="touched_paths", data={**touched, "paths": [{"path": "a", "operations": [1]}]}))[1] == "operations"


def test_open_verdicts(spark):
    sessions = spark.createDataFrame([(x,) for x in ("none", "old", "behind", "ok", "up", "lost")], "session_id string")
    marks = spark.createDataFrame(
        [("old", True, 2, 0, 0, None), ("behind", True, 1, 0, 0, None), ("ok", True, 1, 0, 1, None),
         ("up", True, 1, 0, 1, "../x"), ("lost", True, 1, 0, 1, "events/9")],
        "session_id string, parsed boolean, session_format int, schema_version int, durable_seq bigint, events_object string")
    objects = spark.createDataFrame(
        [("behind", "events/000000.ndjson", True, None, 1), ("ok", "events/000000.ndjson", True, None, 1)],
        "session_id string, events_object string, ok boolean, error_class string, last_seq bigint")
    got = rows(validate.open_sessions(sessions, marks, objects), "session_id", "verdict", "requested_seq")
    assert got == [("behind", "beyond_watermark", 1), ("lost", "missing_object", None), ("none", "missing_manifest", None),
                   ("ok", "open", None), ("old", "incompatible", None), ("up", "unsafe_object", None)]


def test_live_gap_is_sticky(spark, small_chunks):
    df = spark.createDataFrame([("a", i, s, "s", None) for i, s in enumerate((7, 9, 8))]
                               + [("b", 0, 3, "s", None), ("b", 1, None, None, "lagged by 3"), ("b", 2, 4, "s", None)],
                               "stream_id string, arrival bigint, seq bigint, session_id string, lag string")
    got = rows(validate.live_continuity(df), "stream_id", "arrival", "outcome", "notice", "detail")
    assert got == [("a", 0, "accepted", None, None), ("a", 1, "notice", "sequence_gap", "Expected sequence 8, received 9"),
                   ("a", 2, "blocked", None, None), ("b", 0, "accepted", None, None),
                   ("b", 1, "notice", "sse_overflow", "lagged by 3"), ("b", 2, "blocked", None, None)]


# ------------------------------------------------------- windows, assembly


def notes(spark, *values):
    full = [("s", i, *v, False, None) if len(v) == 4 else ("s", i, *v) for i, v in enumerate(values)]
    return spark.createDataFrame(full, "session_id string, notif_id bigint, t_ms bigint, kind string, rename_mode string, "
                                       "paths array<string>, need_rescan boolean, error string")


def test_operations_merge_in_a_window(spark):
    df = notes(spark, (0, "modify", None, ["/w/a.txt"]), (1, "modify", None, ["/w/a.txt"]), (2, "modify", "any", ["/w/a.txt"]),
               (3, "access", None, ["/w/a.txt"]), (4, "create", None, ["/w/.git/x", "/w/b", "/w/c"]), (5, "create", None, ["/w/.jj/x"]))
    touches = windows.observe(df, "/w")
    paths = windows.window_paths(windows.in_windows(touches, windows.debounce(touches, Debounce(100, 500))))
    total = windows.aggregate_windows(paths).first()
    assert (total.paths, total.raw_events, total.started_ms, total.ended_ms) == (3, 4, 0, 4)
    listed = windows.touched_events(paths).first().paths
    assert [(p.path, list(p.operations)) for p in listed] == [("a.txt", ["modify", "rename"]), ("b", ["create"]), ("c", ["create"])]


def test_storm_on_one_path(spark):
    df = spark.range(100_000).selectExpr(
        "'s' session_id", "id notif_id", "id div 100 t_ms", "if(id % 2 = 0, 'create', 'remove') kind", "cast(null as string) rename_mode",
        "array('/w/a') paths", "false need_rescan", "cast(null as string) error")
    touches = windows.observe(df, "/w")
    paths = windows.window_paths(windows.in_windows(touches, windows.debounce(touches)))
    row = paths.first()
    assert paths.count() == 1 and row.raw_events == 100_000 and row.operation_bits == 0b101


def test_overflow_sources_extend_windows(spark):
    df = notes(spark, (0, "modify", None, ["/w/before"]), (60, "access", None, ["/w/x"], True, None),
               (120, "modify", None, ["/w/after"]), (150, "any", None, [], False, "backend"))
    touches, reports = windows.observe(df, "/w"), windows.overflow_reports(df)
    assert rows(reports, "t_ms", "source", "raw_events") == [(150, "notify:backend", 0), (60, "notify:rescan", 1)]
    assigned = windows.debounce(touches, Debounce(100, 500), reports)
    assert {r.window_start for r in assigned.collect()} == {0}
    assert rows(windows.full_scan_windows(windows.in_windows(reports, assigned)), "overflows", "overflow_raw", "full_scan") == [(2, 1, True)]


def test_report_cap_keeps_its_own_count(spark):
    df = spark.range(80).selectExpr("'s' session_id", "0L window_start", "id t_ms", "id notif_id", "'x' source", "id raw_events")
    kept, cut = windows.cap_overflows(df, windows.MAX_OVERFLOW_REPORTS)
    assert kept.count() + cut.count() == df.count()
    got = kept.orderBy("place").collect()
    assert len(got) == 64 and got[62].source == "x"
    assert (got[63].source, got[63].raw_events) == ("recorder:overflow_report_limit:64", 63)


def test_path_cap_keeps_first_seen(spark):
    df = notes(spark, (0, "create", None, ["/w/b"]), (1, "create", None, ["/w/a"]), (2, "create", None, ["/w/c"]), (3, "remove", None, ["/w/b"]))
    touches = windows.observe(df, "/w")
    paths = windows.window_paths(windows.in_windows(touches, windows.debounce(touches, Debounce(100, 500))))
    kept, reports, cut = windows.cap_paths(paths, 2)
    assert kept.count() + cut.count() == paths.count()
    assert rows(kept, "path", "operation_bits") == [("a", 1), ("b", 5)]
    assert rows(reports, "source", "raw_events") == [("recorder:audit_path_limit:2", 4)]


def test_assembly_order(spark, small_chunks):
    """Audit, snapshot, then the mark that waited; shutdown ends and flushes."""
    sessions = spark.createDataFrame([("s", 0)], "session_id string, opened_ms bigint")
    captures = spark.createDataFrame([("s", 10, 50, 4), ("s", 60, 70, None)], "session_id string, window_start bigint, closed_ms bigint, touched_raw bigint")
    reports = spark.createDataFrame([("s", 60, 70, 0, "notify:rescan", 1)], "session_id string, window_start bigint, closed_ms bigint, place bigint, source string, raw_events bigint")
    commands = spark.createDataFrame([("s", 1, 50, "mark"), ("s", 2, 70, "snap"), ("s", 3, 80, "snap"), ("s", 4, 90, "shutdown")],
                                     "session_id string, command_id bigint, t_ms bigint, command string")
    got = windows.assemble(sessions, captures, reports, commands).orderBy("seq").collect()
    assert [r.type for r in got] == ["session_start", "touched_paths", "snapshot", "mark", "overflow", "snapshot", "snapshot", "session_end", "flush"]
    assert [r.seq for r in got] == list(range(9))
    assert got[3].op == got[2].op != got[0].op and got[7].snapshots == 3
    assert got[8].op == got[6].op


# ------------------------------------------------------------------ trees


def tree(spark, *entries):
    return spark.createDataFrame([("s", *e) for e in entries], "session_id string, path string, entry_type string, blob string, executable boolean, bytes bigint")


def test_change_kinds(spark):
    before = tree(spark, ("mode", "file", "1", False, 1), ("gone", "file", "2", False, 1), ("link", "symlink", "3", False, 1),
                  ("same", "file", "4", True, 1), ("body", "file", "5", False, 1))
    after = tree(spark, ("mode", "file", "1", True, 1), ("new", "file", "6", False, 7), ("link", "file", "3", False, 1),
                 ("same", "file", "4", True, 1), ("body", "file", "7", True, 1))
    every, capped, stats = trees.project_diff(before, after, 2)
    assert rows(every, "path", "kind", "blob", "prev_blob", "bytes") == [
        ("body", "modified", "b:7", "b:5", 1), ("gone", "removed", None, "b:2", None), ("link", "modified", "b:3", "b:3", 1),
        ("mode", "mode_changed", "b:1", "b:1", 1), ("new", "added", "b:6", None, 7)]
    assert rows(capped, "path") == [("body",), ("gone",)]
    assert rows(stats, "added", "removed", "modified", "renamed", "mode_changed", "truncated") == [(1, 1, 2, 0, 1, True)]


def test_tree_id_depends_on_content_only(spark):
    a = tree(spark, ("x", "file", "1", False, 1), ("y", "file", "2", False, 1))
    def tid(df):
        return trees.tree_ids(df, ["session_id"]).first().tree
    assert tid(a) == tid(a.orderBy(F.desc("path")).repartition(5))
    assert tid(a) != tid(tree(spark, ("x", "file", "2", False, 1), ("y", "file", "1", False, 1)))
    assert tid(a) != tid(tree(spark, ("x", "file", "1", True, 1), ("y", "file", "2", False, 1)))


def test_diff_applied_to_before_gives_after(spark, small_chunks):
    gens = spark.range(200).selectExpr("'s' session_id", "explode(sequence(0, 5)) gen", "id").filter("(id + gen) % 4 <> 0").selectExpr(
        "session_id", "gen", "concat('p', id) path", "cast((id * 7 + gen) div 3 as string) blob", "id % 2 = 0 executable", "id bytes")
    versions = trees.history(trees.changes_between_generations(gens))
    asked = spark.createDataFrame([("s", g) for g in range(6)], "session_id string, at_seq bigint")
    at = trees.tree_at(versions, asked)
    assert rows(at, "at_seq", "path", "blob") == rows(gens.withColumnRenamed("gen", "at_seq"), "at_seq", "path", "blob")
    pair = spark.createDataFrame([("s", 1, 5), ("s", 4, 2), ("s", 3, 3)], "session_id string, before_seq bigint, after_seq bigint")
    state = {g: {r.path: r.blob for r in gens.filter(f"gen = {g}").collect()} for g in range(6)}
    for b, a in ((1, 5), (4, 2), (3, 3)):
        out = dict(state[b])
        for r in trees.diff_operations(versions, pair).filter(f"before_seq = {b} and after_seq = {a}").collect():
            assert out.pop(r.path, None) == r.before
            if r.after is not None:
                out[r.path] = r.after
        assert out == state[a]


def test_restore_and_inventory(spark, tmp_path):
    files = spark.createDataFrame([("a b.txt", False, bytearray(b"x")), ("d/run", True, bytearray(b"yy")), (".git/c", False, bytearray(b"z"))],
                                  "path string, executable boolean, content binary")
    target, session = str(tmp_path / "out"), str(tmp_path / "session")
    assert sinks.restore(files, target, session) == 3
    assert os.access(f"{target}/d/run", os.X_OK)
    assert rows(readers.scan_tree(spark, target), "path", "bytes") == [("a b.txt", 1), ("d/run", 2)]
    with pytest.raises(ValueError):
        sinks.restore(files, target, session)
    with pytest.raises(ValueError):
        sinks.restore(files, f"{session}/inside", session)


# --------------------------------------------------------------- delivery


def test_advance_decisions(spark):
    h = {k: k * 40 for k in "abcd"}
    ids = ["same", "new", "next", "other", "blind"]
    wanted = spark.createDataFrame([(s, "c:" + h["a"]) for s in ids], "session_id string, wanted string")
    tips = spark.createDataFrame([("same", h["a"]), ("next", h["b"]), ("other", h["c"]), ("blind", h["c"])], "session_id string, tip string")
    known = spark.createDataFrame([("next", h["b"]), ("other", h["b"])], "session_id string, expected string")
    assert rows(publish.advance_plan(wanted, tips, known), "session_id", "outcome") == [
        ("blind", "conflict_unexpected"), ("new", "create"), ("next", "advance"), ("other", "conflict"), ("same", "already_there")]


def test_retry_waits(spark):
    df = spark.createDataFrame([(1, n, 503, 2 if n == 3 else None) for n in range(1, 12)] + [(2, 1, 503, None), (2, 2, 200, None), (2, 3, 503, None)],
                               "request_id bigint, attempt int, status int, retry_after int")
    got = publish.retry_schedule(df)
    first = got.filter("request_id = 1").orderBy("attempt").collect()
    assert [r.wait_ms for r in first] == [50, 100, 2000, 400, 800, 1600, 3200, 5000, None, None, None]
    assert first[8].gave_up and first[8].started_after_ms == 13_150
    assert [r.over_limit for r in first] == [False] * 9 + [True] * 2
    assert rows(got.filter("request_id = 2"), "attempt", "class") == [(1, "retry"), (2, "success")]


def test_acknowledgements(spark):
    sent = spark.createDataFrame([("s", 1, None), ("s", 2, None), ("s", 3, 3), ("t", 3, 3), ("u", 3, 3), ("v", 3, 3)], "session_id string, last_seq bigint, durable_seq bigint")
    acks = spark.createDataFrame([("s", 1, 1, None), ("s", 2, 1, None), ("s", 3, 3, 4), ("t", 3, 3, None), ("u", 3, 3, 2)],
                                 "session_id string, last_seq bigint, accepted_through_seq bigint, durable_through_seq bigint")
    assert rows(publish.validate_acks(sent, acks), "session_id", "last_seq", "verdict") == [
        ("s", 1, "ok"), ("s", 2, "short"), ("s", 3, "ok"), ("t", 3, "no_durable"), ("u", 3, "durable_short"), ("v", 3, "missing")]


def test_redaction(spark):
    log = spark.createDataFrame([("s", 1, "Authorization: Bearer super-secret failed")], "session_id string, message_id bigint, message string")
    keys = spark.createDataFrame([("s", ["super-secret", ""])], "session_id string, secrets array<string>")
    assert publish.redact_log(log, keys).first().message == "Authorization: Bearer *** failed"


def test_listing_rules(spark):
    df = spark.createDataFrame([("p/s/a", 1), ("p/s/b/c", 2), ("p/s/d", 3)], "key_name string, size bigint")
    assert publish.audit_listing(df, " /p/s/ ").count() == 0
    assert rows(publish.listing_totals(df, "p/s"), "object_count", "object_bytes") == [(3, 6)]
    bad = spark.createDataFrame([("q/x", 1), ("p/s/../x", 1), ("p/s//x", 1), ("p/s/x/", 1), ("p/s/y", -1), ("p/s/z", 1), ("p/s/z", 1)], "key_name string, size bigint")
    assert rows(publish.audit_listing(bad, "p/s"), "key_name", "rule") == [
        ("p/s/../x", "unsafe_segment"), ("p/s//x", "unsafe_segment"), ("p/s/x/", "trailing_slash"), ("p/s/y", "invalid_size"),
        ("p/s/z", "duplicate"), ("q/x", "outside_prefix")]
    assert rows(publish.audit_listing(bad.filter("key_name = 'q/x'"), "p/s"), "rule") == [("empty",), ("outside_prefix",)]
    for prefix in ("", "/", "a//b", "a/../b", "."):
        assert rows(publish.audit_listing(bad, prefix), "key_name", "rule") == [(prefix, "bad_prefix")]
    # Only the keys without a broken rule count.
    assert rows(publish.listing_totals(bad, "p/s"), "object_count", "object_bytes") == [(0, 0)]


def test_sync_actions(spark):
    loose = "store/git/objects/ab/" + "c" * 38
    pack = "store/git/objects/pack/pack-" + "d" * 40 + ".idx"
    shape = "session_id string, path string, bytes bigint, digest string, file_type string"
    src = spark.createDataFrame([("s", loose, 1, "1", "file"), ("s", pack, 2, "2", "file"), ("s", "HEAD", 3, "3", "file"),
                                 ("s", "config", 4, "4", "file"), ("s", "new", 5, "5", "file"), ("s", "ln", 1, "6", "symlink")], shape)
    dst = spark.createDataFrame([("s", pack, 9, "9", "file"), ("s", "HEAD", 3, "3", "file"), ("s", "config", 4, "0", "file"),
                                 ("s", "old", 1, "1", "file"), ("s", "op_store/views/ff", 1, "1", "file")], shape)
    assert dict(rows(publish.sync_plan(src, dst), "path", "action")) == {
        loose: "link", pack: "reuse", "HEAD": "reuse", "config": "replace", "new": "copy", "ln": "error_symlink",
        "old": "remove", "op_store/views/ff": "keep"}
    assert rows(publish.sync_stats(publish.sync_plan(src, dst)), "files_linked", "files_reused", "bytes_copied") == [(1, 2, 9)]


def test_publication_survives_gaps_replays_and_restarts(spark):
    path = scratch_path(spark, "store")
    schema = "session_id string, seq bigint, body string"
    store = sinks.DurableStore(spark, path, schema)

    def batch(session, *seqs):
        return spark.createDataFrame([(session, q, f"b{q}") for q in seqs], schema)

    store.publish(batch("s", 0, 1), 0)
    store.publish(batch("s", 2, 3), 1)
    store.publish(batch("s", 2, 3), 1)
    # A gap: 6 waits until 4 and 5 are there.
    store.publish(batch("s", 6), 2)
    assert rows(store.visible(), "seq") == [(0,), (1,), (2,), (3,)]
    assert rows(store.watermarks(), "session_id", "durable_seq") == [("s", 3)]
    # Data of a failed attempt is staged, not accepted.
    batch("s", 9).write.parquet(f"{path}/staged/other/batch=7")
    assert store.live().isStreaming and store.visible().filter("seq = 9").isEmpty()
    # A restarted writer begins with batch 0 again and repeats what is there.
    again = sinks.DurableStore(spark, path, schema)
    again.publish(batch("s", 3, 4, 5).union(batch("t", 0)), 0)
    assert rows(again.visible(), "session_id", "seq") == [("s", q) for q in range(7)] + [("t", 0)]
    assert rows(again.watermarks(), "session_id", "durable_seq") == [("s", 6), ("t", 0)]
    streamed = run_available(again.live(), "live")
    assert rows(streamed, "session_id", "seq") == rows(again.visible(), "session_id", "seq")
    again.write_objects()
    again.write_objects()
    assert rows(again.published(), "session_id", "events_object") == [
        ("s", "events/00000000000000000006.ndjson"), ("t", "events/00000000000000000000.ndjson")]
    lines = readers.read_lines(spark, f"{path}/objects").filter("file like '%session_id=s%'")
    assert rows(lines, "line_no")[-1] == (7,) and lines.count() == 7


def test_no_streamed_row_is_lost(spark):
    use_rocksdb(spark)
    path = scratch_path(spark, "late")
    times = [1_000, 2_000, 400_000, 50_000, 401_000, 900_000, 300]
    for t in times:
        spark.createDataFrame([("s", t, False)], "session_id string, t_ms bigint, is_end boolean").coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([("s", None, True)], "session_id string, t_ms bigint, is_end boolean").coalesce(1).write.mode("append").parquet(path)
    shape = "session_id string, t_ms bigint, is_end boolean"
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path)
    closed = run_available(debounce_stream(stream, Debounce(1_500, 10_000)), "late-windows")
    assert closed.agg(F.sum("raw_events")).first()[0] == len(times)


def test_long_sessions_export_in_parts(spark):
    path = scratch_path(spark, "parts")
    lines = spark.range(5).selectExpr("'s' session_id", "id seq", "id").select(
        "session_id", "seq", F.format_string('{"v":0,"seq":%d,"session_id":"s","ts":"x","type":"mark","data":{"label":"l","meta":{},"ref_op":"o"}}', "id").alias("value"))
    sinks.write_timeline(lines, path, part_rows=2)
    got = readers.read_lines(spark, path)
    assert rows(got, "line_no") == [(n,) for n in range(1, 6)] and got.select("file").distinct().count() == 1
    assert rows(validate.validate_timeline(got.select("file", "line_no", "value")), "ok") == [(True,)]
    assert rows(readers.file_endings(spark, path), "complete") == [(True,)]


def test_absent_values(spark):
    same = spark.createDataFrame([(("file", "b", None), ("file", "b", None))], "x struct<entry_type:string,blob:string,executable:boolean>, y struct<entry_type:string,blob:string,executable:boolean>")
    assert same.select(change_kind(F.col("x"), F.col("y"))).first()[0] is None
    assert spark.range(1).select(response_class(F.lit(None).cast("int"))).first()[0] == "retry"
    seen = spark.createDataFrame([(".git/x",), ("a.tmp",), ("b",)], "p string").select(recorded_path(F.col("p"), "/w", ignores=["*.tmp"]).alias("p"))
    assert [r.p for r in seen.collect()] == [None, None, "b"]


def test_producers_can_require_start_fields(spark):
    body = {"roots": ["/w"], "baseline_op": "op:", "baseline_tree": "t:", "ignore": []}
    bare, full = lines(spark, event(0, kind="session_start", data=body)), lines(spark, event(0, kind="session_start", data={**body, "producer_version": "1"}))
    assert verdict(validate.validate_timeline(bare))[0]
    assert verdict(validate.validate_timeline(bare, start_fields=["producer_version"]))[:2] == (False, "json")
    assert verdict(validate.validate_timeline(full, start_fields=["producer_version"]))[0]


def test_unknown_events_show_their_body(spark):
    typed = timeline.typed(validate.with_event(lines(spark, event(0, kind="novel", data={"a": 1}))))
    shown = timeline.describe(typed)
    assert rows(shown, "title", "detail") == [("novel", '{"a":1}')]


def test_empty_objects_have_verdicts(spark):
    lines = spark.createDataFrame([], "file string, line_no bigint, value string")
    files = spark.createDataFrame([("e",)], "file string")
    assert rows(validate.validate_timeline(lines, files), "file", "ok") == [("e", True)]
    assert rows(validate.validate_records(lines, files), "file", "ok") == [("e", True)]
    manifest = spark.createDataFrame([("s", True, 1, 0, 4, "events/x")], "session_id string, parsed boolean, session_format int, schema_version int, durable_seq bigint, events_object string")
    timeline_rows = spark.createDataFrame([("s", "events/x", True, None, None)], "session_id string, events_object string, ok boolean, error_class string, last_seq bigint")
    got = validate.open_sessions(manifest.select("session_id"), manifest, timeline_rows)
    assert rows(got, "verdict", "requested_seq") == [("beyond_watermark", 0)]


def test_shared_root_follows_the_session(spark):
    root = name_shared_root(spark)
    assert shared_root(spark) == root
    assert name_shared_root(spark) == root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert root == named.rstrip("/")


def test_a_session_without_a_shared_folder(tmp_path):
    """A plain local install: no Spark configuration at all."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = """
from driftlog.session import build_session, name_shared_root, save_and_reload, shared_root
from pyspark.sql import SparkSession
plain = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert not plain.conf.get("spark.checkpoint.dir", None)
try:
    shared_root(plain)
except ValueError:
    pass
else:
    raise AssertionError
assert name_shared_root(plain) == shared_root(plain)
spark = build_session("local[1]")
assert save_and_reload(spark.range(3), "r").count() == 3
"""
    env = {k: v for k, v in os.environ.items() if k != "PYSPARK_SUBMIT_ARGS"}
    env |= {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": repo}
    done = subprocess.run([sys.executable, "-c", script], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr


def test_scratch_goes_with_the_application(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
from driftlog.session import build_session, save_and_reload
spark = build_session("local[1]", **{{"spark.checkpoint.dir": "{tmp_path}/shared"}})
assert save_and_reload(spark.range(3), "r").count() == 3
import os
assert len(os.listdir("{tmp_path}/shared/driftlog")) == 1
"""
    done = subprocess.run([sys.executable, "-c", script], env=os.environ | {"PYTHONPATH": repo}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert os.listdir(tmp_path / "shared" / "driftlog") == []


# ------------------------------------------------------------ measurement


def test_statistics_interpolate(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (4, 1, 3, 2)] + [("b", 7.0), ("c", None)], "k string, value double")
    got = {r.k: r for r in measure.statistics(df, ["k"]).collect()}
    assert (got["a"]["count"], got["a"].p50, got["a"].min, got["a"].max) == (4, 2.5, 1.0, 4.0)
    assert got["b"].p99 == 7.0 and "c" not in got


def test_narrow_values_are_split(spark, monkeypatch):
    seen = []
    real = measure.ordered_scan
    monkeypatch.setattr(measure, "ordered_scan", lambda df, *rest, **more: seen.append(df) or real(df, *rest, **more))
    df = spark.range(4000).selectExpr("'k' k", "1569.0 + id / 1000000.0 value")
    got = measure.statistics(df, ["k"]).first()
    assert (got.p50, got["count"]) == (pytest.approx(1569.0 + 1999.5e-6, abs=1e-9), 4000)
    assert seen[0].groupBy("_cut").count().agg(F.max("count")).first()[0] <= 80


def test_one_estimate_per_window(spark):
    name = measure.LATENCIES[0]
    df = spark.createDataFrame([("s", 1, 4, 20, "ok", 1.0), ("s", 2, 4, 10, "ok", 2.0)],
                               f"session_id string, sample_id bigint, touched_seq bigint, start_wall bigint, status string, {name} double")
    assert rows(measure.scope_estimates(df), "sample_id", "representative", name) == [(1, False, None), (2, True, 2.0)]


def test_write_log(spark):
    log = spark.range(7).selectExpr("id write_index")
    got = measure.final_state(log, 5, 30).orderBy("slot").collect()
    assert [r.writes for r in got] == [2, 2, 1, 1, 1]
    assert got[0].payload == ("%020d:" % 10 * 2)[:30] and got[4].path == "file-00000004.dat"


def test_matching_skips_other_snapshots_paths(spark, small_chunks):
    shape = "session_id string, seq bigint, type string, touched_paths struct<paths:array<struct<path:string,operations:array<string>>>>"
    df = spark.createDataFrame([("s", 4, "touched_paths", ([("sample", ["modify"])],)), ("s", 5, "snapshot", None), ("s", 6, "snapshot", None)], shape)
    edits = spark.createDataFrame([("s", "sample"), ("s", "never")], "session_id string, path string")
    assert rows(measure.match_edits(edits, df), "path", "touched_seq", "snapshot_seq", "status") == [
        ("never", None, None, "failed"), ("sample", 4, 5, "ok")]


# ---------------------------------------------------------------- sources


def test_numbering_survives_file_splits(spark):
    path = scratch_path(spark, "split")
    text = [event(i) if i % 7 else "" for i in range(1, 3000)]
    os.makedirs(path)
    with open(f"{path}/a.ndjson", "w") as out:
        out.write("\n".join(text) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = readers.read_lines(spark, path)
        assert got.select("file").distinct().count() == 1
        assert spark.read.text(path).rdd.getNumPartitions() > 4
        records = 0
        by_line = {r.line_no: r for r in got.collect()}
        assert len(by_line) == len(text)
        for number, value in enumerate(text, start=1):
            assert (by_line[number].value, by_line[number].rec_no) == (value, records)
            records += bool(value)
        assert readers.file_endings(spark, path).first().complete
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with open(f"{path}/b.ndjson", "w") as out:
        out.write(event(0))
    assert rows(readers.file_endings(spark, path), "complete") == [(False,), (True,)]


def test_typed_events_keep_meta_types(spark):
    df = validate.with_event(
        lines(spark, event(0, data={"label": "l", "meta": {"n": 3, "t": "x"}, "ref_op": "op:"}))).select("event")
    got = timeline.typed(df).select("mark.label", F.schema_of_variant("mark.meta").alias("m"), "snapshot").first()
    assert (got.label, got.m, got.snapshot) == ("l", "OBJECT<n: BIGINT, t: STRING>", None)
