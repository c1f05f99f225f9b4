"""The chunked greedy segmenters against sequential loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from driftlog.operators import windows
from driftlog.operators.publish import batches
from driftlog.operators.segments import BatchLimit, Debounce, batch_bounds, debounce_instants


def walk(times, quiet, cap):
    out, start, last = {}, None, None
    for t in sorted(times):
        if start is None or t >= min(start + cap, last + quiet):
            start = t
        out[t], last = start, t
    return out


@pytest.mark.parametrize("quiet,cap,chunk", [(10, 40, 64), (10, 40, 7), (50, 60, 200), (3, 1000, 97), (40, 10, 33)])
def test_debounce_matches_a_loop(spark, quiet, cap, chunk):
    rng = random.Random(quiet * cap + chunk)
    rows = []
    for session, count, step in (("dense", 900, 4), ("sparse", 80, 60), ("one", 1, 1)):
        t = rng.randint(0, 50)
        for _ in range(count):
            rows.append((session, t))
            t += rng.randint(1, step)
    df = spark.createDataFrame(rows, "session_id string, t_ms bigint").selectExpr(
        "session_id", "t_ms", "t_ms eff_ms", "0L epoch"
    )
    got = {(r.session_id, r.t_ms): r.window_start
           for r in debounce_instants(df, Debounce(quiet, cap, chunk)).collect()}
    want = {}
    for session in ("dense", "sparse", "one"):
        for t, start in walk([t for s, t in rows if s == session], quiet, cap).items():
            want[session, t] = start
    assert got == want


def simulate(notes, commands, quiet, cap):
    """Event loop over instants and commands; a command at an instant's time
    comes first."""
    queue = sorted([(t, 1, None) for t in notes] + [(t, 0, c) for t, c in commands])
    windows_, start, last, paused = [], None, None, None

    def close(at):
        nonlocal start, last
        windows_.append((start, last, at))
        start = last = None

    for t, _, command in queue:
        if start is not None:
            deadline = min(start + cap, last + quiet)
            if deadline <= t and (paused is None or deadline < paused):
                close(deadline)
        if command is None:
            if start is None:
                start = t
            last = t
        elif command == "pause":
            paused = t if paused is None else paused
        else:
            if start is not None:
                close(t)
            if command == "resume":
                paused = None
    if start is not None:
        deadline = min(start + cap, last + quiet)
        close(deadline if paused is None or deadline < paused else None)
    return windows_


@pytest.mark.parametrize("seed", range(3))
def test_commands_and_pauses_match_an_event_loop(spark, small_chunks, seed):
    rng = random.Random(seed)
    rule = Debounce(12, 45, 50)
    notes, commands = {}, {}
    for session in ("a", "b", "c"):
        notes[session] = sorted({rng.randint(0, 1500) for _ in range(220)})
        times = rng.sample(range(1600), 30)
        commands[session] = [(t, rng.choice(["pause", "pause", "resume", "snap", "mark", "flush"])) for t in sorted(times)]
    touches = spark.createDataFrame(
        [(s, t) for s in notes for t in notes[s]], "session_id string, t_ms bigint")
    asked = spark.createDataFrame(
        [(s, i, t, c) for s in commands for i, (t, c) in enumerate(commands[s])],
        "session_id string, command_id bigint, t_ms bigint, command string")
    got = {
        s: sorted((r.window_start, r.last_ms, r.closed_ms) for r in rows)
        for s, rows in _by_session(windows.window_bounds(windows.debounce(touches, rule, None, asked), rule)).items()
    }
    for session in notes:
        want = simulate(notes[session], commands[session], 12, 45)
        assert got[session] == [w for w in sorted(want)]


def _by_session(df):
    out = {}
    for row in df.collect():
        out.setdefault(row.session_id, []).append(row)
    return out


def greedy(lengths, max_events, max_bytes):
    out, i = [], 0
    while i < len(lengths):
        size, n = 2, 0
        while i + n < len(lengths) and n < max_events:
            extra = lengths[i + n] + (1 if n else 0)
            if n and size + extra > max_bytes:
                break
            size, n = size + extra, n + 1
        out.append((i, i + n - 1, n, size))
        i += n
    return out


@pytest.mark.parametrize("limit", [BatchLimit(5, 120, 8), BatchLimit(7, 60, 7), BatchLimit(3, 10_000, 50)])
def test_batches_match_a_loop(spark, limit):
    rng = random.Random(limit.max_bytes)
    sizes = {"long": [rng.randint(1, 70) for _ in range(300)], "short": [5, 200, 3], "one": [9]}
    df = spark.createDataFrame(
        [(s, i, n) for s, ns in sizes.items() for i, n in enumerate(ns)], "session_id string, seq bigint, len bigint")
    got = {s: sorted((r.first_seq, r.last_seq, r.events, r.bytes) for r in rows)
           for s, rows in _by_session(batch_bounds(df, limit)).items()}
    assert got == {s: greedy(ns, limit.max_events, limit.max_bytes) for s, ns in sizes.items()}


def test_batches_cover_the_input_and_stop_at_an_oversize_event(spark):
    df = spark.createDataFrame([("s", i, 10 if i != 7 else 500) for i in range(12)],
                               "session_id string, seq bigint, len bigint")
    rows = batches(df, BatchLimit(3, 100)).orderBy("first_seq").collect()
    covered = [seq for r in rows for seq in range(r.first_seq, r.last_seq + 1)]
    assert covered == list(range(12))
    assert [r.outcome for r in rows] == ["ready", "ready", "ready", "oversize", "not_reached", "not_reached"]
    assert not any(r.is_final for r in rows)
    resumed = batches(df.filter("seq > 7"), BatchLimit(3, 100)).orderBy("first_seq").collect()
    assert [(r.first_seq, r.last_seq, r.is_final) for r in resumed] == [(8, 10, False), (11, 11, True)]


def test_window_examples(spark):
    """Two writes 40 ms apart share a window; the rest follow the cap."""
    rule = Debounce(100, 500)
    df = spark.createDataFrame([("s", t) for t in (0, 40, 140, 239, 300, 399, 450, 520)],
                               "session_id string, t_ms bigint")
    rows = windows.window_bounds(windows.debounce(df, rule), rule).orderBy("window_start").collect()
    assert [(r.window_start, r.last_ms, r.closed_ms) for r in rows] == [(0, 40, 140), (140, 520, 620)]


def test_invalid_rules_are_refused():
    with pytest.raises(ValueError):
        Debounce(0, 10)
    with pytest.raises(ValueError):
        BatchLimit(0, 10)


def test_instants_are_combined(spark):
    touches = spark.createDataFrame([("s", 5)] * 50 + [("s", 6)], "session_id string, t_ms bigint")
    assert windows.instants(touches).agg(F.count(F.lit(1))).first()[0] == 2
