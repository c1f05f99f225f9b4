"""Stream processors on sessions with many windows, without a frame per key."""

from __future__ import annotations

import time

from pyspark.sql import Row

from driftlog.operators.segments import Debounce
from driftlog.streaming.activity import ActivityProcessor
from driftlog.streaming.windows import DebounceProcessor


class Value:
    def __init__(self):
        self.now, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return self.now is not None

    def get(self):
        self.calls += 1
        return self.now

    def update(self, value):
        self.calls += 1
        self.now = value

    def clear(self):
        self.calls += 1
        self.now = None


class Handle:
    def __init__(self):
        self.made = []

    def _new(self, *_):
        self.made.append(Value())
        return self.made[-1]

    getValueState = getMapState = getListState = _new


def test_a_session_with_many_windows_takes_linear_time():
    touch = Row("session_id", "kind", "t_ms", "place", "pos", "path", "bit", "source", "raw_events")
    processor, handle = ActivityProcessor(Debounce(10, 100), 2, 2, "r"), Handle()
    processor.init(handle)
    many = [touch("s", "touch", 1_000 * i, i, 0, f"p{i % 3}", 1, None, None) for i in range(20_000)]
    many.append(touch("s", "end", None, 0, None, None, None, None, None))
    began = time.monotonic()
    got = list(processor.handleInputRows(("s",), iter(many), None))
    assert time.monotonic() - began < 10
    assert [r.window_start for r in got if r.kind == "window"] == [1_000 * i for i in range(20_000)]
    assert [(r.path, r.operation_bits) for r in got if r.kind == "path"][:2] == [("p0", 1), ("p1", 1)]
    # Nothing is open before or after, so the state is only asked for.
    assert sum(state.calls for state in handle.made) == 2


def test_debounce_asks_its_state_once():
    touch = Row("session_id", "t_ms", "is_end")
    processor, handle = DebounceProcessor(Debounce(10, 100)), Handle()
    processor.init(handle)
    many = [touch("s", 1_000 * (i // 2), False) for i in range(40_000)] + [touch("s", None, True)]
    got = list(processor.handleInputRows(("s",), iter(many), None))
    assert [(r.window_start, r.closed_ms, r.raw_events) for r in got[-2:]] == [(19_998_000, 19_998_010, 2), (19_999_000, 19_999_010, 2)]
    assert len(got) == 20_000 and sum(state.calls for state in handle.made) == 1
