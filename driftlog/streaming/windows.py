"""Capped debounce as a stateful stream."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftlog.operators.segments import Debounce

_OUTPUT = "session_id string, window_start bigint, last_ms bigint, closed_ms bigint, raw_events bigint"
_CLOSED = Row(*[column.split(" ")[0] for column in _OUTPUT.split(", ")])
_STATE = "window_start bigint, last_ms bigint, raw_events bigint"


class DebounceProcessor(StatefulProcessor):
    """One open window per session.

    A row at or after the deadline closes the window and opens the next one; a
    row with ``is_end`` closes the session's open window after the other rows
    that came with it.  A row older than the open window joins it, and one that
    finds none opens the next: a closed window is never reopened and no row is
    lost.  With ``idle_ms`` a window also closes when no row came for so long.
    """

    def __init__(self, rule: Debounce, idle_ms: int | None = None):
        self.rule = rule
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", _STATE)

    def _deadline(self, window: list) -> int:
        return min(window[0] + self.rule.max_delay_ms, window[1] + self.rule.quiescence_ms)

    def _closed(self, session: str, window: list) -> Row:
        return _CLOSED(session, window[0], window[1], self._deadline(window), window[2])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # Rows are folded to counts per instant while they arrive.
        counts: Counter[int] = Counter()
        ended = False
        for row in rows:
            if row.is_end:
                ended = True
            elif row.t_ms is not None:
                counts[row.t_ms] += 1
        kept = self.state.get()
        window = list(kept) if kept else None
        for t_ms in sorted(counts):
            if window is not None and t_ms >= self._deadline(window):
                yield self._closed(key[0], window)
                window = None
            if window is None:
                window = [t_ms, t_ms, 0]
            window[1] = max(window[1], t_ms)
            window[2] += counts[t_ms]
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if window is not None and ended:
            yield self._closed(key[0], window)
            window = None
        if window is not None:
            self.state.update(tuple(window))
            if self.idle_ms is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        elif kept:
            self.state.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        kept = self.state.get()
        if kept:
            yield self._closed(key[0], list(kept))
            self.state.clear()

    def close(self) -> None:
        pass


def debounce_stream(touches: DataFrame, rule: Debounce = Debounce(), idle_ms: int | None = None) -> DataFrame:
    """Closed windows of a stream of kept notifications (session_id, t_ms) and,
    where a column ``is_end`` is true, ends of sessions.

    There is no watermark, because rows behind one would be dropped.
    """
    end = F.coalesce("is_end", F.lit(False)) if "is_end" in touches.columns else F.lit(False)
    return touches.select("session_id", "t_ms", end.alias("is_end")).groupBy("session_id").transformWithState(
        statefulProcessor=DebounceProcessor(rule, idle_ms),
        outputStructType=_OUTPUT,
        outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )
