"""Activity windows with commands, overflow reports and path sets as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftlog.functions.values import operation_bit
from driftlog.operators.segments import Debounce
from driftlog.operators.windows import CLOSING_COMMANDS, DEFAULT_REPORTER, MAX_AUDIT_PATHS, MAX_OVERFLOW_REPORTS

_INPUT = (
    "session_id string, kind string, t_ms bigint, place bigint, pos bigint, path string, bit int, source string, raw_events bigint"
)
_OUTPUT = (
    "session_id string, window_start bigint, last_ms bigint, closed_ms bigint, kind string, place bigint, path string, "
    "operation_bits int, source string, raw_events bigint"
)
_CLOSED = Row(*[column.split(" ")[0] for column in _OUTPUT.split(", ")])
_WINDOW = "window_start bigint, last_ms bigint, raw_events bigint, paths bigint, reports bigint, limited boolean"


def activity_rows(
    touches: DataFrame, overflows: DataFrame | None = None, commands: DataFrame | None = None, ends: DataFrame | None = None
) -> DataFrame:
    """One stream of what opens, extends and closes windows: kept notifications
    with a row per path, overflow reports, commands, and ends of sessions."""

    def rows(df: DataFrame, kind: str, place: str | None, **columns: Column) -> DataFrame:
        made = {"t_ms": F.col("t_ms") if "t_ms" in df.columns else F.lit(None), "place": F.col(place) if place else F.lit(0)}
        made |= columns
        fields = [f.split(" ") for f in _INPUT.split(", ")]
        return df.select(
            "session_id", F.lit(kind).alias("kind"),
            *[made.get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in fields[2:]],
        )

    exploded = touches.select("session_id", "t_ms", "notif_id", "operation", F.posexplode("paths").alias("pos", "path"))
    parts = [rows(exploded, "touch", "notif_id", pos=F.col("pos"), path=F.col("path"), bit=operation_bit(F.col("operation")))]
    if overflows is not None:
        parts.append(rows(overflows, "overflow", "notif_id", source=F.col("source"), raw_events=F.col("raw_events")))
    if commands is not None:
        parts.append(rows(commands, "command", "command_id", source=F.col("command")))
    if ends is not None:
        parts.append(rows(ends, "end", None))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


class ActivityProcessor(StatefulProcessor):
    """One open window per session, with its paths and overflow reports.

    Rows of a trigger are taken in the order of time, commands first.  A closing
    command closes the open window at once; while a session is paused, deadlines
    do not fire.  An end closes what is open at its deadline, or without a
    closing time if a pause holds it.  A row older than the open window joins
    it; none is dropped.

    Paths and reports stand in map and list state, so a trigger reads and
    writes only the paths it touches.  A window keeps its first ``max_paths``
    paths, known ones go on gaining operations, and reports a limit once; of its
    reports it keeps ``max_reports``, the last of which says so.
    """

    def __init__(self, rule: Debounce, max_paths: int, max_reports: int, reporter: str):
        self.rule, self.max_paths, self.max_reports, self.reporter = rule, max_paths, max_reports, reporter

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", _WINDOW)
        self.pause = handle.getValueState("pause", "from_ms bigint")
        self.paths = handle.getMapState("paths", "path string", "bits int, t_ms bigint, place bigint, pos bigint")
        self.reports = handle.getListState("reports", "source string, raw_events bigint")

    # ------------------------------------------------------------ the walk

    def _deadline(self, window: list) -> int:
        return min(window[0] + self.rule.max_delay_ms, window[1] + self.rule.quiescence_ms)

    def _walk(self, marks: list[tuple], window: list | None, paused: int | None, ended: bool):
        """Windows in order, each [start, last, closed or None, is closed], and
        the window number of every instant; number 0 is the one in the state."""
        found = [window] if window else []
        open_ = window
        of: dict[int, int] = {}
        for t_ms, is_instant, command in marks:
            if open_ is not None:
                due = self._deadline(open_)
                if due <= t_ms and (paused is None or due < paused):
                    open_[2:] = [due, True]
                    open_ = None
            if is_instant:
                if open_ is None:
                    open_ = [t_ms, t_ms, None, False]
                    found.append(open_)
                open_[1] = max(open_[1], t_ms)
                of[t_ms] = len(found) - 1
            elif command == "pause":
                paused = t_ms if paused is None else paused
            elif command in CLOSING_COMMANDS:
                if open_ is not None:
                    open_[2:] = [t_ms, True]
                    open_ = None
                if command == "resume":
                    paused = None
        if ended and open_ is not None:
            due = self._deadline(open_)
            open_[2:] = [due if paused is None or due < paused else None, True]
        return found, of, paused

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        commands: list[Row] = []
        touches: list[Row] = []
        overflows: list[Row] = []
        ended = False
        for row in rows:
            if row.kind == "touch":
                touches.append(row)
            elif row.kind == "overflow":
                overflows.append(row)
            elif row.kind == "command":
                commands.append(row)
            else:
                ended = True
        instants = {row.t_ms for row in touches} | {row.t_ms for row in overflows}
        marks = [(row.t_ms, 0, row.source) for row in sorted(commands, key=lambda r: (r.t_ms, r.place is None, r.place or 0))]
        marks += [(t_ms, 1, None) for t_ms in instants]
        marks.sort(key=lambda m: m[:2])

        kept = self.window.get()
        was_paused = self.pause.get()
        before = [kept[0], kept[1], None, False] if kept else None
        found, of, paused = self._walk(marks, before, was_paused[0] if was_paused else None, ended)
        # Rows are dealt to their windows once, in their order.
        own: list[tuple[list[Row], list[Row]]] = [([], []) for _ in found]
        for row in sorted(touches, key=lambda r: (r.t_ms, r.place is None, r.place or 0, r.pos)):
            own[of[row.t_ms]][0].append(row)
        for row in sorted(overflows, key=lambda r: (r.t_ms, r.place is None, r.place or 0)):
            own[of[row.t_ms]][1].append(row)
        for number, (window, (paths, reports)) in enumerate(zip(found, own, strict=True)):
            stored = number == 0 and kept is not None
            held = kept if stored else (None, None, 0, 0, 0, False)
            for values in self._advance(key[0], window, paths, reports, held, stored):
                yield _CLOSED(*values)
        if paused is not None:
            self.pause.update((paused,))
        elif was_paused:
            self.pause.clear()
        if kept and (not found or found[-1][3]):
            self.window.clear()

    # --------------------------------------------------------- the contents

    def _advance(
        self, session: str, window: list, touches: list[Row], overflows: list[Row], held: tuple, stored: bool
    ) -> list[tuple]:
        """Add a trigger's rows to a window; its output if it is closed."""
        start, last, closed_ms, closed = window
        raw = int(held[2]) + sum(row.pos == 0 for row in touches)
        count, limited = int(held[3]), bool(held[5])
        fresh: dict[str, list] = {}
        for row in touches:
            entry = fresh.get(row.path)
            if entry is None:
                known = self.paths.getValue((row.path,)) if stored else None
                if known is None and count >= self.max_paths:
                    limited = True
                    continue
                count += known is None
                entry = fresh[row.path] = list(known) if known else [0, row.t_ms, row.place, row.pos]
            entry[0] |= row.bit

        reports, added = int(held[4]), []
        for row in overflows:
            if reports < self.max_reports:
                last_one = reports == self.max_reports - 1
                added.append((f"{self.reporter}:overflow_report_limit:{self.max_reports}" if last_one else row.source, row.raw_events))
                reports += 1

        if not closed:
            # A window that closes leaves no paths and reports behind.
            for path, entry in fresh.items():
                self.paths.updateValue((path,), tuple(entry))
            if added:
                self.reports.appendList(added)
            self.window.update((start, last, raw, count, reports, limited))
            return []

        paths = {k[0]: list(v) for k, v in self.paths.iterator()} if stored else {}
        paths |= fresh
        listed = [tuple(r) for r in self.reports.get()] if stored and held[4] else []
        if stored:
            self.paths.clear()
            self.reports.clear()
        head = (session, start, last, closed_ms)
        rows = [(*head, "window", count, None, None, None, raw)]
        if limited:
            rows.append((*head, "overflow", -1, None, None, f"{self.reporter}:audit_path_limit:{self.max_paths}", raw))
        rows += [(*head, "overflow", i, None, None, source, n) for i, (source, n) in enumerate(listed + added)]
        order = sorted(paths.items(), key=lambda item: item[1][1:])
        rows += [(*head, "path", i, path, entry[0], None, None) for i, (path, entry) in enumerate(order)]
        return rows

    def close(self) -> None:
        pass


def activity_stream(
    rows: DataFrame,
    rule: Debounce = Debounce(),
    max_paths: int = MAX_AUDIT_PATHS,
    max_reports: int = MAX_OVERFLOW_REPORTS,
    reporter: str = DEFAULT_REPORTER,
) -> DataFrame:
    """Closed windows of a stream of ``activity_rows``: for each a row of kind
    ``window`` with its raw events and kept paths, and rows of kind ``overflow``
    and ``path`` in their order.

    On rows that come in time order this equals ``windows.debounce`` with
    commands, ``cap_paths`` and ``cap_overflows``.
    """
    return rows.groupBy("session_id").transformWithState(
        statefulProcessor=ActivityProcessor(rule, max_paths, max_reports, reporter),
        outputStructType=_OUTPUT,
        outputMode="Append",
        timeMode="None",
    )
