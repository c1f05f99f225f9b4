"""Notifications to activity windows, captures and an assembled timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlog.functions.paths import ALWAYS_IGNORED, recorded_paths
from driftlog.functions.values import operation_bit, operations_of, touch_operation
from driftlog.operators.ordered import attach_facts, ordered_scan, smallest_per_group, time_chunk
from driftlog.operators.segments import Debounce, debounce_instants
from driftlog.session import save_and_reload

MAX_AUDIT_PATHS = 100_000
MAX_OVERFLOW_REPORTS = 64
# Commands that capture what is pending at once.
CLOSING_COMMANDS = ("snap", "mark", "flush", "resume", "shutdown")
# Names the program that reports its own limits in overflow sources.
DEFAULT_REPORTER = "recorder"


def observe(
    notifications: DataFrame,
    root: str | Column = "/",
    excluded: tuple[str, ...] | Column = (),
    ignores: tuple[str, ...] | list[str] | tuple[Column, Column] = ALWAYS_IGNORED,
) -> DataFrame:
    """Notifications that touch a recorded path, with the surviving paths.

    One row per kept notification, so ``count(*)`` is the raw event count.
    """
    kept = recorded_paths(F.col("paths"), root, excluded, ignores)
    # A one-element explode evaluates the paths once and drops empty ones; a
    # filter on their size would be pushed below and evaluate them again.
    once = F.explode(F.filter(F.array(kept), lambda survivors: F.size(survivors) > 0))
    return notifications.filter(
        F.col("error").isNull() & ~F.col("kind").eqNullSafe(F.lit("access"))
    ).select(
        "session_id",
        "notif_id",
        "t_ms",
        touch_operation(F.col("kind"), F.col("rename_mode")).alias("operation"),
        once.alias("paths"),
    )


def observe_sessions(notifications: DataFrame, filters: DataFrame) -> DataFrame:
    """``observe`` with the root, exclusions and ignores of each session, see
    ``paths.session_filters``.  Sessions without usable filters record nothing."""
    usable = filters.filter("error is null").drop("error")
    known = attach_facts(notifications, usable, ["session_id"], F.col("notif_id"), how="inner")
    return observe(known, F.col("root"), F.col("excluded"), (F.col("expression"), F.col("names")))


def overflow_reports(notifications: DataFrame) -> DataFrame:
    """Rescan requests (one raw event) and backend errors (none); each needs
    a full scan."""
    return notifications.filter(F.col("need_rescan") | F.col("error").isNotNull()).select(
        "session_id",
        "notif_id",
        "t_ms",
        F.when(F.col("error").isNotNull(), F.concat(F.lit("notify:"), F.col("error")))
        .otherwise("notify:rescan")
        .alias("source"),
        F.when(F.col("error").isNotNull(), 0).otherwise(1).cast("bigint").alias("raw_events"),
    )


def instants(touches: DataFrame, overflows: DataFrame | None = None) -> DataFrame:
    """Distinct (session_id, t_ms) that open or extend a window."""
    rows = touches.select("session_id", "t_ms")
    if overflows is not None:
        rows = rows.unionByName(overflows.select("session_id", "t_ms"))
    return rows.distinct()


def debounce(
    touches: DataFrame,
    rule: Debounce = Debounce(),
    overflows: DataFrame | None = None,
    commands: DataFrame | None = None,
) -> DataFrame:
    """Assign every instant to its window.

    Returns session_id, t_ms, window_start and, for the closing time, the
    next closing command, the next pause and the running pause.  ``commands``
    has session_id, command_id, t_ms, command; an instant at the time of a
    command belongs to the window after it.
    """
    moments = instants(touches, overflows)
    if commands is None:
        plain = moments.select(
            "session_id", "t_ms", F.col("t_ms").alias("eff_ms"), F.lit(0).cast("bigint").alias("epoch")
        )
        nothing = F.lit(None).cast("bigint")
        return debounce_instants(plain, rule).select(
            "*",
            nothing.alias("next_close"),
            nothing.alias("next_pause"),
            nothing.alias("paused_from"),
        )

    switches = commands.filter(F.col("command").isin("pause", "resume"))
    effective = ordered_scan(
        switches.select("session_id", "t_ms", "command_id", "command"),
        ["session_id"],
        ["t_ms", "command_id"],
        time_chunk("t_ms", rule.chunk_ms),
        prev={"before": F.col("command")},
    ).filter((F.col("command") == "pause") & ~F.col("before").eqNullSafe(F.lit("pause")))

    def marker(df: DataFrame, order: int, close: Column, pause: Column) -> DataFrame:
        return df.select(
            "session_id",
            "t_ms",
            F.lit(order).alias("place"),
            "command_id",
            close.alias("close"),
            pause.alias("pause"),
        )

    no = F.lit(False)
    marks = (
        marker(commands.filter(F.col("command").isin(*CLOSING_COMMANDS)), 0,
               F.lit(True), F.when(F.col("command") == "resume", F.lit(False)))
        .unionByName(marker(effective, 0, no, F.lit(True)))
        .unionByName(marker(moments.withColumn("command_id", F.lit(0).cast("bigint")), 1,
                            no, F.lit(None).cast("boolean")))
    )
    placed = ordered_scan(
        marks,
        ["session_id"],
        ["t_ms", "place", "command_id", "close"],
        time_chunk("t_ms", rule.chunk_ms),
        sums={"epoch": F.col("close").cast("bigint")},
        last={"pause_mark": F.when(F.col("pause"), F.col("t_ms")).when(~F.col("pause"), F.lit(-1))},
        upcoming={
            "next_close": F.when(F.col("close"), F.col("t_ms")),
            "next_pause": F.when(F.col("pause"), F.col("t_ms")),
        },
    ).filter(F.col("place") == 1)
    paused_from = F.when(F.col("pause_mark") >= 0, F.col("pause_mark"))
    prepared = placed.select(
        "session_id",
        "t_ms",
        # A deadline inside a pause does not fire before the pause ends.
        F.coalesce(paused_from - 1, F.col("t_ms")).alias("eff_ms"),
        "epoch",
        "next_close",
        "next_pause",
        paused_from.alias("paused_from"),
    )
    # The passes of the segmenter read their input more than once.
    prepared = save_and_reload(prepared, "instants")
    return debounce_instants(prepared, rule, ("next_close", "next_pause", "paused_from"))


def window_bounds(assigned: DataFrame, rule: Debounce) -> DataFrame:
    """One row per window: first and last instant and when it was closed
    (NULL while it is still held open by a pause)."""
    windows = assigned.groupBy("session_id", "window_start").agg(
        F.max("t_ms").alias("last_ms"),
        F.count(F.lit(1)).alias("instants"),
        # The command columns of the last instant: later instants never have
        # an earlier next command, and a pause only ends at a command.
        F.max("next_close").alias("next_close"),
        F.max_by("next_pause", "t_ms").alias("next_pause"),
        F.max_by("paused_from", "t_ms").alias("paused_from"),
    )
    deadline = F.least(
        F.col("window_start") + rule.max_delay_ms, F.col("last_ms") + rule.quiescence_ms
    )
    held = (F.col("paused_from").isNotNull() & (deadline >= F.col("paused_from"))) | (
        F.col("paused_from").isNull()
        & F.col("next_pause").isNotNull()
        & (F.col("next_pause") <= deadline)
        & (F.col("next_close").isNull() | (F.col("next_pause") < F.col("next_close")))
    )
    return windows.select(
        "session_id",
        "window_start",
        "last_ms",
        "instants",
        F.when(held, F.col("next_close"))
        .otherwise(F.least(deadline, F.col("next_close")))
        .alias("closed_ms"),
    )


def in_windows(rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """Attach window_start to rows with session_id and t_ms."""
    return rows.join(
        assigned.select("session_id", "t_ms", "window_start"), ["session_id", "t_ms"]
    )


def window_paths(windowed: DataFrame) -> DataFrame:
    """Path level of a window: its operation set, when it was first seen and
    the raw notifications counted at it (each one at its first path)."""
    exploded = windowed.select(
        "session_id",
        "window_start",
        "t_ms",
        "notif_id",
        operation_bit(F.col("operation")).alias("bit"),
        F.posexplode("paths").alias("pos", "path"),
    )
    return exploded.groupBy("session_id", "window_start", "path").agg(
        F.bit_or("bit").alias("operation_bits"),
        F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).cast("bigint").alias("raw_events"),
        F.min(F.struct("t_ms", "notif_id", "pos")).alias("first_seen"),
        F.max("t_ms").alias("last_ms"),
    )


def aggregate_windows(paths: DataFrame) -> DataFrame:
    """Window level: paths, raw events, start and end of the observation."""
    return paths.groupBy("session_id", "window_start").agg(
        F.count(F.lit(1)).alias("paths"),
        F.sum("raw_events").alias("raw_events"),
        F.bit_or("operation_bits").alias("operation_bits"),
        F.min("first_seen.t_ms").alias("started_ms"),
        F.max("last_ms").alias("ended_ms"),
    )


def cap_paths(
    paths: DataFrame, limit: int, reporter: str = DEFAULT_REPORTER
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ``limit`` first-seen paths of each window with their full operation
    sets, a report of each window that had more, and the paths cut off.

    A recorder uses ``MAX_AUDIT_PATHS``.  The reported raw count covers all
    notifications of the window.
    """
    kept = smallest_per_group(
        paths, ["session_id", "window_start"], ["first_seen", "path"], limit
    )
    reports = (
        aggregate_windows(paths)
        .filter(F.col("paths") > limit)
        .select(
            "session_id",
            "window_start",
            F.lit(f"{reporter}:audit_path_limit:{limit}").alias("source"),
            "raw_events",
        )
    )
    cut = paths.join(kept.select("session_id", "window_start", "path"), ["session_id", "window_start", "path"], "left_anti")
    return kept, reports, cut


def cap_overflows(
    reports: DataFrame, limit: int, reporter: str = DEFAULT_REPORTER
) -> tuple[DataFrame, DataFrame]:
    """The first ``limit - 1`` reports of a window, then one limit report that
    keeps its own raw count; and the reports cut off.  A recorder uses
    ``MAX_OVERFLOW_REPORTS``."""
    kept = smallest_per_group(
        reports, ["session_id", "window_start"], ["t_ms", "notif_id"], limit, rank="place"
    ).withColumn(
        "source",
        F.when(
            F.col("place") == limit - 1, F.lit(f"{reporter}:overflow_report_limit:{limit}")
        ).otherwise(F.col("source")),
    )
    keys = ["session_id", "window_start", "t_ms", "notif_id"]
    return kept, reports.join(kept.select(*keys), keys, "left_anti")


def full_scan_windows(reports: DataFrame) -> DataFrame:
    """Windows whose capture must not trust unchanged file state."""
    return reports.groupBy("session_id", "window_start").agg(
        F.count(F.lit(1)).alias("overflows"),
        F.sum("raw_events").alias("overflow_raw"),
        F.lit(True).alias("full_scan"),
    )


def merge_windows(*parts: DataFrame) -> DataFrame:
    """Union of path-level batches that share session_id and window_start:
    sets are united, starts take the earliest, raw counts add up."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("session_id", "window_start", "path").agg(
        F.bit_or("operation_bits").alias("operation_bits"),
        F.sum("raw_events").alias("raw_events"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_ms").alias("last_ms"),
    )


def dirty_sessions(windows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Sessions with a window no snapshot covers yet."""
    return (
        windows.join(
            snapshots.select("session_id", "window_start"), ["session_id", "window_start"], "left_anti"
        )
        .groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("dirty_windows"), F.min("window_start").alias("dirty_since"))
    )


def touched_events(paths: DataFrame, limit: int = MAX_AUDIT_PATHS, capped: bool = False) -> DataFrame:
    """The first ``limit`` paths of each window as one array, sorted by path.

    An array is one row, so it is always bounded; with ``capped`` the paths come
    from ``cap_paths`` and are not ranked again.
    """
    keys = ["session_id", "window_start"]
    if not capped:
        paths = smallest_per_group(paths, keys, ["first_seen", "path"], limit)
    entry = F.struct("path", operations_of(F.col("operation_bits")).alias("operations"))
    return paths.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("paths"))


def ordered_events(
    sessions: DataFrame,
    windows: DataFrame,
    overflows: DataFrame,
    commands: DataFrame,
    chunk_ms: int | None = None,
) -> DataFrame:
    """Events of all sessions in emission order with contiguous seq, without
    bodies: session_id, seq, type, at_ms, window_start, command_id, capture,
    detail, raw_events, op and snapshots, the number of snapshots so far.

    ``sessions``   session_id, opened_ms
    ``windows``    session_id, window_start, closed_ms, touched_raw (NULL for
                   a window that only saw overflows)
    ``overflows``  session_id, window_start, closed_ms, place, source, raw_events
    ``commands``   session_id, command_id, t_ms, command

    A capture emits its overflows, then touched_paths, then the snapshot; a
    command follows the captures it waited for; start comes first and a
    shutdown is an end followed by a flush.
    """
    text, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")

    def rows(df: DataFrame, kind: str, at: Column, phase: int, place: Column,
             step: Column = F.lit(0), detail: Column = text, raw: Column = number,
             capture: Column = text, window: Column = number, command: Column = number) -> DataFrame:
        return df.select(
            "session_id",
            F.lit(kind).alias("type"),
            at.cast("bigint").alias("at_ms"),
            F.lit(phase).alias("phase"),
            place.cast("bigint").alias("place"),
            step.cast("int").alias("step"),
            detail.alias("detail"),
            raw.cast("bigint").alias("raw_events"),
            capture.alias("capture"),
            window.alias("window_start"),
            command.alias("command_id"),
        )

    closed = windows.filter(F.col("closed_ms").isNotNull())
    captured = F.concat(F.lit("w"), F.col("window_start").cast("string"))
    snaps = commands.filter(F.col("command") == "snap")
    idle_snaps = snaps.join(
        closed.select("session_id", F.col("closed_ms").alias("t_ms")).distinct(),
        ["session_id", "t_ms"],
        "left_anti",
    )
    command_at = (F.col("t_ms"), 3, F.col("command_id"))
    named = {"command": F.col("command_id")}
    events = (
        rows(sessions, "session_start", F.coalesce(F.col("opened_ms"), F.lit(0)), -1, F.lit(0),
             capture=F.lit("baseline"))
        .unionByName(rows(overflows.filter(F.col("closed_ms").isNotNull()), "overflow",
                          F.col("closed_ms"), 0, F.col("place"), detail=F.col("source"),
                          raw=F.col("raw_events")))
        .unionByName(rows(closed.filter(F.col("touched_raw").isNotNull()), "touched_paths",
                          F.col("closed_ms"), 1, F.lit(0), raw=F.col("touched_raw"), window=F.col("window_start")))
        .unionByName(rows(closed, "snapshot", F.col("closed_ms"), 2, F.lit(0), capture=captured,
                          window=F.col("window_start")))
        .unionByName(rows(idle_snaps, "snapshot", *command_at,
                          capture=F.concat(F.lit("s"), F.col("command_id").cast("string"))))
        .unionByName(rows(commands.filter(F.col("command") == "mark"), "mark", *command_at, **named))
        .unionByName(rows(commands.filter(F.col("command") == "flush"), "flush", *command_at, **named))
        .unionByName(rows(commands.filter(F.col("command") == "shutdown"), "session_end", *command_at, **named))
        .unionByName(rows(commands.filter(F.col("command") == "shutdown"), "flush", *command_at,
                          step=F.lit(1), **named))
    )
    op = F.when(
        F.col("capture").isNotNull(),
        F.concat(F.lit("op:"), F.sha2(F.concat_ws(":", "session_id", "capture"), 256)),
    )
    is_start = (F.col("type") != "session_start").cast("int")
    return ordered_scan(
        events.withColumn("started", is_start),
        ["session_id"],
        ["started", "at_ms", "phase", "place", "step", "type"],
        F.when(F.col("started") == 0, F.lit(-(1 << 40))).otherwise(time_chunk("at_ms", chunk_ms)),
        rank="seq",
        sums={"snapshots": (F.col("type") == "snapshot").cast("bigint")},
        last={"op": op},
    ).select(
        "session_id", "seq", "type", "at_ms", "window_start", "command_id", "capture", "detail", "raw_events",
        "op", "snapshots",
    )


def assemble(
    sessions: DataFrame,
    windows: DataFrame,
    overflows: DataFrame,
    commands: DataFrame,
    chunk_ms: int | None = None,
) -> DataFrame:
    """``ordered_events`` without references; ``assembly.assemble_typed`` adds
    the bodies."""
    return ordered_events(sessions, windows, overflows, commands, chunk_ms).select(
        "session_id", "seq", "type", "at_ms", "detail", "raw_events", "op", "snapshots"
    )
