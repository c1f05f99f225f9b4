"""Validation of recorded timelines: readers, spools, viewers, measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlog.functions.values import operation_rank, safe_object_path
from driftlog.operators.ordered import attach_facts, first_per_group, ordered_scan, seq_chunk
from driftlog.schemas import (
    DEFAULT_EVENTS_OBJECT,
    MAX_SAFE_INTEGER,
    REQUIRED,
    SCHEMA_VERSION,
    SESSION_FORMAT,
)

# --------------------------------------------------------------------------
# JSON kinds
# --------------------------------------------------------------------------


def with_event(lines: DataFrame) -> DataFrame:
    """Add ``event``, the JSON value of a line, or NULL when the line is not
    exactly one value.  The line is parsed once, as a one-element array: the
    parser alone would ignore text after the first value."""
    return (
        lines.withColumn("_array", F.try_parse_json(F.concat(F.lit("["), F.col("value"), F.lit("]"))))
        .withColumn(
            "event",
            F.when(
                F.try_variant_get("_array", "$[1]", "variant").isNull(),
                F.try_variant_get("_array", "$[0]", "variant"),
            ),
        )
        .drop("_array")
    )


def _kind(variant: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(variant, path, "variant"))


def _is_text(variant: Column, path: str) -> Column:
    return F.coalesce(_kind(variant, path) == "STRING", F.lit(False))


def _is_unsigned(variant: Column, path: str) -> Column:
    return F.coalesce(
        (_kind(variant, path) == "BIGINT") & (F.try_variant_get(variant, path, "bigint") >= 0),
        F.lit(False),
    )


def _is_object(variant: Column, path: str) -> Column:
    return F.coalesce(_kind(variant, path).startswith("OBJECT"), F.lit(False))


def _is_strings(variant: Column, path: str) -> Column:
    kind = _kind(variant, path)
    empty = F.size(F.try_variant_get(variant, path, "array<string>")) == 0
    return F.coalesce((kind == "ARRAY<STRING>") | (kind.startswith("ARRAY") & empty), F.lit(False))


def _is_optional(variant: Column, path: str, kind: str) -> Column:
    return F.coalesce(_kind(variant, path).isin("VOID", kind), F.lit(True))


def _every(variant: Column, path: str, check) -> Column:
    is_array = F.coalesce(_kind(variant, path).startswith("ARRAY"), F.lit(False))
    return is_array & F.coalesce(
        F.forall(F.try_variant_get(variant, path, "array<variant>"), check), F.lit(True)
    )


def _is_change(change: Column) -> Column:
    return (
        _is_text(change, "$.path")
        & F.coalesce(
            F.try_variant_get(change, "$.kind", "string").isin(
                "added", "removed", "modified", "renamed", "mode_changed"
            ),
            F.lit(False),
        )
        & _is_optional(change, "$.blob", "STRING")
        & _is_optional(change, "$.prev_blob", "STRING")
        & _is_optional(change, "$.from", "STRING")
        & _is_optional(change, "$.bytes", "BIGINT")
    )


def _is_touch(touch: Column) -> Column:
    return _is_text(touch, "$.path") & _every(
        touch,
        "$.operations",
        lambda op: F.coalesce(
            operation_rank(F.try_variant_get(op, "$", "string")) > 0, F.lit(False)
        ),
    )


def _field_ok(variant: Column, path: str, kind: str) -> Column:
    if kind == "string":
        return _is_text(variant, path)
    if kind == "unsigned":
        return _is_unsigned(variant, path)
    if kind == "boolean":
        return F.coalesce(_kind(variant, path) == "BOOLEAN", F.lit(False))
    if kind == "object?":
        return _kind(variant, path).isNull() | _is_object(variant, path)
    if kind == "strings":
        return _is_strings(variant, path)
    if kind == "changes":
        return _every(variant, path, _is_change)
    if kind == "paths":
        return _every(variant, path, _is_touch)
    if kind == "stats":
        ok = F.lit(True)
        for name in ("added", "removed", "modified", "renamed", "mode_changed"):
            ok = ok & _is_unsigned(variant, f"{path}.{name}")
        return ok
    if kind == "recovery":
        return F.coalesce(
            F.try_variant_get(variant, path, "string") == "full_scan_snapshot", F.lit(False)
        )
    raise ValueError(kind)


def strict_event(variant: Column, start_fields: Sequence[str] = ()) -> Column:
    """Does the value have the envelope and the body its type requires?
    Unknown fields are ignored; an unknown type is not an event.

    ``start_fields`` are further text fields that a producer's session_start
    must have, as its version strings.
    """
    envelope = (
        _is_unsigned(variant, "$.v")
        & (F.try_variant_get(variant, "$.v", "bigint") <= 255)
        & _is_unsigned(variant, "$.seq")
        & _is_text(variant, "$.session_id")
        & _is_text(variant, "$.ts")
        & _is_text(variant, "$.type")
    )
    kind = F.try_variant_get(variant, "$.type", "string")
    body = F.lit(False)
    for name, fields in REQUIRED.items():
        ok = F.lit(True)
        extra = dict.fromkeys(start_fields, "string") if name == "session_start" else {}
        for field, expected in {**fields, **extra}.items():
            ok = ok & _field_ok(variant, f"$.data.{field}", expected)
        body = F.when(kind == name, ok).otherwise(body)
    return F.coalesce(envelope & body, F.lit(False))


# --------------------------------------------------------------------------
# Per-line ladders
# --------------------------------------------------------------------------


def number_records(lines: DataFrame, blank: Column) -> DataFrame:
    """Add rec_no, the number of non-blank lines before each line, to
    ``lines`` (file, line_no, value).  Lines of one file may be very many, so
    the count runs per line chunk."""
    return ordered_scan(
        lines.withColumn("blank", blank),
        ["file"],
        ["line_no"],
        seq_chunk("line_no"),
        sums={"through": (~F.col("blank")).cast("bigint")},
    ).select(
        *lines.columns,
        "blank",
        (F.col("through") - (~F.col("blank")).cast("bigint")).alias("rec_no"),
    )


def _records(lines: DataFrame, whitespace_is_blank: bool) -> DataFrame:
    blank = F.trim(F.regexp_replace("value", r"\s", "")) == "" if whitespace_is_blank else (
        F.col("value") == ""
    )
    if "rec_no" in lines.columns:
        numbered = lines.withColumn("blank", blank)
    else:
        numbered = number_records(lines, blank)
    event = F.col("event")
    return (
        with_event(numbered.filter(~F.col("blank")))
        .select(
            "file",
            "line_no",
            "rec_no",
            event,
            F.when(_is_text(event, "$.session_id"), F.try_variant_get(event, "$.session_id", "string"))
            .alias("session_id"),
            F.when(_kind(event, "$.seq") == "BIGINT", F.try_variant_get(event, "$.seq", "bigint"))
            .alias("seq"),
            F.when(_kind(event, "$.v") == "BIGINT", F.try_variant_get(event, "$.v", "bigint"))
            .alias("version"),
        )
    )


def _with_first_session(records: DataFrame) -> DataFrame:
    first = (
        records.filter(F.col("rec_no") == 0)
        .select("file", F.col("session_id").alias("first_session"))
    )
    return attach_facts(records, first, ["file"], F.col("line_no"))


def _verdicts(files: DataFrame, failures: DataFrame) -> DataFrame:
    first = first_per_group(
        failures.filter(F.col("error_class").isNotNull()),
        ["file"],
        ["place", "line_no"],
        ["error_class", "error_line", "expected", "actual"],
    )
    return files.join(first, "file", "left").select(
        "file",
        F.col("error_class").isNull().alias("ok"),
        "error_class",
        F.col("error_line").alias("line_no"),
        "expected",
        "actual",
    )


def _failure(records: DataFrame, ladder: list[tuple[str, Column, Column, Column]],
             line: Column, early: tuple[str, ...] = ()) -> DataFrame:
    """First failing check per row; ``early`` classes win over all others in
    the file, wherever they are."""
    error = expected = actual = None
    for name, bad, want, got in ladder:
        error = F.when(bad, name) if error is None else error.when(bad, name)
        expected = F.when(bad, want) if expected is None else expected.when(bad, want)
        actual = F.when(bad, got) if actual is None else actual.when(bad, got)
    return records.select(
        "file",
        "line_no",
        line.cast("bigint").alias("error_line"),
        error.alias("error_class"),
        expected.cast("string").alias("expected"),
        actual.cast("string").alias("actual"),
    ).withColumn("place", F.when(F.col("error_class").isin(*early), 0).otherwise(1) if early else F.lit(1))


def _none() -> Column:
    return F.lit(None).cast("string")


def _all_files(lines: DataFrame, files: DataFrame | None) -> DataFrame:
    seen = lines.select("file")
    return (seen if files is None else seen.union(files.select("file"))).distinct()


def validate_timeline(
    lines: DataFrame, files: DataFrame | None = None, start_fields: Sequence[str] = ()
) -> DataFrame:
    """Reader verdict per file: JSON, then version, sequence, session; the
    first failing line wins and blank lines are skipped but numbered.

    ``files`` (file) lists all files; an empty one has no line, and is a valid
    timeline without events.  ``start_fields``: see ``strict_event``.
    """
    records = _with_first_session(_records(lines, whitespace_is_blank=True))
    ladder = [
        ("json", ~strict_event(F.col("event"), start_fields), _none(), _none()),
        ("version", F.col("version") != SCHEMA_VERSION, _none(), F.col("version").cast("string")),
        ("sequence", F.col("seq") != F.col("rec_no"), F.col("rec_no").cast("string"),
         F.col("seq").cast("string")),
        ("session", F.col("session_id") != F.col("first_session"), F.col("first_session"),
         F.col("session_id")),
    ]
    files = _all_files(lines, files)
    return _verdicts(files, _failure(records, ladder, F.col("line_no")))


def validate_spool(lines: DataFrame, expected: DataFrame, start_fields: Sequence[str] = ()) -> DataFrame:
    """Spool verdict per file against ``expected`` (file, spool_session,
    spool_version, complete): the last line must end in a newline, only empty
    lines are skipped, and lines are numbered without them."""
    records = attach_facts(
        _records(lines, whitespace_is_blank=False),
        expected.select("file", "spool_session", "spool_version"),
        ["file"],
        F.col("line_no"),
    )
    ladder = [
        ("json", ~strict_event(F.col("event"), start_fields), _none(), _none()),
        ("sequence", F.col("seq") != F.col("rec_no"), F.col("rec_no").cast("string"),
         F.col("seq").cast("string")),
        ("session", F.col("session_id") != F.col("spool_session"), F.col("spool_session"),
         F.col("session_id")),
        ("version", F.col("version") != F.col("spool_version"),
         F.col("spool_version").cast("string"), F.col("version").cast("string")),
    ]
    failures = _failure(records, ladder, F.col("rec_no") + 1)
    cut_short = expected.filter(~F.col("complete")).select(
        "file",
        F.lit(0).cast("bigint").alias("line_no"),
        F.lit(None).cast("bigint").alias("error_line"),
        F.lit("incomplete").alias("error_class"),
        _none().alias("expected"),
        _none().alias("actual"),
        F.lit(0).alias("place"),
    )
    files = lines.select("file").union(expected.select("file")).distinct()
    return _verdicts(files, failures.unionByName(cut_short))


def validate_records(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Viewer verdict per file: all lines must parse before any record is
    checked; records are numbered without blank lines, from one.  ``files``
    lists all files, so that empty ones have a verdict too."""
    records = _with_first_session(_records(lines, whitespace_is_blank=True))
    event = F.col("event")
    ladder = [
        ("json", event.isNull(), _none(), _none()),
        ("record", ~_is_object(event, "$"), _none(), _none()),
        ("sequence_value", ~F.coalesce(F.col("seq").between(0, MAX_SAFE_INTEGER), F.lit(False)),
         _none(), _none()),
        ("sequence", F.col("seq") != F.col("rec_no"), F.col("rec_no").cast("string"),
         F.col("seq").cast("string")),
        ("session_missing", F.coalesce(F.col("session_id"), F.lit("")) == "", _none(), _none()),
        ("session", F.col("session_id") != F.col("first_session"), F.col("first_session"),
         F.col("session_id")),
    ]
    files = _all_files(lines, files)
    return _verdicts(files, _failure(records, ladder, F.col("rec_no") + 1, early=("json",)))


def validate_for_summary(lines: DataFrame, manifests: DataFrame) -> DataFrame:
    """Measurement verdict per file.  Line checks come first, then the stream
    against its manifest row (file, manifest_session, durable_seq), then the
    payload of touched_paths events."""
    records = _with_first_session(_records(lines, whitespace_is_blank=True))
    event = F.col("event")
    kind = F.try_variant_get(event, "$.type", "string")
    raw_kind, paths_kind = _kind(event, "$.data.raw_events"), _kind(event, "$.data.paths")
    paths = F.try_variant_get(event, "$.data.paths", "array<variant>")
    touched = F.coalesce(kind == "touched_paths", F.lit(False))

    def some(bad) -> Column:
        return touched & F.coalesce(F.exists(paths, bad), F.lit(False))

    line_ladder = [
        ("json", event.isNull(), _none(), _none()),
        ("record", ~_is_object(event, "$"), _none(), _none()),
        ("sequence", ~F.coalesce(F.col("seq") == F.col("rec_no"), F.lit(False)),
         F.col("rec_no").cast("string"), F.col("seq").cast("string")),
        ("session_missing", F.coalesce(F.col("session_id"), F.lit("")) == "", _none(), _none()),
        ("session", F.col("session_id") != F.col("first_session"), F.col("first_session"),
         F.col("session_id")),
        ("type", ~(_is_text(event, "$.type") & (kind != "")), _none(), _none()),
        ("data", ~_is_object(event, "$.data"), _none(), _none()),
    ]
    payload_ladder = [
        ("raw_events", touched & raw_kind.isNotNull() & ~_is_unsigned(event, "$.data.raw_events"),
         _none(), _none()),
        ("paths", touched & paths_kind.isNotNull() & ~paths_kind.startswith("ARRAY"),
         _none(), _none()),
        ("path_entry", some(lambda p: ~_is_object(p, "$")), _none(), _none()),
        ("path", some(lambda p: ~_is_text(p, "$.path")), _none(), _none()),
        ("operations", some(lambda p: _kind(p, "$.operations").isNotNull()
                            & ~_is_strings(p, "$.operations")), _none(), _none()),
    ]
    failures = _failure(records, line_ladder, F.col("line_no"))
    payload = _failure(records, payload_ladder, F.col("line_no")).withColumn("place", F.lit(3))
    streams = records.groupBy("file").agg(
        F.max("rec_no").alias("last_rec"), F.max("first_session").alias("stream_session")
    )
    against = manifests.join(streams, "file", "left").select(
        "file",
        F.lit(0).cast("bigint").alias("line_no"),
        F.lit(None).cast("bigint").alias("error_line"),
        F.when(F.col("last_rec").isNull(), "empty")
        .when(~F.col("stream_session").eqNullSafe(F.col("manifest_session")), "manifest_session")
        .when(F.col("last_rec") != F.col("durable_seq"), "durable")
        .alias("error_class"),
        F.when(F.col("last_rec").isNull(), _none())
        .when(~F.col("stream_session").eqNullSafe(F.col("manifest_session")), F.col("manifest_session"))
        .otherwise(F.col("durable_seq").cast("string"))
        .alias("expected"),
        F.when(F.col("last_rec").isNull(), _none())
        .when(~F.col("stream_session").eqNullSafe(F.col("manifest_session")), F.col("stream_session"))
        .otherwise(F.col("last_rec").cast("string"))
        .alias("actual"),
        F.lit(2).alias("place"),
    )
    return _verdicts(manifests.select("file"), failures.unionByName(against).unionByName(payload))


# --------------------------------------------------------------------------
# Manifests and durable visibility
# --------------------------------------------------------------------------


def compatible(manifests: DataFrame) -> DataFrame:
    """Manifests this reader understands."""
    return manifests.filter(
        (F.col("session_format") == SESSION_FORMAT) & (F.col("schema_version") == SCHEMA_VERSION)
    )


def open_sessions(sessions: DataFrame, manifests: DataFrame, timelines: DataFrame) -> DataFrame:
    """Verdict of opening each session.

    ``sessions``   session_id
    ``manifests``  session_id, parsed, session_format, schema_version,
                   durable_seq, events_object
    ``timelines``  session_id, events_object, ok, error_class, last_seq
    """
    objects = timelines.select(
        "session_id",
        F.col("events_object").alias("object"),
        F.col("ok").alias("timeline_ok"),
        F.col("error_class").alias("timeline_error"),
        F.col("last_seq").alias("end_seq"),
    )
    opened = (
        sessions.select("session_id")
        .join(manifests.withColumn("present", F.lit(True)), "session_id", "left")
        .withColumn("object", F.coalesce("events_object", F.lit(DEFAULT_EVENTS_OBJECT)))
        .join(objects, ["session_id", "object"], "left")
    )
    verdict = (
        F.when(F.col("present").isNull(), "missing_manifest")
        .when(~F.col("parsed"), "invalid_manifest")
        .when(
            (F.col("session_format") != SESSION_FORMAT) | (F.col("schema_version") != SCHEMA_VERSION),
            "incompatible",
        )
        .when(F.col("durable_seq").isNull(), "not_durable")
        .when(~safe_object_path(F.col("object")), "unsafe_object")
        .when(F.col("timeline_ok").isNull(), "missing_object")
        .when(~F.col("timeline_ok"), F.concat(F.lit("timeline_"), F.col("timeline_error")))
        .when(~F.col("end_seq").eqNullSafe(F.col("durable_seq")), "beyond_watermark")
        .otherwise("open")
    )
    return opened.select(
        "session_id",
        verdict.alias("verdict"),
        F.when(verdict == "beyond_watermark", F.coalesce("end_seq", F.lit(0)).cast("bigint"))
        .alias("requested_seq"),
        "durable_seq",
    )


def durable(timeline: DataFrame, manifests: DataFrame) -> DataFrame:
    """Events a reader may see: at or below the session's durable watermark."""
    marks = manifests.filter(F.col("durable_seq").isNotNull()).select("session_id", "durable_seq")
    return attach_facts(timeline, marks, ["session_id"], F.col("seq"), how="inner").filter(
        F.col("seq") <= F.col("durable_seq")
    )


def event_lookup(requests: DataFrame, timeline: DataFrame, manifests: DataFrame) -> DataFrame:
    """Look up (session_id, seq) requests behind the watermark; a refused
    request reports why."""
    marks = manifests.select("session_id", "durable_seq", F.lit(True).alias("known"))
    asked = attach_facts(requests, marks, ["session_id"], F.col("seq"))
    found = timeline.select("session_id", "seq", "type", F.lit(True).alias("found"))
    return asked.join(found, ["session_id", "seq"], "left").select(
        "session_id",
        "seq",
        F.when(F.col("known").isNull(), "missing_manifest")
        .when(F.col("durable_seq").isNull(), "not_durable")
        .when((F.col("seq") > F.col("durable_seq")) | F.col("found").isNull(), "beyond_watermark")
        .otherwise("found")
        .alias("outcome"),
        F.when((F.col("seq") <= F.col("durable_seq")), F.col("type")).alias("type"),
    )


# --------------------------------------------------------------------------
# Live continuity
# --------------------------------------------------------------------------

LAG_MESSAGE = "The live subscriber lagged and records may have been dropped."


def continuity_detail(
    valid: Column, lag: Column, prev_seq: Column, seq: Column, prev_session: Column, session: Column
) -> tuple[Column, Column]:
    """Notice type and text for an arrival, given the one before; NULL when
    it continues the stream.  ``lag`` holds a lag marker's message."""
    session_changed = prev_session.isNotNull() & (session != prev_session)
    gap = prev_seq.isNotNull() & (seq != prev_seq + 1)
    kind = (
        F.when(lag.isNotNull(), "sse_overflow").when(~valid | session_changed | gap, "sequence_gap")
    )
    detail = (
        F.when(lag.isNotNull(), F.when(lag == "", F.lit(LAG_MESSAGE)).otherwise(lag))
        .when(~valid, "Invalid live event envelope")
        .when(session_changed,
              F.concat(F.lit("Session changed from "), prev_session, F.lit(" to "), session))
        .when(gap, F.concat(F.lit("Expected sequence "), (prev_seq + 1).cast("string"),
                            F.lit(", received "), seq.cast("string")))
    )
    return kind, detail


def live_continuity(arrivals: DataFrame) -> DataFrame:
    """Follow each live stream in arrival order until its first violation.

    ``arrivals``: stream_id, arrival, seq, session_id, lag (NULL unless the
    row is a lag marker).  Before the first violation a row is accepted, the
    violation becomes a notice, and everything later is blocked.
    """
    valid = F.coalesce(
        F.col("seq").between(0, MAX_SAFE_INTEGER) & (F.col("session_id") != ""), F.lit(False)
    )
    followed = ordered_scan(
        arrivals,
        ["stream_id"],
        ["arrival"],
        seq_chunk("arrival"),
        prev={"prev_seq": F.col("seq"), "prev_session": F.col("session_id")},
    )
    kind, detail = continuity_detail(
        valid, F.col("lag"), F.col("prev_seq"), F.col("seq"), F.col("prev_session"), F.col("session_id")
    )
    checked = followed.withColumn("notice", kind).withColumn("detail", detail)
    broken = (
        checked.filter(F.col("notice").isNotNull())
        .groupBy("stream_id")
        .agg(F.min("arrival").alias("broken_at"))
    )
    at = F.col("arrival") == F.col("broken_at")
    return attach_facts(checked, broken, ["stream_id"], F.col("arrival")).select(
        "stream_id",
        "arrival",
        "seq",
        F.when(F.col("broken_at").isNull() | (F.col("arrival") < F.col("broken_at")), "accepted")
        .when(at, "notice")
        .otherwise("blocked")
        .alias("outcome"),
        F.when(at, F.col("notice")).alias("notice"),
        F.when(at, F.col("detail")).alias("detail"),
    )


# --------------------------------------------------------------------------
# Rule audit and append admission
# --------------------------------------------------------------------------


def _sorted_unique(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values)) == values


def _operations_sorted(operations: Column) -> Column:
    ranks = F.transform(operations, lambda op: operation_rank(op))
    return _sorted_unique(ranks)


def audit(timeline: DataFrame) -> DataFrame:
    """One row per broken rule of the event schema.

    ``timeline`` has session_id, seq, type and the typed bodies (see
    ``schemas.BODIES``).
    """
    kind = F.col("type")
    op = (
        F.when(kind == "session_start", F.col("session_start.baseline_op"))
        .when(kind == "snapshot", F.col("snapshot.op"))
    )
    before = F.col("op_through")
    followed = ordered_scan(
        timeline.withColumn("own_op", op),
        ["session_id"],
        ["seq"],
        seq_chunk("seq"),
        prev={"prev_seq": F.col("seq")},
        following={"next_type": kind},
        sums={"snapshots_through": (kind == "snapshot").cast("bigint")},
        last={"op_through": F.col("own_op"),
              "overflow_seq": F.when(kind == "overflow", F.col("seq")),
              "snapshot_seq": F.when(kind == "snapshot", F.col("seq"))},
    )
    # The operation before a snapshot needs one more look back.
    chained = ordered_scan(
        followed.filter(F.col("own_op").isNotNull()).select("session_id", "seq", "own_op"),
        ["session_id"],
        ["seq"],
        seq_chunk("seq"),
        prev={"op_before": F.col("own_op")},
    ).select("session_id", "seq", "op_before")
    rows = followed.join(chained, ["session_id", "seq"], "left")
    listed = F.size("snapshot.changes").cast("bigint")
    stats = F.col("snapshot.stats")
    total = sum((stats[name] for name in ("removed", "modified", "renamed", "mode_changed")),
                stats["added"])
    paths = F.col("touched_paths.paths")

    def broken(rule: str, bad: Column, detail: Column) -> Column:
        return F.when(
            F.coalesce(bad, F.lit(False)),
            F.struct(F.lit(rule).alias("rule"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail")),
        )

    rules = F.array_compact(F.array(
        broken("contiguous", F.col("prev_seq").isNotNull() & (F.col("seq") != F.col("prev_seq") + 1),
               F.col("prev_seq")),
        broken("start_first", F.col("prev_seq").isNull()
               & ((kind != "session_start") | (F.col("seq") != 0)), kind),
        broken("start_once", F.col("prev_seq").isNotNull() & (kind == "session_start"), kind),
        broken("snapshot_parent", (kind == "snapshot")
               & ~F.col("snapshot.parent_op").eqNullSafe(F.col("op_before")), F.col("snapshot.parent_op")),
        broken("mark_op", (kind == "mark") & ~F.col("mark.ref_op").eqNullSafe(before), F.col("mark.ref_op")),
        broken("flush_op", (kind == "flush") & ~F.col("flush.op").eqNullSafe(before), F.col("flush.op")),
        broken("end_op", (kind == "session_end") & ~F.col("session_end.final_op").eqNullSafe(before),
               F.col("session_end.final_op")),
        broken("flush_through", (kind == "flush") & (F.col("flush.through_seq") != F.col("seq")),
               F.col("flush.through_seq")),
        broken("end_events", (kind == "session_end") & (F.col("session_end.events") != F.col("seq")),
               F.col("session_end.events")),
        broken("end_snapshots", (kind == "session_end")
               & (F.col("session_end.snapshots") != F.col("snapshots_through")),
               F.col("session_end.snapshots")),
        broken("end_flush", (kind == "session_end") & ~F.col("next_type").eqNullSafe(F.lit("flush")),
               F.col("next_type")),
        broken("overflow_snapshot", (kind == "mark") & F.col("overflow_seq").isNotNull()
               & (F.col("overflow_seq") > F.coalesce("snapshot_seq", F.lit(-1))), F.col("overflow_seq")),
        broken("truncated", (kind == "snapshot")
               & (F.col("snapshot.truncated") != (total > listed)), listed),
        broken("paths_sorted", (kind == "touched_paths")
               & ~_sorted_unique(F.transform(paths, lambda p: p["path"])), F.size(paths)),
        broken("operations_sorted", (kind == "touched_paths")
               & F.exists(paths, lambda p: ~_operations_sorted(p["operations"])), F.size(paths)),
        broken("no_rename", (kind == "snapshot")
               & ((stats["renamed"] > 0)
                  | F.exists("snapshot.changes", lambda c: c["kind"] == "renamed")), listed),
    ))
    return rows.select("session_id", "seq", F.inline(rules))


def admit(events: DataFrame, sessions: DataFrame, limit_bytes: int = 1 << 30) -> DataFrame:
    """Append decision per event in offer order.

    ``events``: journal, offer, seq, session_id, version, line;
    ``sessions``: journal, journal_session, journal_version.  Only accepted
    lines use bytes; the first refusal ends a journal, so events after it are
    reported as not reached.
    """
    size = F.octet_length("line").cast("bigint") + 1
    offered = ordered_scan(
        attach_facts(events.withColumn("attempted", size), sessions, ["journal"], F.col("offer")),
        ["journal"],
        ["offer"],
        seq_chunk("offer"),
        rank="next_seq",
        sums={"used_after": F.col("attempted")},
    ).withColumn("used", F.col("used_after") - F.col("attempted"))
    refusal = (
        F.when(F.col("session_id") != F.col("journal_session"), "session")
        .when(F.col("version") != F.col("journal_version"), "schema")
        .when(F.col("seq") != F.col("next_seq"), "sequence")
        .when(F.col("used_after") > limit_bytes, "full")
    )
    checked = offered.withColumn("refusal", refusal)
    stopped = (
        checked.filter(F.col("refusal").isNotNull())
        .groupBy("journal")
        .agg(F.min("offer").alias("stopped_at"))
    )
    return attach_facts(checked, stopped, ["journal"], F.col("offer")).select(
        "journal",
        "offer",
        F.when(F.col("stopped_at").isNull() | (F.col("offer") < F.col("stopped_at")), "accepted")
        .when(F.col("offer") == F.col("stopped_at"), F.col("refusal"))
        .otherwise("not_reached")
        .alias("outcome"),
        "used",
        "attempted",
        F.lit(limit_bytes).cast("bigint").alias("limit_bytes"),
    )
