"""The registered queries: every operator over the given tables.

Results hold scalars only: arrays are joined, counts are BIGINT and times are
epoch milliseconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.functions.paths import session_filters
from driftlog.functions.values import event_object_name, operations_of, touch_operation
from driftlog.operators import assembly, measure, publish, timeline, trees, validate, windows
from driftlog.operators.segments import BatchLimit
from driftlog.plans import recipes
from driftlog.session import save_and_reload, scratch_path
from driftlog.sources import readers, sinks, tables
from driftlog.streaming.activity import activity_rows, activity_stream
from driftlog.streaming.continuity import live_continuity_stream
from driftlog.streaming.runs import run_available, run_batches, use_rocksdb
from driftlog.streaming.windows import debounce_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(column, separator: str = ","):
    return F.array_join(column, separator)


def _touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.observe(
        recipes.notifications(spark, sf_dir), recipes.ROOT, ignores=recipes.IGNORES
    )


def _overflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.overflow_reports(recipes.notifications(spark, sf_dir))


def _assigned(spark: SparkSession, sf_dir: str, commands: DataFrame | None = None) -> DataFrame:
    return windows.debounce(
        _touches(spark, sf_dir), recipes.RULE, _overflows(spark, sf_dir), commands
    )


def _window_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_paths(
        windows.in_windows(_touches(spark, sf_dir), _assigned(spark, sf_dir))
    )


# ------------------------------------------------------- sources and sinks


def _export_lines(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "lines")
    sinks.write_timeline(
        recipes.lines(spark, sf_dir).selectExpr("file session_id", "line_no - 1 seq", "value"), path
    )
    return path


def _file_of(df: DataFrame) -> DataFrame:
    return df.withColumn("file", F.regexp_extract("file", "session_id=([^/]+)", 1))


@query
def timeline_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_of(readers.read_lines(spark, _export_lines(spark, sf_dir)))


@query
def timeline_scan_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.read_timeline(spark, _export_lines(spark, sf_dir)).filter(F.col("event").isNotNull())
    return _file_of(timeline.typed(rows)).select(
        "file", "line_no", "session_id", "seq", "type",
        F.col("mark.label").alias("label"),
        F.variant_get("mark.meta", "$.n", "bigint").alias("meta_n"),
        F.col("mark.ref_op").alias("ref_op"),
    )


@query
def file_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_of(readers.file_endings(spark, _export_lines(spark, sf_dir)))


@query
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "manifests")
    text = recipes.manifests(spark, sf_dir).select(
        "session_id",
        F.when(~F.col("parsed"), F.lit('{"session_id": "broken"'))
        .otherwise(
            F.to_json(
                F.struct(
                    "session_id",
                    F.struct("session_format", "schema_version").alias("format"),
                    "last_seq",
                    F.concat(F.lit("op:"), F.col("last_seq").cast("string")).alias("last_op"),
                    "durable_seq",
                    "events_object",
                )
            )
        )
        .alias("value"),
    )
    text.repartition(spark.sparkContext.defaultParallelism, "session_id").write.partitionBy("session_id").text(path)
    return readers.read_manifests(spark, path).select(
        F.regexp_extract("file", "session_id=([^/]+)/", 1).alias("folder"),
        "parsed",
        F.when(F.col("parsed"), F.col("session_id")).alias("session_id"),
        F.when(F.col("parsed"), F.col("session_format")).alias("session_format"),
        F.when(F.col("parsed"), F.col("last_seq")).alias("last_seq"),
        F.when(F.col("parsed"), F.col("durable_seq")).alias("durable_seq"),
        F.when(F.col("parsed"), F.col("events_object")).alias("events_object"),
    )


@query
def notification_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "notifications")
    recipes.notifications(spark, sf_dir).write.json(path)
    return readers.read_notifications(spark, path).withColumn("paths", _joined("paths"))


@query
def notification_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "notifications")
    recipes.notifications(spark, sf_dir).write.json(path)
    stream = readers.read_notifications(spark, path, stream=True)
    return run_available(stream.withColumn("paths", _joined("paths")), "notification-stream")


@query
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restore a tree to a folder, then take its inventory."""
    path = scratch_path(spark, "tree")
    docs = recipes.table(spark, sf_dir, "documents").selectExpr(
        "concat(case when doc_id % 9 = 0 then '.git/' else '' end, lang, '/', source, '/', doc_id, '.txt') path",
        "doc_id % 5 = 0 executable",
        "encode(text, 'UTF-8') content",
    )
    sinks.restore(docs, path, scratch_path(spark, "session"))
    return readers.scan_tree(spark, path).select("path", "bytes", "blob")


@query
def timeline_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "export")
    events = recipes.timeline(spark, sf_dir).select(
        "session_id", "seq", "ts", "type",
        F.struct(F.coalesce("snapshot.op", "session_start.baseline_op").alias("op")).alias("data"),
    )
    sinks.write_timeline(sinks.event_json(events), path)
    return readers.read_timeline(spark, path).select(
        F.variant_get("event", "$.session_id", "string").alias("session_id"),
        F.variant_get("event", "$.seq", "bigint").alias("seq"),
        (F.col("line_no") - 1).alias("line_index"),
        F.variant_get("event", "$.type", "string").alias("type"),
        F.try_variant_get("event", "$.data.op", "string").alias("op"),
    )


@query
def event_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = recipes.manifests(spark, sf_dir).filter("durable_seq is not null").select("session_id", "durable_seq")
    published = marks.filter("durable_seq % 3 = 0").select(
        "session_id", event_object_name(F.col("durable_seq")).alias("events_object")
    )
    return sinks.unpublished_objects(marks, published)


_EVENT_SCHEMA = "session_id string, seq bigint, type string, op string"


def _accepted_stream(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, sinks.DurableStore]:
    source = scratch_path(spark, f"{name}-source")
    timeline.index(recipes.timeline(spark, sf_dir)).select(
        "session_id", "seq", F.col("kind").alias("type"), "op"
    ).repartition(4, "session_id").write.parquet(source)
    stream = spark.readStream.schema(_EVENT_SCHEMA).option("maxFilesPerTrigger", 2).parquet(source)
    return stream, sinks.DurableStore(spark, scratch_path(spark, f"{name}-store"), _EVENT_SCHEMA)


@query
def durable_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish a stream batch by batch, then read what is visible."""
    stream, store = _accepted_stream(spark, sf_dir, "publication")
    run_batches(stream, store.publish, "publication")
    return store.visible()


@query
def durable_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermarks after a gap, a replayed batch and a restarted writer."""
    rows = timeline.index(recipes.timeline(spark, sf_dir)).select(
        "session_id", "seq", F.col("kind").alias("type"), "op"
    )
    there = rows.filter("not (cast(substr(session_id, 2) as bigint) % 5 = 0 and seq = 3)")
    path = scratch_path(spark, "prefix-store")
    first = sinks.DurableStore(spark, path, _EVENT_SCHEMA)
    first.publish(there.filter("seq % 2 = 0"), 0)
    first.publish(there.filter("seq % 2 = 0"), 0)
    second = sinks.DurableStore(spark, path, _EVENT_SCHEMA)
    second.publish(there.filter("seq % 2 = 1 or seq = 0"), 0)
    return second.visible().groupBy("session_id").agg(
        F.max("seq").alias("durable_seq"), F.count(F.lit(1)).alias("events")
    )


@query
def publication_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writers that send unlike contents for accepted, staged and new numbers."""
    rows = timeline.index(recipes.timeline(spark, sf_dir)).selectExpr("session_id", "seq", "kind type", "op")
    store = sinks.DurableStore(spark, scratch_path(spark, "conflict-store"), _EVENT_SCHEMA)
    store.publish(rows.filter("seq <> 1"), 0)
    other = rows.filter("seq in (0, 2)").withColumn("op", F.concat(F.lit("other:"), F.col("session_id")))
    store.publish(rows.unionByName(other), 1)
    store.publish(rows.filter("seq = 1").withColumn("type", F.lit("late")), 2)
    return store.conflicts()


@query
def live_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, store = _accepted_stream(spark, sf_dir, "live")
    run_batches(stream, store.publish, "live")
    return run_available(store.live(), "live-feed")


@query
def timeline_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = readers.tail_timeline(spark, _export_lines(spark, sf_dir))
    flat = stream.select(
        "value",
        F.coalesce(F.try_variant_get("event", "$.seq", "bigint"), F.lit(-1)).alias("seq"),
    )
    return run_available(flat, "tail")


@query
def cursor_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "cursors")
    acks = recipes.attempts(spark, sf_dir).filter("status = 200").selectExpr(
        "session_id", "concat('sink', cast(attempt_id % 3 as string)) sink", "attempt_id delivered_seq"
    )
    sinks.advance_cursor(acks, path)
    return sinks.load_cursor(spark, path)


# ------------------------------------------------- validation and lookups


@query
def validate_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate_timeline(recipes.lines(spark, sf_dir).select("file", "line_no", "value"))


@query
def validate_spool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recipes.lines(spark, sf_dir)
    expected = rows.groupBy("file", "conv_id").agg(F.lit(1)).selectExpr(
        "file",
        "concat('c', cast(case when conv_id % 10 = 0 then conv_id + 1 else conv_id end as string)) spool_session",
        "0 spool_version",
        "conv_id % 7 <> 6 complete",
    )
    return validate.validate_spool(rows.select("file", "line_no", "value"), expected)


@query
def validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate_records(recipes.lines(spark, sf_dir).select("file", "line_no", "value"))


@query
def validate_for_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = recipes.manifests(spark, sf_dir).selectExpr(
        "concat(session_id, '.ndjson') file",
        "case when last_seq = 5 then 'else' else session_id end manifest_session",
        "last_seq durable_seq",
    )
    return validate.validate_for_summary(
        recipes.lines(spark, sf_dir).select("file", "line_no", "value"), marks
    )


@query
def compatible_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.compatible(recipes.manifests(spark, sf_dir)).select("session_id", "session_format")


@query
def open_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recipes.lines(spark, sf_dir)
    ends = validate.with_event(rows).groupBy("file").agg(
        F.max("conv_id").alias("conv_id"),
        F.max(F.try_variant_get("event", "$.seq", "bigint")).alias("last_seq"),
    )
    timelines = validate.validate_timeline(rows.select("file", "line_no", "value")).join(ends, "file").selectExpr(
        "concat('c', cast(conv_id as string)) session_id",
        "'events/000000.ndjson' events_object",
        "ok",
        "error_class",
        "last_seq",
    )
    marks = recipes.manifests(spark, sf_dir)
    return validate.open_sessions(
        marks.select("session_id"), marks.filter("last_seq <> 6"), timelines
    )


@query
def durable_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.durable(
        recipes.timeline(spark, sf_dir).select("session_id", "seq", "type"), recipes.manifests(spark, sf_dir)
    )


@query
def event_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recipes.timeline(spark, sf_dir).select("session_id", "seq", "type")
    asked = rows.selectExpr("session_id", "seq + 1 seq")
    return validate.event_lookup(asked, rows, recipes.manifests(spark, sf_dir))


@query
def timeline_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.index(recipes.timeline(spark, sf_dir))


def _engine_timeline(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "engine-timeline")
    tables.write_table(recipes.timeline(spark, sf_dir).drop("mark"), path, buckets=16)
    return path


@query
def engine_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of sequence numbers of all sessions, out of the engine table."""
    rows = tables.read_table(spark, _engine_timeline(spark, sf_dir), first=1, last=4)
    return timeline.operation_rows(rows)


@query
def engine_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of a few sessions, out of the engine table."""
    asked = timeline.index(recipes.timeline(spark, sf_dir)).filter(
        "op is not null and cast(substr(session_id, 2) as bigint) % 10 = 3"
    ).select("session_id", "op").distinct()
    rows = tables.rows_for(spark, _engine_timeline(spark, sf_dir), asked)
    return timeline.inspect_operation(rows, asked)


@query
def engine_tree_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of two sessions from a table of path versions."""
    path = scratch_path(spark, "engine-versions")
    tables.write_table(_history(spark, sf_dir), path, order="valid_from", buckets=16)
    asked = recipes.generations(spark, sf_dir).filter("session_id in ('s2', 's5')").selectExpr(
        "session_id", "cast(gen as bigint) at_seq"
    ).distinct()
    return trees.tree_at(tables.rows_for(spark, path, asked), asked).select("session_id", "at_seq", "path", "blob", "bytes")


@query
def inspect_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recipes.timeline(spark, sf_dir)
    asked = timeline.index(rows).filter("op is not null").selectExpr(
        "session_id", "case when seq % 5 = 3 then concat(op, '0') else op end op"
    ).distinct()
    return timeline.inspect_operation(rows, asked)


@query
def inspect_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recipes.timeline(spark, sf_dir)
    asked = timeline.index(rows).filter("tree is not null").selectExpr(
        "session_id", "case when seq % 5 = 3 then concat(tree, '0') else tree end tree"
    ).distinct()
    return timeline.inspect_tree(rows, asked)


@query
def op_to_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.op_to_tree(timeline.index(recipes.timeline(spark, sf_dir)))


@query
def missing_durable_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = timeline.index(recipes.timeline(spark, sf_dir))
    marks = timeline.observed_watermark(recipes.timeline(spark, sf_dir)).selectExpr(
        "session_id", "case when last_seq % 2 = 1 then concat(last_op, 'x') else last_op end durable_op"
    )
    return timeline.missing_durable_ops(marks, timeline.op_to_tree(entries))


@query
def observed_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.observed_watermark(recipes.timeline(spark, sf_dir))


@query
def latest_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.latest_commit(recipes.timeline(spark, sf_dir))


@query
def session_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recipes.timeline(spark, sf_dir)
    pending = rows.groupBy("session_id").agg(F.max("seq").alias("s")).filter("s % 3 = 0")
    switches = rows.filter("seq > 1").selectExpr(
        "session_id", "seq t_ms", "seq command_id",
        "case when type = 'snapshot' then 'pause' when type = 'mark' then 'resume' else 'flush' end command",
    )
    return timeline.session_status(rows, pending, switches)


@query
def describe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.describe(recipes.timeline(spark, sf_dir)).withColumn("paths", _joined("paths", "|"))


@query
def listed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.changes(recipes.timeline(spark, sf_dir)).select(
        "session_id", "seq", "op", "path", "kind", "blob", "prev_blob", "bytes"
    )


@query
def touched_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.touches(recipes.timeline(spark, sf_dir)).withColumn("operations", _joined("operations"))


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.table(spark, sf_dir, "conversations").selectExpr(
        "cast(conv_id as string) stream_id",
        "turn arrival",
        "case when conv_id % 11 = 5 and turn = 1 then -1 "
        "when conv_id % 3 = 1 and turn >= 2 then turn + 1 else turn end seq",
        "case when conv_id % 7 = 3 and turn >= 3 then 'other' else concat('c', cast(conv_id as string)) end session_id",
        "case when conv_id % 13 = 6 and turn = 2 then 'lagged by 3' when conv_id % 13 = 7 and turn = 2 then '' end lag",
    )


@query
def live_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.live_continuity(_arrivals(spark, sf_dir))


@query
def live_continuity_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_rocksdb(spark)
    path = scratch_path(spark, "arrivals")
    rows = _arrivals(spark, sf_dir)
    rows.repartitionByRange(3, "arrival").write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    return run_available(live_continuity_stream(stream), "continuity")


@query
def schema_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.audit(recipes.timeline(spark, sf_dir))


@query
def append_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = recipes.table(spark, sf_dir, "conversations").selectExpr(
        "concat('j', cast(conv_id as string)) journal",
        "turn offer",
        "case when conv_id % 9 = 4 and turn >= 3 then turn + 1 else turn end seq",
        "case when conv_id % 9 = 5 and turn = 2 then 'other' else concat('c', cast(conv_id as string)) end session_id",
        "case when conv_id % 9 = 6 and turn = 2 then 1 else 0 end version",
        "text line",
    )
    sessions = events.filter("offer = 0").selectExpr("journal", "session_id journal_session", "0 journal_version")
    return validate.admit(events, sessions, limit_bytes=600)


# ------------------------------------------------------ activity windows


@query
def touch_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.notifications(spark, sf_dir).select(
        "notif_id", touch_operation(F.col("kind"), F.col("rename_mode")).alias("operation")
    )


@query
def kept_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _touches(spark, sf_dir).select(
        "session_id", "notif_id", "t_ms", "operation", _joined("paths").alias("paths")
    )


@query
def kept_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of sessions with unlike lists, and one with a broken glob."""
    notes = recipes.notifications(spark, sf_dir)
    even = F.substr("session_id", F.lit(2)).cast("bigint") % 2 == 0
    lists = notes.select("session_id").distinct().select(
        "session_id", F.lit(recipes.ROOT + "/").alias("root"),
        F.when(even, F.array(F.lit(recipes.ROOT + "/src/d3/"))).alias("excluded"),
        F.when(F.col("session_id") == "u7", F.array(F.lit("[a")))
        .when(even, F.array(F.lit("src/d1/*"), F.lit("d2"))).otherwise(F.array(F.lit("*.tmp"))).alias("ignores"),
    )
    return windows.observe_sessions(notes, session_filters(lists)).withColumn("paths", _joined("paths"))


@query
def observed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _touches(spark, sf_dir).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("raw_events"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms")
    )


@query
def debounce_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_bounds(_assigned(spark, sf_dir), recipes.RULE)


@query
def debounce_with_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = _assigned(spark, sf_dir, recipes.pausing_commands(spark, sf_dir))
    return windows.window_bounds(assigned, recipes.RULE)


def _in_thirds(rows: DataFrame, ends: DataFrame, name: str) -> DataFrame:
    """A stream of rows in three spans of time, and the ends last.  A span is
    written by many tasks, all of a session's rows to one file, so triggers
    take a session's rows in the order of time wherever they are cut."""
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    saved = save_and_reload(rows, f"{name}-rows")
    bounds = saved.agg(F.min("t_ms"), F.max("t_ms")).first()
    low, width = bounds[0] or 0, ((bounds[1] or 0) - (bounds[0] or 0)) // 3 + 1
    for part in (*[saved.filter(F.expr(f"(t_ms - {low}) div {width} = {third}")) for third in range(3)], ends):
        part.repartition(4, "session_id").write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)


@query
def debounce_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows closed by the stream, the last ones by the ends of sessions."""
    use_rocksdb(spark)
    rows = _touches(spark, sf_dir).select("session_id", "t_ms", F.lit(False).alias("is_end"))
    ends = rows.select("session_id", F.lit(None).cast("bigint").alias("t_ms"), F.lit(True).alias("is_end")).distinct()
    return run_available(debounce_stream(_in_thirds(rows, ends, "touches"), recipes.RULE), "debounce")


@query
def activity_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with commands, pauses, overflow reports and capped path sets,
    closed by the stream."""
    use_rocksdb(spark)
    notes = save_and_reload(recipes.notifications(spark, sf_dir), "notifications")
    rows = activity_rows(
        windows.observe(notes, recipes.ROOT, ignores=recipes.IGNORES), windows.overflow_reports(notes),
        recipes.pausing_commands(spark, sf_dir),
    )
    ends = activity_rows(
        windows.observe(notes.limit(0), recipes.ROOT), ends=notes.select("session_id").distinct()
    ).filter("kind = 'end'")
    stream = activity_stream(_in_thirds(rows, ends, "activity"), recipes.RULE, max_paths=2, max_reports=2)
    closed = run_available(stream, "activity")
    ops = F.concat_ws("+", operations_of(F.col("operation_bits")))
    listed = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("kind") == "path", F.struct("place", F.concat_ws("=", "path", ops).alias("x"))))),
            lambda p: p["x"],
        ), ",",
    )
    sources = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "overflow", F.struct("place", "source")))), lambda p: p["source"]), ","
    )
    return closed.groupBy("session_id", "window_start", "last_ms", "closed_ms").agg(
        F.max(F.when(F.col("kind") == "window", F.col("raw_events"))).alias("raw_events"),
        listed.alias("paths"), sources.alias("sources"),
    )


@query
def window_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.aggregate_windows(_window_paths(spark, sf_dir)).select(
        "session_id", "window_start", "paths", "raw_events", "started_ms", "ended_ms",
        _joined(operations_of(F.col("operation_bits"))).alias("operations"),
    )


@query
def window_path_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_paths(spark, sf_dir).select(
        "session_id", "window_start", "path", _joined(operations_of(F.col("operation_bits"))).alias("operations")
    )


@query
def capped_window_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _, _ = windows.cap_paths(_window_paths(spark, sf_dir), limit=2)
    return kept.select(
        "session_id", "window_start", "path", "rank", _joined(operations_of(F.col("operation_bits"))).alias("operations")
    )


@query
def path_limit_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, reports, _ = windows.cap_paths(_window_paths(spark, sf_dir), limit=2)
    return reports


@query
def touched_path_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _window_paths(spark, sf_dir)
    listed = windows.touched_events(kept)
    return listed.select(
        "session_id", "window_start",
        F.array_join(
            F.transform("paths", lambda p: F.concat(p["path"], F.lit("="), F.array_join(p["operations"], "+"))), ","
        ).alias("paths"),
    )


def _window_overflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.in_windows(_overflows(spark, sf_dir), _assigned(spark, sf_dir))


@query
def capped_overflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Daily buckets hold enough reports to exceed a small cap.
    reports = _overflows(spark, sf_dir).withColumn(
        "window_start", F.expr("t_ms div (5 * 86400000) * (5 * 86400000)")
    )
    return windows.cap_overflows(reports, limit=2)[0].select(
        "session_id", "window_start", "notif_id", "place", "source", "raw_events"
    )


@query
def full_scan_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.full_scan_windows(_window_overflows(spark, sf_dir))


@query
def merged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        windows.window_paths(
            _touches(spark, sf_dir).filter(F.col("notif_id") % 2 == half)
            .withColumn("window_start", F.expr("t_ms div 86400000 * 86400000"))
        )
        for half in (0, 1)
    ]
    return windows.aggregate_windows(windows.merge_windows(*parts)).select(
        "session_id", "window_start", "paths", "raw_events", "started_ms",
        _joined(operations_of(F.col("operation_bits"))).alias("operations"),
    )


@query
def dirty_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = windows.window_bounds(_assigned(spark, sf_dir), recipes.RULE)
    covered = bounds.filter("window_start % 10 < 8").select("session_id", "window_start")
    return windows.dirty_sessions(bounds, covered)


@query
def assembled_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = recipes.commands(spark, sf_dir)
    # The window of every instant feeds three branches; it is written once.
    assigned = save_and_reload(_assigned(spark, sf_dir, commands), "assigned")
    bounds = windows.window_bounds(assigned, recipes.RULE)
    touched = windows.aggregate_windows(
        windows.window_paths(windows.in_windows(_touches(spark, sf_dir), assigned))
    ).select("session_id", "window_start", F.col("raw_events").alias("touched_raw"))
    captures = bounds.join(touched, ["session_id", "window_start"], "left").select(
        "session_id", "window_start", "closed_ms", "touched_raw"
    )
    reports = windows.in_windows(_overflows(spark, sf_dir), assigned)
    reports = windows.cap_overflows(reports, windows.MAX_OVERFLOW_REPORTS)[0].join(
        bounds.select("session_id", "window_start", "closed_ms"), ["session_id", "window_start"]
    )
    sessions = (
        recipes.notifications(spark, sf_dir).groupBy("session_id").agg(F.min("t_ms").alias("opened_ms"))
    )
    return windows.assemble(sessions, captures, reports, commands, recipes.RULE.chunk_ms).select(
        "session_id", "seq", "type", "at_ms", "detail", "raw_events", "snapshots"
    )


def _typed_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Notifications are parsed and filtered once for all branches.
    notes = save_and_reload(recipes.notifications(spark, sf_dir), "notifications")
    touches = save_and_reload(windows.observe(notes, recipes.ROOT, ignores=recipes.IGNORES), "touches")
    overflows = windows.overflow_reports(notes)
    commands = recipes.commands(spark, sf_dir).selectExpr(
        "*", "concat('m', cast(command_id as string)) label", "concat('{\"n\":', cast(command_id as string), '}') meta",
        "cast(null as string) reason",
    )
    assigned = save_and_reload(windows.debounce(touches, recipes.RULE, overflows, commands), "assigned")
    paths = save_and_reload(windows.window_paths(windows.in_windows(touches, assigned)), "paths")
    sessions = notes.groupBy("session_id").agg(F.min("t_ms").alias("opened_ms")).select(
        "*", F.array(F.lit(recipes.ROOT)).alias("roots"), F.array(*map(F.lit, recipes.IGNORES)).alias("ignore")
    )
    return assembly.assemble_typed(
        sessions, paths, windows.window_bounds(assigned, recipes.RULE), windows.in_windows(overflows, assigned),
        commands, recipes.edits(touches), max_paths=3, max_changes=2, chunk_ms=recipes.RULE.chunk_ms,
    )[0]


def _typed_export(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "typed-timeline")
    sinks.write_timeline(sinks.typed_json(_typed_timeline(spark, sf_dir)), path)
    return path


@query
def assembled_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = timeline.typed(readers.read_timeline(spark, _typed_export(spark, sf_dir)))
    text = lambda *parts: F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return events.select(
        "session_id", "seq", "ts", "type",
        F.coalesce("touched_paths.raw_events", "overflow.raw_events").alias("raw_events"),
        F.col("overflow.source").alias("source"),
        _joined(F.transform("touched_paths.paths", lambda p: text(p["path"], F.concat_ws("+", p["operations"])))).alias("paths"),
        F.col("touched_paths.window_started_at").alias("started_at"),
        _joined(
            F.transform("snapshot.changes", lambda c: text(c["path"], c["kind"], c["blob"], c["prev_blob"], c["bytes"]))
        ).alias("changes"),
        *[F.col(f"snapshot.stats.{kind}").alias(kind) for kind in ("added", "removed", "modified", "mode_changed")],
        F.col("snapshot.truncated").alias("truncated"),
        F.col("mark.label").alias("label"),
        F.variant_get("mark.meta", "$.n", "bigint").alias("meta_n"),
        F.col("flush.through_seq").alias("through_seq"),
    )


@query
def assembled_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _typed_export(spark, sf_dir)
    lines = readers.read_lines(spark, path)
    faults = validate.validate_timeline(lines).filter("not ok").select(
        F.col("file").alias("session_id"), F.lit(None).cast("bigint").alias("seq"),
        F.lit("valid_timeline").alias("rule"), F.col("error_class").alias("detail"),
    )
    return validate.audit(timeline.typed(readers.read_timeline(spark, path))).unionByName(faults)


# ------------------------------------------------------------------ trees


@query
def tree_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.tree_ids(recipes.tree_before(spark, sf_dir), ["session_id"])


@query
def incremental_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    inventory = recipes.table(spark, sf_dir, "documents").selectExpr(
        "concat('s', cast(doc_id % 8 as string)) session_id",
        "concat(source, '/', cast(doc_id as string)) path",
        "n_chars bytes",
        "doc_id * 1000 mtime_ms",
        "encode(text, 'UTF-8') content",
    )
    prior = inventory.filter("mtime_ms % 3000 <> 0").selectExpr(
        "session_id", "path", "bytes", "case when mtime_ms % 7000 = 0 then mtime_ms + 1 else mtime_ms end mtime_ms",
        "sha2(content, 256) blob",
    )
    return trees.content_ids(inventory, prior).select("session_id", "path", "blob", "reused")


@query
def new_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recipes.table(spark, sf_dir, "documents").selectExpr("sha2(text, 256) blob", "n_chars bytes")
    stored = recipes.table(spark, sf_dir, "documents").filter("doc_id % 10 = 0").selectExpr("sha2(text, 256) blob")
    return trees.store_blobs(rows, stored)


@query
def classified_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.classify(recipes.tree_before(spark, sf_dir), recipes.tree_after(spark, sf_dir)).select(
        "session_id", "path", "kind"
    )


@query
def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = trees.project_diff(recipes.tree_before(spark, sf_dir), recipes.tree_after(spark, sf_dir))
    return rows


@query
def tree_diff_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, capped, _ = trees.project_diff(recipes.tree_before(spark, sf_dir), recipes.tree_after(spark, sf_dir), 20)
    return capped.select("session_id", "rank", "path", "kind")


@query
def tree_diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, stats = trees.project_diff(recipes.tree_before(spark, sf_dir), recipes.tree_after(spark, sf_dir), 20)
    return stats


def _generation_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.tree_ids(recipes.generations(spark, sf_dir), ["session_id", "gen"]).selectExpr(
        "session_id", "cast(gen as bigint) seq", "tree"
    )


@query
def running_tree_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of every generation, from the changes between generations."""
    whole = trees.with_entry_defaults(recipes.generations(spark, sf_dir)).select(
        "session_id", F.col("gen").cast("bigint").alias("gen"), "path",
        F.struct("entry_type", "blob", "executable").alias("entry"), F.col("bytes").cast("bigint").alias("bytes"),
    )
    now = whole.withColumnsRenamed({"entry": "after", "bytes": "after_bytes"})
    last = whole.filter("gen < 4").withColumn("gen", F.col("gen") + 1).withColumnsRenamed(
        {"entry": "before", "bytes": "before_bytes"}
    )
    changes = now.join(last, ["session_id", "gen", "path"], "full_outer").filter("not (before <=> after)")
    return trees.running_tree_ids(changes, whole.select("session_id", "gen").distinct(), "gen")


@query
def operation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = recipes.generations(spark, sf_dir).groupBy("session_id", "gen").agg(
        F.max("blob").alias("top")
    ).selectExpr("session_id", "cast(gen as bigint) seq", "concat('t:', top) tree")
    return trees.operations(snapshots)


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.history(trees.changes_between_generations(recipes.generations(spark, sf_dir)))


@query
def path_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).select("session_id", "path", "valid_from", "valid_to", "blob")


@query
def tree_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = recipes.generations(spark, sf_dir).selectExpr("session_id", "cast(gen as bigint) at_seq").distinct()
    return trees.tree_at(_history(spark, sf_dir), asked).select("session_id", "at_seq", "path", "blob", "bytes")


def _generation_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.generations(spark, sf_dir).select("session_id", "gen").distinct().selectExpr(
        "session_id", "concat('op:', cast(gen as string)) op", "cast(gen as bigint) seq"
    )


@query
def materialized_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _generation_ops(spark, sf_dir)
    asked = known.select("session_id", "op").unionByName(
        known.filter("seq = 0").selectExpr("session_id", "'op:unknown' op")
    )
    files = trees.materialize(
        _history(spark, sf_dir), asked, known, recipes.generation_blobs(spark, sf_dir).dropDuplicates(["blob"])
    )
    return files.select("session_id", "op", "outcome", "path", "bytes", F.sha2("content", 256).alias("content_id"))


@query
def operation_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _generation_ops(spark, sf_dir)
    asked = known.selectExpr(
        "session_id",
        "case seq when 1 then 'op:3' else 'op:0' end before_op",
        "case seq when 0 then 'op:unknown' else op end after_op",
    )
    return trees.diff(_history(spark, sf_dir), asked, known).select(
        "session_id", "before_seq", "after_seq", "outcome", "path", "before", "after"
    )


def _durable_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermarks at generation 2, some sessions without any."""
    return recipes.generations(spark, sf_dir).select("session_id").distinct().filter("session_id <> 's1'").withColumn(
        "durable_seq", F.lit(2).cast("bigint")
    )


@query
def durable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _generation_ops(spark, sf_dir)
    files = trees.materialize(
        _history(spark, sf_dir), known.select("session_id", "op"), known,
        recipes.generation_blobs(spark, sf_dir).dropDuplicates(["blob"]), _durable_generations(spark, sf_dir),
    )
    return files.select("session_id", "op", "outcome", "path", F.sha2("content", 256).alias("content_id"))


@query
def durable_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _generation_ops(spark, sf_dir)
    asked = known.selectExpr("session_id", "'op:1' before_op", "op after_op")
    return trees.diff(_history(spark, sf_dir), asked, known, _durable_generations(spark, sf_dir)).select(
        "session_id", "before_seq", "after_seq", "outcome", "path", "before", "after"
    )


@query
def tree_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = trees.compare_trees(recipes.tree_before(spark, sf_dir), recipes.tree_after(spark, sf_dir))
    return rows


@query
def tree_comparison_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, totals = trees.compare_trees(recipes.tree_before(spark, sf_dir), recipes.tree_after(spark, sf_dir))
    return totals


@query
def store_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.growth(recipes.generations(spark, sf_dir)).withColumn("gen", F.col("gen").cast("bigint"))


@query
def identifier_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.audit_ids(recipes.timeline(spark, sf_dir))


# --------------------------------------------------------------- delivery


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.timeline(spark, sf_dir).filter("type = 'snapshot'").selectExpr(
        "session_id", "seq", "snapshot.commit commit"
    )


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir).selectExpr(
        "session_id", "case when seq % 3 = 0 then concat('c:', repeat('0', 40)) else upper(substr(commit, 3, 40)) end commit"
    )


@query
def checkpoint_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejects = publish.normalize_checkpoints(_snapshots(spark, sf_dir))
    return rejects


@query
def checkpoint_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, _ = publish.normalize_checkpoints(_checkpoints(spark, sf_dir))
    return ok


@query
def dangling_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.dangling(_snapshots(spark, sf_dir), _checkpoints(spark, sf_dir))


@query
def orphan_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.orphans(_snapshots(spark, sf_dir), _checkpoints(spark, sf_dir))


def _named_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.table(spark, sf_dir, "conversations").select("conv_id").distinct().selectExpr(
        "concat(case conv_id % 9 when 1 then 'a/' when 2 then '..' when 3 then 'b\\\\\\\\' else '' end, "
        "case when conv_id % 9 = 4 then '' else concat('c', cast(conv_id as string)) end) session_id",
        "case conv_id % 7 when 1 then 'refs/heads/x' when 2 then 'refs//r' when 3 then 'refs/r/' "
        "when 4 then 'tags/r' else 'refs/recorder' end ref_prefix",
    )


@query
def session_name_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.audit_names(_named_sessions(spark, sf_dir))


@query
def advance_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = recipes.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    ids = talks.selectExpr(
        "conv_id", "concat('c', cast(conv_id as string)) session_id", "substr(sha2(text, 256), 1, 40) h"
    )
    wanted = ids.selectExpr("session_id", "case when conv_id % 8 = 7 then 'zz' else concat('c:', h) end wanted")
    tips = ids.filter("conv_id % 4 <> 0").selectExpr(
        "session_id", "case when conv_id % 4 = 1 then upper(h) else reverse(h) end tip"
    )
    cursors = ids.filter("conv_id % 3 <> 0").selectExpr(
        "session_id", "case when conv_id % 3 = 1 then reverse(h) else substr(concat(h, h), 5, 40) end expected"
    )
    broken = ids.filter("conv_id % 10 = 9").select("session_id")
    return publish.advance_plan(wanted, tips, cursors, broken)


def _cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.manifests(spark, sf_dir).filter("last_seq <> 4").selectExpr(
        "session_id", "case when last_seq % 3 = 0 then null when last_seq % 3 = 1 then last_seq else 1 end delivered_seq"
    )


def _offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.table(spark, sf_dir, "conversations").filter(
        "not (conv_id % 5 = 1 and turn = 2) and not (conv_id % 5 = 2 and turn = 0) and not (conv_id % 5 = 3 and turn < 3)"
    ).selectExpr("concat('c', cast(conv_id as string)) session_id", "turn seq")


@query
def resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.resume(_offered(spark, sf_dir), _cursors(spark, sf_dir))


@query
def events_to_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    offered = _offered(spark, sf_dir)
    return publish.to_publish(offered, publish.resume(offered, _cursors(spark, sf_dir)))


@query
def delivery_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.batches(recipes.batch_events(spark, sf_dir), BatchLimit(8, 34_000))


@query
def delivery_batches_oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.batches(recipes.batch_events(spark, sf_dir), BatchLimit(8, 16_384))


@query
def response_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recipes.attempts(spark, sf_dir).withColumn("ack_proves", F.col("attempt_id") % 40 == 0)
    return publish.attempt_outcomes(rows).select("attempt_id", "status", "class", "delivered")


@query
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recipes.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey div 11 request_id",
        "cast(o_orderkey % 11 + 1 as int) attempt",
        "case when o_custkey % 10 < 9 then 503 else 200 end status",
        "case when o_custkey % 40 = 1 then 2 end retry_after",
    )
    return publish.retry_schedule(rows)


@query
def acknowledgement_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = publish.batches(recipes.batch_events(spark, sf_dir), BatchLimit(8, 34_000)).filter("outcome = 'ready'")
    sent = ready.selectExpr("session_id", "last_seq", "case when is_final then last_seq end durable_seq")
    acks = ready.filter("last_seq % 7 <> 6").selectExpr(
        "session_id", "last_seq", "last_seq - case when last_seq % 5 = 2 then 1 else 0 end accepted_through_seq",
        "case when is_final and last_seq % 3 <> 0 then last_seq - last_seq % 2 end durable_through_seq",
    )
    return publish.validate_acks(sent, acks)


def _flush_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recipes.timeline(spark, sf_dir)
    ends = rows.groupBy("session_id").agg(F.max("seq").alias("journal_end"))
    targets = ends.selectExpr(
        "session_id", "explode(array(journal_end, journal_end - 1)) target_seq"
    ).selectExpr("session_id", "target_seq", "case when target_seq % 4 = 0 then concat('c:', repeat('a', 40)) end checkpoint")
    acks = ends.filter("journal_end <> 3").selectExpr(
        "session_id", "journal_end target_seq", "case when journal_end = 5 then 4 else journal_end end accepted_through_seq",
        "case when journal_end = 4 then 2 when journal_end = 2 then journal_end end durable_through_seq",
    )
    return publish.flush_outcomes(targets, ends, timeline.latest_commit(rows), acks)


@query
def flush_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flush_outcomes(spark, sf_dir)


@query
def durable_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.durable_watermarks(_flush_outcomes(spark, sf_dir))


def _sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.sync_plan(
        recipes.sync_listing(spark, sf_dir, recipes.tree_after(spark, sf_dir)),
        recipes.sync_listing(spark, sf_dir, recipes.tree_before(spark, sf_dir)),
    )


@query
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sync(spark, sf_dir)


@query
def sync_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.sync_stats(_sync(spark, sf_dir))


@query
def store_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.store_composition(recipes.sync_listing(spark, sf_dir, recipes.tree_before(spark, sf_dir)))


@query
def redacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = recipes.table(spark, sf_dir, "documents").selectExpr("doc_id", "source", "text", "sha2(text, 256) token")
    log = docs.selectExpr("source session_id", "doc_id message_id", "concat('token ', token, ' failed: ', text) message")
    secrets = docs.groupBy("source").agg(
        F.array(F.min("token"), F.max("token"), F.lit("")).alias("secrets")
    ).withColumnRenamed("source", "session_id")
    return publish.redact_log(log, secrets)


@query
def listing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.audit_listing(recipes.listing(spark, sf_dir), "/rec/dev/")


@query
def listing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.listing_totals(recipes.listing(spark, sf_dir), "rec/dev")


@query
def listing_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recipes.table(spark, sf_dir, "pages").selectExpr(
        "concat('rec/', case when page_id % 10 = 0 then '' else concat('s', cast(page_id % 7 as string)) end, "
        "'/', cast(page_id as string)) key_name",
        "cast(length(html) as bigint) size",
    )
    return publish.sessions_in_listing(rows, "rec").filter("outcome = 'ok'").drop("outcome")


@query
def listing_session_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable and unusable prefixes; keys without a session name."""
    rows = recipes.table(spark, sf_dir, "pages").selectExpr(
        "concat('rec/', case when page_id % 10 = 0 then '' else concat('s', cast(page_id % 7 as string)) end, "
        "'/', cast(page_id as string)) key_name",
        "cast(length(html) as bigint) size",
    )
    found = [
        publish.sessions_in_listing(rows, prefix).withColumn("prefix", F.lit(prefix)) for prefix in (" rec/ ", "rec//x", "..", "none")
    ]
    return found[0].union(found[1]).union(found[2]).union(found[3])


# ------------------------------------------------------------ measurement


@query
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.summarize(recipes.timeline(spark, sf_dir)).withColumn(
        "observed_touch_operations", _joined("observed_touch_operations")
    )


@query
def recording_overhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.overhead(recipes.paired_runs(spark, sf_dir))


@query
def paired_result_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = recipes.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey run_id",
        "case when o_orderkey % 50 = 0 then 2 else 1 end schema",
        "10000 off_mutations",
        "case when o_orderkey % 31 = 0 then 9999 else 10000 end on_mutations",
        "o_totalprice off_workload_seconds",
        "0.5 off_baseline_setup_seconds",
        "o_orderkey % 29 - 1 on_baseline_setup_seconds",
        "1.0 recorder_baseline_seconds",
        "1.0 cold_session_open_and_index_seconds",
        "1.0 materialization_seconds",
        "case when o_orderkey % 37 = 0 then null else o_totalprice end on_workload_seconds",
        "o_totalprice - 1000 flush_time_to_durable_seconds",
        "o_orderkey % 41 events",
        "1 materialized_files",
        "o_orderkey % 43 <> 0 baseline_excluded",
    )
    # warm_index_op_to_tree_lookup_ns is absent, which breaks its rule.
    return measure.check_paired(results, 10_000)


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edit per touched window of the timeline, and one that no window
    holds."""
    return timeline.touches(recipes.timeline(spark, sf_dir)).selectExpr(
        "session_id",
        "concat(session_id, '-', cast(seq as string), '-', path) sample_id",
        "case when seq % 5 = 2 then concat(path, '.gone') else path end path",
    )


@query
def matched_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.match_edits(_edits(spark, sf_dir), recipes.timeline(spark, sf_dir))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency samples derived from events: clocks in nanoseconds, windows of
    one hour per user."""
    ns = "(unix_micros(cast(ts as timestamp)) * 1000)"
    v = "cast(round(value * 100) as bigint)"
    mode = "case event_id % 3 when 0 then 'isolated' when 1 then 'burst' else 'continuous' end"
    return recipes.table(spark, sf_dir, "events").selectExpr(
        "concat('u', cast(user_id as string)) session_id",
        "event_id sample_id",
        f"{mode} mode",
        "concat('f', cast(event_id as string)) path",
        f"{ns} div 3600000000000 * 2 touched_seq",
        f"{ns} div 3600000000000 * 2 + 1 snapshot_seq",
        "case when event_id % 20 = 0 then 'failed' else 'ok' end status",
        f"{ns} start_wall",
        "event_id * 1000 start_mono",
        "event_id * 1000 + 500 completion_mono",
        f"{ns} + {v} watcher_wall",
        f"{ns} + {v} * 7 touched_created_wall",
        f"{ns} + {v} * 9 touched_received_wall",
        f"event_id * 1000 + {v} * 9 touched_received_mono",
        f"{ns} + {v} * 11 snapshot_created_wall",
        f"{ns} + {v} * 13 snapshot_received_wall",
        f"event_id * 1000 + {v} * 13 snapshot_received_mono",
    )


@query
def edit_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.latencies(_samples(spark, sf_dir)).select("sample_id", *measure.LATENCIES)


@query
def scoped_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.scope_estimates(measure.latencies(_samples(spark, sf_dir))).select(
        "sample_id", "representative", measure.LATENCIES[0]
    )


@query
def latency_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recipes.table(spark, sf_dir, "events").select("event_type", "value")
    return measure.statistics(rows, ["event_type"])


@query
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.summarize_latency(
        measure.scope_estimates(measure.latencies(_samples(spark, sf_dir)))
    )


@query
def latency_result_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).selectExpr(
        "* except (mode, path, snapshot_seq)",
        "session_id result_id",
        "case when sample_id % 101 = 0 then 'other' else mode end mode",
        "case when sample_id % 51 = 0 then '' when sample_id % 53 = 0 then 'same' else path end path",
        "case when sample_id % 59 = 0 then touched_seq else snapshot_seq end snapshot_seq",
    )
    summaries = rows.groupBy("result_id").agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "result_id", "n % 2 failures", "n - cast(n % 3 = 0 as int) successful", "cast(n % 5 = 0 as int) failed"
    ).union(spark.range(1).selectExpr("'none'", "0L", "0L", "0"))
    return measure.check_latency(measure.latencies(rows), summaries)


def _clock_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.timeline(spark, sf_dir).select("session_id", "seq", "ts")


@query
def normalized_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, _ = measure.normalize_clocks(_clock_rows(spark, sf_dir))
    return ok


@query
def rejected_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejects = measure.normalize_clocks(_clock_rows(spark, sf_dir))
    return rejects


@query
def workload_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = recipes.table(spark, sf_dir, "events").selectExpr("event_id write_index")
    return measure.final_state(writes, 1000, 64)


@query
def churn_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = trees.classify(recipes.tree_before(spark, sf_dir), recipes.tree_after(spark, sf_dir))
    # The plan leaves two kinds of changes out, so they must be reported.
    plan = recipes.churn_plan(spark, sf_dir).filter("not (action = 'mode' and session_id = 's1')")
    mismatches, _ = measure.reconcile_churn(plan, diff)
    return mismatches


@query
def churn_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = trees.classify(recipes.tree_before(spark, sf_dir), recipes.tree_after(spark, sf_dir))
    _, totals = measure.reconcile_churn(recipes.churn_plan(spark, sf_dir), diff)
    return totals.select("session_id", "add", "modify", "mode", "remove", "move", "expected_entries", "actual_entries", "ok")

