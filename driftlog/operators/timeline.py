"""Lookups and projections over typed timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlog.operators.ordered import first_per_group
from driftlog.schemas import BODIES


def typed(events: DataFrame) -> DataFrame:
    """Typed bodies from an ``event`` VARIANT column: one nullable struct per
    event type next to session_id, seq, ts and type, and the body of any type
    as VARIANT ``data``."""
    event = F.col("event")
    kind = F.try_variant_get(event, "$.type", "string")
    bodies = [
        F.when(kind == name, F.try_variant_get(event, "$.data", body)).alias(name)
        for name, body in BODIES.items()
    ]
    rest = [c for c in events.columns if c not in {"event", "session_id", "seq", "data"}]
    return events.select(
        F.try_variant_get(event, "$.session_id", "string").alias("session_id"),
        F.try_variant_get(event, "$.seq", "bigint").alias("seq"),
        F.try_variant_get(event, "$.ts", "string").alias("ts"),
        kind.alias("type"),
        *bodies,
        F.try_variant_get(event, "$.data", "variant").alias("data"),
        *rest,
    )


def index(timeline: DataFrame) -> DataFrame:
    """One row per event: its kind and the operation and tree it names."""
    return timeline.select(
        "session_id",
        "seq",
        F.col("ts").alias("timestamp"),
        F.col("type").alias("kind"),
        F.coalesce(
            "session_start.baseline_op", "snapshot.op", "mark.ref_op", "flush.op", "session_end.final_op"
        ).alias("op"),
        F.coalesce("session_start.baseline_tree", "snapshot.tree").alias("tree"),
    )


def operation_rows(timeline: DataFrame) -> DataFrame:
    """Starts and snapshots as operations; a baseline has no parent."""
    return timeline.filter(F.col("type").isin("session_start", "snapshot")).select(
        "session_id",
        "seq",
        F.coalesce("session_start.baseline_op", "snapshot.op").alias("op"),
        F.col("snapshot.parent_op").alias("parent_op"),
        F.col("snapshot.commit").alias("commit"),
        F.coalesce("session_start.baseline_tree", "snapshot.tree").alias("tree"),
    )


def inspect_operation(timeline: DataFrame, requests: DataFrame) -> DataFrame:
    """First start or snapshot of each requested (session_id, op)."""
    first = first_per_group(
        operation_rows(timeline).filter(F.col("op").isNotNull()),
        ["session_id", "op"],
        ["seq"],
        ["seq", "parent_op", "commit", "tree"],
    )
    return requests.join(first, ["session_id", "op"], "left").withColumn(
        "outcome", F.when(F.col("seq").isNull(), "unknown_operation").otherwise("found")
    )


def inspect_tree(timeline: DataFrame, requests: DataFrame) -> DataFrame:
    """Operation behind the first index row with each requested tree."""
    first = first_per_group(
        index(timeline).filter(F.col("tree").isNotNull()), ["session_id", "tree"], ["seq"], ["op"]
    )
    asked = requests.join(first, ["session_id", "tree"], "left")
    found = inspect_operation(
        timeline, asked.filter(F.col("op").isNotNull()).select("session_id", "op").distinct()
    )
    return asked.withColumnRenamed("tree", "asked_tree").join(
        found, ["session_id", "op"], "left"
    ).select(
        "session_id",
        "asked_tree",
        F.coalesce("outcome", F.lit("unknown_tree")).alias("outcome"),
        "seq",
        "op",
        "parent_op",
        "commit",
    )


def op_to_tree(entries: DataFrame) -> DataFrame:
    """Tree of each operation; the last index row wins."""
    return (
        entries.filter(F.col("op").isNotNull() & F.col("tree").isNotNull())
        .groupBy("session_id", "op")
        .agg(F.max_by("tree", "seq").alias("tree"))
    )


def missing_durable_ops(manifests: DataFrame, trees: DataFrame) -> DataFrame:
    """Sessions whose durable operation has no tree in the index."""
    asked = manifests.filter(F.col("durable_op").isNotNull()).select(
        "session_id", F.col("durable_op").alias("op")
    )
    return asked.join(trees, ["session_id", "op"], "left_anti")


def event_op() -> Column:
    """Operation an event sets as observed; marks only refer to one."""
    return F.coalesce(
        "session_start.baseline_op", "snapshot.op", "session_end.final_op", "flush.op"
    )


def observed_watermark(timeline: DataFrame) -> DataFrame:
    """Last sequence and last operation seen in each session."""
    op = event_op()
    return timeline.groupBy("session_id").agg(
        F.max("seq").alias("last_seq"),
        F.max_by(op, F.when(op.isNotNull(), F.col("seq"))).alias("last_op"),
    )


def latest_commit(timeline: DataFrame) -> DataFrame:
    """Commit of the last snapshot of each session."""
    return (
        timeline.filter(F.col("type") == "snapshot")
        .groupBy("session_id")
        .agg(F.max_by("snapshot.commit", "seq").alias("commit"))
    )


def session_status(timeline: DataFrame, pending: DataFrame, switches: DataFrame) -> DataFrame:
    """Status per session: next seq, snapshots, last operation, whether a
    window waits for its snapshot, whether recording is paused.

    ``pending``: session_id of dirty sessions; ``switches``: session_id,
    t_ms, command.
    """
    op = event_op()
    counted = timeline.groupBy("session_id").agg(
        (F.max("seq") + 1).alias("next_seq"),
        F.count_if(F.col("type") == "snapshot").alias("snapshots"),
        F.max_by(op, F.when(op.isNotNull(), F.col("seq"))).alias("last_op"),
    )
    waiting = pending.select("session_id").distinct().withColumn("pending", F.lit(True))
    paused = (
        switches.filter(F.col("command").isin("pause", "resume"))
        .groupBy("session_id")
        .agg((F.max_by("command", F.struct("t_ms", "command_id")) == "pause").alias("paused"))
    )
    return (
        counted.join(waiting, "session_id", "left")
        .join(paused, "session_id", "left")
        .select(
            "session_id",
            "next_seq",
            "snapshots",
            "last_op",
            F.coalesce("pending", F.lit(False)).alias("pending_snapshot"),
            F.coalesce("paused", F.lit(False)).alias("paused"),
        )
    )


def _plural(count: Column, noun: str) -> Column:
    return F.concat(count.cast("string"), F.lit(f" {noun}"), F.when(count == 1, "").otherwise("s"))


def _text(value: Column | str) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def describe(timeline: DataFrame) -> DataFrame:
    """Title, detail and path list of every event for display.

    Live notices may carry ``notice_detail`` and ``notice_recovery``.  An event
    of an unknown type shows its body, the VARIANT column ``data`` where there
    is one.
    """
    kind = F.col("type")
    touched = F.coalesce(F.col("touched_paths.paths"), F.array().cast("array<struct<path:string,operations:array<string>>>"))
    operations = F.array_distinct(F.flatten(F.transform(touched, lambda p: F.coalesce(p["operations"], F.array().cast("array<string>")))))
    stats = F.col("snapshot.stats")
    changed = F.lit(0).cast("bigint")
    for name in ("added", "removed", "modified", "renamed", "mode_changed"):
        changed = changed + F.coalesce(stats[name], F.lit(0))
    has_notice = "notice_detail" in timeline.columns
    notice = (
        F.concat(_text("notice_detail"), F.lit(" "), _text("notice_recovery")) if has_notice else F.lit("")
    )
    body = F.to_json("data") if "data" in timeline.columns else F.lit(None).cast("string")
    touched_count = F.size(touched)
    title = (
        F.when(kind == "session_start", "Session started")
        .when(kind == "touched_paths", _plural(touched_count, "touched path"))
        .when(kind == "snapshot", F.concat(F.lit("Snapshot · "), _plural(changed, "changed path")))
        .when(kind == "mark", F.concat(F.lit("Mark · "), _text("mark.label")))
        .when(kind == "overflow", "Watcher overflow")
        .when(kind == "sse_overflow", "Live stream overflow")
        .when(kind == "sequence_gap", "Live sequence discontinuity")
        .when(kind == "flush", "Durable flush")
        .when(kind == "session_end", "Session ended")
        .otherwise(F.coalesce(kind, F.lit("unknown")))
    )
    joined_ops = F.array_join(operations, ", ")
    detail = (
        F.when(kind == "session_start",
               F.concat(_text("session_id"), F.lit(" · "),
                        _text(F.array_join("session_start.roots", ", "))))
        .when(kind == "touched_paths",
              F.concat(F.coalesce("touched_paths.raw_events", F.lit(0)).cast("string"),
                       F.lit(" watcher events · "),
                       F.when(joined_ops == "", "no operation category").otherwise(joined_ops)))
        .when(kind == "snapshot",
              F.concat(_text("snapshot.op"), F.lit(" → "), _text("snapshot.tree"),
                       F.when(F.col("snapshot.truncated"), " · listing truncated").otherwise("")))
        .when(kind == "mark", _text("mark.ref_op"))
        .when(kind == "overflow",
              F.concat(_text("overflow.source"), F.lit(" · recovery: "),
                       F.coalesce("overflow.recovery", F.lit("unknown"))))
        .when(kind.isin("sse_overflow", "sequence_gap"), notice)
        .when(kind == "flush", _text("flush.op"))
        .when(kind == "session_end", _text("session_end.reason"))
        .otherwise(F.coalesce(F.to_json("error"), body, F.lit("{}")))
    )
    paths = (
        F.when(kind == "touched_paths", F.transform(touched, lambda p: p["path"]))
        .when(kind == "snapshot",
              F.transform("snapshot.changes", lambda c: F.concat(c["kind"], F.lit(": "), c["path"])))
    )
    return timeline.select(
        "session_id", "seq", title.alias("title"), detail.alias("detail"), paths.alias("paths")
    )


def changes(timeline: DataFrame) -> DataFrame:
    """One row per listed change of a snapshot."""
    return timeline.filter(F.col("type") == "snapshot").select(
        "session_id", "seq", F.col("snapshot.op").alias("op"), F.inline("snapshot.changes")
    )


def touches(timeline: DataFrame) -> DataFrame:
    """One row per path of an activity window."""
    return timeline.filter(F.col("type") == "touched_paths").select(
        "session_id", "seq", F.inline("touched_paths.paths")
    )
