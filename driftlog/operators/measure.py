"""Measurements: session summaries, overhead, latency, workload checks."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlog.functions.values import clock_ns, rule_violations
from driftlog.operators.ordered import attach_facts, first_per_group, ordered_scan, seq_chunk
from driftlog.session import save_and_reload

# Sample modes, latency names and the required numbers of a result.
MODES = ("isolated", "burst", "continuous")
VALUE_CHUNKS = 256
PART_VALUES = 65_536
LATENCIES = (
    "watcher_detection_wall_estimate",
    "debounce_projector_daemon_wall",
    "touched_sse_delivery_wall_estimate",
    "edit_completion_to_touched_receipt_monotonic",
    "touched_receipt_to_snapshot_receipt_monotonic",
    "snapshot_creation_to_receipt_wall_estimate",
    "edit_completion_to_snapshot_receipt_monotonic",
    "edit_start_to_snapshot_receipt_monotonic",
)
PAIRED_NUMBERS = (
    "off_workload_seconds",
    "on_workload_seconds",
    "off_baseline_setup_seconds",
    "on_baseline_setup_seconds",
    "recorder_baseline_seconds",
    "flush_time_to_durable_seconds",
    "cold_session_open_and_index_seconds",
    "warm_index_op_to_tree_lookup_ns",
    "materialization_seconds",
    "events",
    "materialized_files",
)


def summarize(timeline: DataFrame) -> DataFrame:
    """Counts per session: events, snapshots, windows, distinct touched paths,
    raw notifications, operations (sorted by name), overflows."""
    kind = F.col("type")
    counts = timeline.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(kind == "snapshot").alias("snapshot_count"),
        F.count_if(kind == "touched_paths").alias("touched_path_windows"),
        F.sum(F.when(kind == "touched_paths", F.coalesce("touched_paths.raw_events", F.lit(0))).otherwise(0))
        .alias("raw_watcher_events"),
        F.count_if(kind == "overflow").alias("overflow_events"),
    )
    per_path = (
        timeline.filter(kind == "touched_paths")
        .select("session_id", F.explode("touched_paths.paths").alias("p"))
        .select("session_id", F.col("p.path").alias("path"), F.explode_outer("p.operations").alias("operation"))
        .groupBy("session_id", "path")
        .agg(F.collect_set("operation").alias("operations"))
    )
    # Few operations exist, so the set per session stays tiny.
    touched = per_path.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("distinct_touched_paths"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("operations")))).alias(
            "observed_touch_operations"
        ),
    )
    return counts.join(touched, "session_id", "left").select(
        "session_id",
        "events",
        "snapshot_count",
        "touched_path_windows",
        F.coalesce("distinct_touched_paths", F.lit(0)).alias("distinct_touched_paths"),
        "raw_watcher_events",
        F.coalesce("observed_touch_operations", F.array().cast("array<string>")).alias(
            "observed_touch_operations"
        ),
        "overflow_events",
    )


def overhead(runs: DataFrame) -> DataFrame:
    """On minus off per run (run_id, recording, wall_seconds); several rows of
    a side are averaged.  No percentage when off took no time."""
    exact = F.col("wall_seconds").cast("decimal(28,6)")

    def side(name: str) -> Column:
        mine = F.col("recording") == name
        return F.sum(F.when(mine, exact)).cast("double") / F.nullif(
            F.count_if(mine), F.lit(0)
        )

    gap = F.col("on_seconds") - F.col("off_seconds")
    return (
        runs.groupBy("run_id")
        .agg(side("off").alias("off_seconds"), side("on").alias("on_seconds"))
        .select(
            "run_id",
            "off_seconds",
            "on_seconds",
            gap.alias("overhead_seconds"),
            (gap / F.nullif(F.col("off_seconds"), F.lit(0.0)) * 100).alias("overhead_percent"),
        )
    )


def check_paired(results: DataFrame, expected_mutations: int | None = None) -> DataFrame:
    """Broken rules of paired results, one row per rule.

    ``results``: run_id, schema, off_mutations, on_mutations, the numbers in
    ``PAIRED_NUMBERS`` and baseline_excluded.  A column that is absent breaks
    its rule like a NULL.
    """
    needed = ("schema", "off_mutations", "on_mutations", "baseline_excluded", *PAIRED_NUMBERS)
    for name in needed:
        if name not in results.columns:
            results = results.withColumn(name, F.lit(None).cast("boolean" if name == "baseline_excluded" else "double"))
    checks = [
        ("schema", F.col("schema") == 1),
        ("equal_mutations", F.col("off_mutations").eqNullSafe(F.col("on_mutations"))),
    ]
    if expected_mutations is not None:
        checks.append(("expected_mutations", F.col("off_mutations") == expected_mutations))
    checks += [(f"non_negative_{name}", F.col(name) >= 0) for name in PAIRED_NUMBERS]
    checks += [
        ("has_events", F.col("events") >= 1),
        ("baseline_excluded", F.col("baseline_excluded")),
    ]
    return results.select("run_id", F.explode(rule_violations(checks)).alias("rule"))


def match_edits(edits: DataFrame, timeline: DataFrame) -> DataFrame:
    """First window holding each edit's path and the first later snapshot of
    the session; the snapshot need not list the path."""
    paths = timeline.filter(F.col("type") == "touched_paths").select(
        "session_id", "seq", F.explode("touched_paths.paths.path").alias("path")
    )
    first = paths.groupBy("session_id", "path").agg(F.min("seq").alias("touched_seq"))
    later = ordered_scan(
        timeline.select("session_id", "seq", "type"),
        ["session_id"],
        ["seq"],
        seq_chunk("seq"),
        upcoming={"snapshot_seq": F.when(F.col("type") == "snapshot", F.col("seq"))},
    ).filter(F.col("type") == "touched_paths")
    return (
        edits.join(first, ["session_id", "path"], "left")
        .join(
            later.select("session_id", F.col("seq").alias("touched_seq"), "snapshot_seq"),
            ["session_id", "touched_seq"],
            "left",
        )
        .select(
            *edits.columns,
            F.when(F.col("snapshot_seq").isNotNull(), F.col("touched_seq")).alias("touched_seq"),
            "snapshot_seq",
            F.when(F.col("snapshot_seq").isNull(), "failed").otherwise("ok").alias("status"),
        )
    )


def latencies(samples: DataFrame) -> DataFrame:
    """Eight intervals in milliseconds.  ``*_mono`` and ``*_wall`` columns are
    nanoseconds of different clocks and are never subtracted from each other."""
    def ms(end: str, start: str) -> Column:
        return (F.col(end) - F.col(start)) / F.lit(1_000_000.0)

    terms = (
        ms("watcher_wall", "start_wall"),
        ms("touched_created_wall", "watcher_wall"),
        ms("touched_received_wall", "touched_created_wall"),
        ms("touched_received_mono", "completion_mono"),
        ms("snapshot_received_mono", "touched_received_mono"),
        ms("snapshot_received_wall", "snapshot_created_wall"),
        ms("snapshot_received_mono", "completion_mono"),
        ms("snapshot_received_mono", "start_mono"),
    )
    return samples.select(
        "*", *[F.when(F.col("status") == "ok", t).alias(n) for n, t in zip(LATENCIES, terms)]
    )


def scope_estimates(samples: DataFrame) -> DataFrame:
    """Keep the watcher estimate of the earliest edit per window only."""
    ok = F.col("status") == "ok"
    leaders = first_per_group(
        samples.filter(ok), ["session_id", "touched_seq"], ["start_wall", "sample_id"], ["sample_id"]
    ).select("session_id", "sample_id", F.lit(True).alias("_leads"))
    leads = F.coalesce("_leads", F.lit(False))
    return (
        samples.join(leaders, ["session_id", "sample_id"], "left")
        .withColumn("representative", F.when(ok, leads))
        .withColumn(LATENCIES[0], F.when(leads, F.col(LATENCIES[0])))
        .drop("_leads")
    )


PERCENTS = (50, 95, 99)


def _ranks() -> list[Column]:
    """The 0-based ranks that the percentiles lie between."""
    exact = [(F.col("count") - 1) * F.lit(p) / F.lit(100.0) for p in PERCENTS]
    return [side(rank) for rank in exact for side in (F.floor, F.ceil)]


def statistics(
    values: DataFrame, keys: Sequence[str], value: str = "value", weight: str | None = None
) -> DataFrame:
    """Exact count, min, p50, p95, p99, max per key, linearly interpolated;
    ``weight`` names a column of repeat counts.

    A key may hold most rows, so equal values are counted first.  The range of
    a key's values is cut into equal parts, whose counts tell which parts hold
    the asked ranks and how many values lie below; only these parts are kept,
    and cut again while one holds over ``PART_VALUES`` values.  So a narrow or
    lopsided distribution is cut like any other, and only small parts of a key
    are ever ordered.
    """
    number = F.col(value).cast("double")
    times = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    counted = save_and_reload(
        values.filter(F.col(value).isNotNull())
        .select(*keys, number.alias("_v"), times.alias("_w"))
        .groupBy(*keys, "_v")
        .agg(F.sum("_w").alias("_c")),
        "counted",
    )
    totals = counted.groupBy(*keys).agg(
        F.sum("_c").alias("count"), F.min("_v").alias("min"), F.max("_v").alias("max")
    )
    totals = save_and_reload(totals, "totals")
    # A part of a key: its range, and the number of values below it.
    parts = totals.select(
        *keys, F.lit(0).cast("bigint").alias("_cut"), F.col("min").alias("_low"), F.col("max").alias("_high"),
        F.lit(0).cast("bigint").alias("_below"), "count",
    )
    kept = counted.withColumn("_cut", F.lit(0).cast("bigint"))
    while True:
        width = F.col("_high") - F.col("_low")
        within = F.least(F.floor((F.col("_v") - F.col("_low")) / width * VALUE_CHUNKS), F.lit(VALUE_CHUNKS - 1))
        cut = attach_facts(kept, parts, [*keys, "_cut"], F.col("_v"), how="inner").select(
            *keys, "_v", "_c", "_below", "count",
            (F.col("_cut") * VALUE_CHUNKS + F.when(width > 0, within).otherwise(0)).cast("bigint").alias("_next"),
            "_cut",
        )
        counts = cut.groupBy(*keys, "_cut", "_next").agg(
            F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_values"), F.min("_v").alias("_low"),
            F.max("_v").alias("_high"), F.max("_below").alias("_below"), F.max("count").alias("count"),
        )
        before = Window.partitionBy(*keys, "_cut").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
        holds = [(rank >= F.col("_below")) & (rank < F.col("_below") + F.col("_n")) for rank in _ranks()]
        asked = placed.filter(functools.reduce(operator.or_, holds)).select(
            *keys, F.col("_next").alias("_cut"), "_low", "_high", "_below", "count", "_values"
        )
        parts = save_and_reload(asked, "parts")
        chosen = attach_facts(
            cut.select(*keys, F.col("_next").alias("_cut"), "_v", "_c"), parts.select(*keys, "_cut"), [*keys, "_cut"],
            F.col("_v"), how="left_semi",
        )
        kept = save_and_reload(chosen, "kept")
        if not parts.filter(F.col("_values") > PART_VALUES).head(1):
            break
    through = ordered_scan(kept, [*keys, "_cut"], ["_v"], F.lit(0), sums={"_through": F.col("_c")}).join(
        parts.select(*keys, "_cut", "_below", "count"), [*keys, "_cut"]
    )
    upto = F.col("_below") + F.col("_through")
    picks = [
        F.max(F.when((upto > rank) & (upto - F.col("_c") <= rank), F.col("_v"))).alias(f"_{side}{percent}")
        for rank, (percent, side) in zip(_ranks(), [(p, s) for p in PERCENTS for s in ("lo", "hi")], strict=True)
    ]
    found = through.groupBy(*keys).agg(*picks).join(totals, list(keys))

    def at(percent: int) -> Column:
        rank = (F.col("count") - 1) * F.lit(percent) / F.lit(100.0)
        lo, hi = F.col(f"_lo{percent}"), F.col(f"_hi{percent}")
        return F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (rank - F.floor(rank))).alias(f"p{percent}")

    return found.select(*keys, "count", "min", at(50), at(95), at(99), "max")


def summarize_latency(samples: DataFrame) -> DataFrame:
    """Statistics of every latency over all samples and by mode, with sample
    counts; ``scope`` is ``all`` or the mode."""
    scopes = F.explode(F.array(F.lit("all"), F.col("mode"))).alias("scope")
    counts = (
        samples.groupBy("mode")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("status") == "ok").alias("ok"),
        )
        .select(scopes, "n", "ok")
        .groupBy("scope")
        .agg(
            F.sum("n").alias("samples"),
            F.sum("ok").alias("successful"),
            (F.sum("n") - F.sum("ok")).alias("failed"),
        )
    )
    # Values are counted per mode first; "all" adds up the counts.
    counted = (
        samples.filter(F.col("status") == "ok")
        .unpivot(["mode"], list(LATENCIES), "metric", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("mode", "metric", "value")
        .agg(F.count(F.lit(1)).alias("times"))
        .select(scopes, "metric", "value", "times")
    )
    return statistics(counted, ["scope", "metric"], weight="times").join(counts, "scope").select(
        "scope", "metric", "samples", "successful", "failed", "count", "min", "p50", "p95", "p99", "max"
    )


def check_latency(samples: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Broken rules of latency samples of each result (result_id): one row per
    sample and rule, and one per result-level rule with a NULL sample.

    ``summaries`` (result_id, failures, successful, failed) holds a row per
    result; a result may report no failure, must have samples, and its counts
    must be those of its samples.
    """
    completion = F.col("edit_completion_to_snapshot_receipt_monotonic")
    per_sample = samples.select(
        "result_id",
        "sample_id",
        F.explode(
            rule_violations(
                [
                    ("completed", F.col("status") == "ok"),
                    ("mode", F.col("mode").isin(*MODES)),
                    ("path", F.coalesce(F.col("path"), F.lit("")) != ""),
                    ("order", F.col("touched_seq") < F.col("snapshot_seq")),
                    ("completion_number", completion.isNotNull()),
                    ("completion_negative", completion >= 0),
                ]
            )
        ).alias("rule"),
    )
    repeated = (
        samples.filter(F.col("path").isNotNull())
        .groupBy("result_id", "path")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1)
        .groupBy("result_id")
        .agg(F.count(F.lit(1)).alias("_p"))
        .select("result_id", F.lit(None).cast(samples.schema["sample_id"].dataType).alias("sample_id"),
                F.lit("path_repeated").alias("rule"))
    )
    present = samples.groupBy("result_id").agg(
        *[F.max(F.col("mode") == mode).alias(mode) for mode in MODES]
    )
    missing = present.select(
        "result_id",
        F.lit(None).cast(samples.schema["sample_id"].dataType).alias("sample_id"),
        F.explode(rule_violations([(f"missing_{mode}", F.col(mode)) for mode in MODES])).alias("rule"),
    )
    broken = per_sample.unionByName(repeated).unionByName(missing)
    if summaries is None:
        return broken
    counts = samples.groupBy("result_id").agg(F.count(F.lit(1)).alias("_n"))
    judged = summaries.join(counts, "result_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rules = rule_violations(
        [
            ("failures", F.col("failures") == 0),
            ("no_samples", F.col("_n") > 0),
            ("summary_counts", (F.col("successful") == F.col("_n")) & (F.col("failed") == 0)),
        ]
    )
    return broken.unionByName(
        judged.select(
            "result_id",
            F.lit(None).cast(samples.schema["sample_id"].dataType).alias("sample_id"),
            F.explode(rules).alias("rule"),
        )
    )


def normalize_clocks(rows: DataFrame, column: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows with ``clock_ns`` (UTC nanoseconds), and rows whose time is
    invalid or has no offset."""
    timed = rows.withColumn("clock_ns", clock_ns(F.col(column)))
    return (
        timed.filter(F.col("clock_ns").isNotNull()),
        timed.filter(F.col("clock_ns").isNull()).drop("clock_ns"),
    )


def write_payload(index: Column, size: Column) -> Column:
    """Content of a workload write: its 20-digit index and a colon, repeated
    and cut to size."""
    prefix = F.concat(F.lpad(index.cast("string"), 20, "0"), F.lit(":"))
    return F.substr(F.repeat(prefix, F.ceil(size / F.lit(21)).cast("int")), F.lit(1), size)


def final_state(writes: DataFrame, working_set: int, size: int) -> DataFrame:
    """Content of every slot after setup and a log of writes (write_index):
    write i hits slot i mod working_set; untouched slots keep the setup."""
    index = F.col("write_index")
    last = writes.groupBy((index % working_set).alias("slot")).agg(
        F.max(index).alias("last_write"), F.count(F.lit(1)).alias("writes")
    )
    setup = writes.sparkSession.range(working_set).select(F.col("id").alias("slot"))
    payload = write_payload(
        F.coalesce(F.col("last_write") + working_set, F.col("slot")), F.lit(size).cast("int")
    )
    return setup.join(last, "slot", "left").select(
        "slot",
        F.concat(F.lit("file-"), F.lpad(F.col("slot").cast("string"), 8, "0"), F.lit(".dat")).alias("path"),
        F.coalesce("writes", F.lit(0)).alias("writes"),
        payload.alias("payload"),
    )


def reconcile_churn(plan: DataFrame, observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Planned changes against an observed diff (session_id, path, kind).

    ``plan``: session_id, path, action, moved_to (for a move).  Returns the
    rows that disagree, and counts per session with the expected number of
    diff entries: adds, modifies, removes, and two for each move.
    """
    expected_kind = F.when(F.col("action") == "add", "added").when(
        F.col("action") == "modify", "modified"
    ).when(F.col("action") == "mode", "mode_changed").otherwise("removed")
    sides = F.when(
        F.col("action") == "move",
        F.array(
            F.struct(F.col("path"), F.lit("removed").alias("want")),
            F.struct(F.col("moved_to").alias("path"), F.lit("added").alias("want")),
        ),
    ).otherwise(F.array(F.struct(F.col("path"), expected_kind.alias("want"))))
    wanted = plan.select("session_id", F.inline(sides))
    both = wanted.join(observed.select("session_id", "path", "kind"), ["session_id", "path"], "full_outer")
    mismatches = both.filter(~F.col("want").eqNullSafe(F.col("kind"))).select(
        "session_id", "path", F.col("want").alias("planned"), F.col("kind").alias("observed")
    )
    planned = plan.groupBy("session_id").agg(
        *[F.count_if(F.col("action") == a).alias(a) for a in ("add", "modify", "mode", "remove", "move")]
    )
    seen = observed.groupBy("session_id").agg(F.count(F.lit(1)).alias("actual_entries"))
    expected = F.col("add") + F.col("modify") + F.col("mode") + F.col("remove") + 2 * F.col("move")
    totals = (
        planned.join(seen, "session_id", "full_outer")
        .withColumn("expected_entries", F.coalesce(expected, F.lit(0)))
        .withColumn("actual_entries", F.coalesce("actual_entries", F.lit(0)))
        .withColumn("ok", F.col("expected_entries") == F.col("actual_entries"))
    )
    return mismatches, totals


