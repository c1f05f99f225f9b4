"""Delivery: integrity, resume, batches, retries, acknowledgements, sync."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlog.functions.paths import bad_segment
from driftlog.functions.values import checkpoint_hex, redact, response_class, rule_violations
from driftlog.operators.ordered import attach_facts, first_per_group, ordered_scan, seq_chunk
from driftlog.operators.segments import BatchLimit, batch_bounds

MAX_RETRIES = 8
FIRST_WAIT_MS = 50
MAX_WAIT_MS = 5_000


# ------------------------------------------------------------ checkpoints


def normalize_checkpoints(rows: DataFrame, column: str = "commit") -> tuple[DataFrame, DataFrame]:
    """Rows with a canonical ``checkpoint`` key, and the rows without one."""
    keyed = rows.withColumn("checkpoint", checkpoint_hex(F.col(column)))
    return (
        keyed.filter(F.col("checkpoint").isNotNull()),
        keyed.filter(F.col("checkpoint").isNull()).drop("checkpoint"),
    )


def dangling(snapshots: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Visible snapshot events whose checkpoint is not available."""
    ok, rejects = normalize_checkpoints(snapshots)
    stored, _ = normalize_checkpoints(checkpoints)
    absent = ok.join(
        stored.select("session_id", "checkpoint").distinct(), ["session_id", "checkpoint"], "left_anti"
    )
    return absent.select("session_id", "seq", "commit", F.lit("missing").alias("reason")).unionByName(
        rejects.select("session_id", "seq", "commit", F.lit("invalid").alias("reason"))
    )


def orphans(snapshots: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Stored checkpoints no visible event names yet; these are allowed."""
    ok, _ = normalize_checkpoints(snapshots)
    stored, _ = normalize_checkpoints(checkpoints)
    return stored.join(
        ok.select("session_id", "checkpoint").distinct(), ["session_id", "checkpoint"], "left_anti"
    ).select("session_id", "checkpoint")


def audit_names(sessions: DataFrame) -> DataFrame:
    """Broken naming rules per session (session_id, ref_prefix) and the ref."""
    prefix, session = F.col("ref_prefix"), F.col("session_id")
    ref = F.concat(F.regexp_replace(prefix, "/+$", ""), F.lit("/"), session)
    rules = rule_violations(
        [
            ("prefix_under_refs", prefix.startswith("refs/")),
            ("prefix_not_heads", ~prefix.startswith("refs/heads")),
            ("prefix_no_double_slash", ~prefix.contains("//")),
            ("prefix_no_trailing_slash", ~prefix.endswith("/")),
            ("session_not_empty", session != ""),
            ("session_no_slash", ~session.contains("/")),
            ("session_no_backslash", ~session.contains("\\")),
            ("session_no_nul", ~session.contains("\u0000")),
            ("session_no_dots", ~session.contains("..")),
        ]
    )
    return sessions.select("session_id", "ref_prefix", ref.alias("ref"), F.explode(rules).alias("rule"))


def advance_plan(
    requests: DataFrame, tips: DataFrame, cursors: DataFrame, broken_names: DataFrame | None = None
) -> DataFrame:
    """Compare-and-swap decision per session.

    ``requests``: session_id, wanted; ``tips``: session_id, tip; ``cursors``:
    session_id, expected.  Ids are normalized before they are compared.
    """
    plan = (
        requests.select("session_id", checkpoint_hex(F.col("wanted")).alias("wanted"))
        .join(tips.select("session_id", checkpoint_hex(F.col("tip")).alias("tip")), "session_id", "left")
        .join(
            cursors.select("session_id", checkpoint_hex(F.col("expected")).alias("expected")),
            "session_id",
            "left",
        )
    )
    refused = F.lit(False)
    if broken_names is not None:
        plan = plan.join(
            broken_names.select("session_id").distinct().withColumn("refused", F.lit(True)),
            "session_id",
            "left",
        )
        refused = F.coalesce("refused", F.lit(False))
    outcome = (
        F.when(refused, "invalid_name")
        .when(F.col("wanted").isNull(), "invalid_commit")
        .when(F.col("tip") == F.col("wanted"), "already_there")
        .when(F.col("tip").isNull(), "create")
        .when(F.col("tip") == F.col("expected"), "advance")
        .when(F.col("expected").isNotNull(), "conflict")
        .otherwise("conflict_unexpected")
    )
    return plan.select("session_id", "wanted", "tip", "expected", outcome.alias("outcome"))


# ------------------------------------------------------------ event batches


def resume(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Where publication continues per session.

    ``events``: session_id, seq; ``cursors``: session_id, delivered_seq (may
    be absent or NULL).  All adjacent sequence numbers must differ by one.
    """
    followed = ordered_scan(
        events.select("session_id", "seq").withColumn("copy", F.monotonically_increasing_id()),
        ["session_id"],
        ["seq", "copy"],
        seq_chunk("seq"),
        prev={"prev_seq": F.col("seq")},
    )
    gaps = first_per_group(
        followed.filter(F.col("seq") != F.col("prev_seq") + 1),
        ["session_id"],
        ["seq", "prev_seq"],
        ["prev_seq", "seq"],
    ).select("session_id", F.col("prev_seq").alias("gap_after"), F.col("seq").alias("gap_next"))
    spans = events.groupBy("session_id").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )
    start = F.greatest(F.col("first_seq"), F.coalesce(F.col("delivered_seq") + 1, F.lit(0)))
    outcome = (
        F.when(F.col("gap_after").isNotNull(), "not_contiguous")
        .when(F.col("delivered_seq").isNull() & (F.col("first_seq") != 0), "not_from_start")
        .when(F.col("last_seq") <= F.col("delivered_seq"), "nothing_left")
        .when(F.col("first_seq") > F.col("delivered_seq") + 1, "gap_after_delivered")
        .otherwise("publish")
    )
    return (
        spans.join(cursors.select("session_id", "delivered_seq"), "session_id", "left")
        .join(gaps, "session_id", "left")
        .withColumn("outcome", outcome)
        .select(
            "session_id",
            "outcome",
            F.when(F.col("outcome") == "publish", start).alias("start_seq"),
            "last_seq",
            F.when(F.col("outcome") == "nothing_left", F.col("delivered_seq")).alias("accepted_seq"),
            "gap_after",
            "gap_next",
        )
    )


def to_publish(events: DataFrame, plan: DataFrame) -> DataFrame:
    """Events of sessions that may publish, from their start on."""
    ready = plan.filter(F.col("outcome") == "publish").select("session_id", "start_seq")
    return (
        attach_facts(events, ready, ["session_id"], F.col("seq"), how="inner")
        .filter(F.col("seq") >= F.col("start_seq"))
        .drop("start_seq")
    )


def batches(events: DataFrame, limit: BatchLimit = BatchLimit()) -> DataFrame:
    """Greedy delivery batches of contiguous events (session_id, seq, len).

    An event over the byte limit stops its session: batches before it are
    ready, it is ``oversize``, later ones are not reached.  Only the last
    ready batch of an undisturbed session is final and carries a watermark.
    """
    bounds = batch_bounds(events, limit)
    per_session = bounds.groupBy("session_id").agg(
        F.min(F.when(F.col("bytes") > limit.max_bytes, F.col("first_seq"))).alias("stop_seq"),
        F.max("last_seq").alias("end_seq"),
    )
    outcome = (
        F.when(F.col("stop_seq").isNull() | (F.col("first_seq") < F.col("stop_seq")), "ready")
        .when(F.col("first_seq") == F.col("stop_seq"), "oversize")
        .otherwise("not_reached")
    )
    return attach_facts(bounds, per_session, ["session_id"], F.col("first_seq")).select(
        "session_id",
        "first_seq",
        "last_seq",
        "events",
        "bytes",
        outcome.alias("outcome"),
        ((outcome == "ready") & (F.col("last_seq") == F.col("end_seq"))).alias("is_final"),
    )


def attempt_outcomes(attempts: DataFrame) -> DataFrame:
    """Class of every delivery attempt; a conflict only counts as success
    with an acknowledgement that proves the batch (``ack_proves``)."""
    kind = response_class(F.col("status"))
    return attempts.withColumn("class", kind).withColumn(
        "delivered",
        (kind == "success") | ((kind == "conflict") & F.coalesce("ack_proves", F.lit(False))),
    )


def retry_schedule(attempts: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Wait after each retryable attempt of a request.

    ``attempts``: request_id, attempt (from 1), status, retry_after (seconds).
    The backoff doubles with every retry, also when a server's Retry-After
    replaces it.  Attempts after the first ``max_retries`` + 1 have no wait and
    are reported with ``over_limit``.  A request has few attempts, which bounds
    its window.
    """
    kind = response_class(F.col("status"))
    backoff = F.least(
        F.lit(FIRST_WAIT_MS) * F.pow(F.lit(2.0), F.least(F.col("attempt") - 1, F.lit(30))),
        F.lit(float(MAX_WAIT_MS)),
    ).cast("bigint")
    wait = F.when(
        (F.col("class") == "retry") & (F.col("attempt") <= max_retries),
        F.coalesce(F.col("retry_after").cast("bigint") * 1000, backoff),
    )
    earlier = Window.partitionBy("request_id").orderBy("attempt").rowsBetween(
        Window.unboundedPreceding, -1
    )
    ends = F.coalesce(
        F.max(F.col("wait_ms").isNull()).over(earlier), F.lit(False)
    )
    over = F.col("attempt") > max_retries + 1
    return (
        attempts.withColumn("class", kind)
        .withColumn("wait_ms", wait)
        .select(
            "request_id",
            "attempt",
            "class",
            "wait_ms",
            F.coalesce(F.sum("wait_ms").over(earlier), F.lit(0)).alias("started_after_ms"),
            ((F.col("class") == "retry") & (F.col("attempt") == max_retries + 1)).alias("gave_up"),
            over.alias("over_limit"),
            ends.alias("after_end"),
        )
        .filter(~F.col("after_end") | F.col("over_limit"))
        .drop("after_end")
    )


def validate_acks(sent: DataFrame, acks: DataFrame) -> DataFrame:
    """Check acknowledgements of batches (session_id, last_seq, durable_seq
    on the final one) against (session_id, last_seq, accepted_through_seq,
    durable_through_seq)."""
    verdict = (
        F.when(F.col("accepted_through_seq").isNull(), "missing")
        .when(F.col("accepted_through_seq") < F.col("last_seq"), "short")
        .when(F.col("durable_seq").isNotNull() & F.col("durable_through_seq").isNull(), "no_durable")
        .when(F.col("durable_through_seq") < F.col("durable_seq"), "durable_short")
        .otherwise("ok")
    )
    return sent.join(acks, ["session_id", "last_seq"], "left").select(
        "session_id",
        "last_seq",
        "durable_seq",
        "accepted_through_seq",
        "durable_through_seq",
        verdict.alias("verdict"),
    )


def flush_outcomes(
    flushes: DataFrame, journals: DataFrame, commits: DataFrame, acks: DataFrame
) -> DataFrame:
    """Gate of every flush (session_id, target_seq, checkpoint).

    ``journals``: session_id, journal_end; ``commits``: session_id, commit of
    the latest snapshot; ``acks``: session_id, target_seq,
    accepted_through_seq, durable_through_seq.
    """
    facts = journals.join(commits, "session_id", "left")
    joined = attach_facts(flushes, facts, ["session_id"], F.col("target_seq")).join(
        acks, ["session_id", "target_seq"], "left"
    )
    commit = F.coalesce("checkpoint", "commit")
    outcome = (
        F.when(~F.col("journal_end").eqNullSafe(F.col("target_seq")), "journal_end")
        .when(commit.isNull(), "no_checkpoint")
        .when(checkpoint_hex(commit).isNull(), "invalid_checkpoint")
        .when(F.col("accepted_through_seq").isNull(), "not_acknowledged")
        .when(F.col("accepted_through_seq") < F.col("target_seq"), "accepted_short")
        .when(F.col("durable_through_seq") < F.col("target_seq"), "durable_short")
        .otherwise("durable")
    )
    return joined.select(
        "session_id", "target_seq", checkpoint_hex(commit).alias("checkpoint"), outcome.alias("outcome")
    )


def durable_watermarks(outcomes: DataFrame) -> DataFrame:
    """Highest durable sequence per session and its checkpoint."""
    return (
        outcomes.filter(F.col("outcome") == "durable")
        .groupBy("session_id")
        .agg(
            F.max("target_seq").alias("durable_seq"),
            F.max_by("checkpoint", "target_seq").alias("checkpoint"),
        )
    )


# ------------------------------------------------------------ directory sync

# Immutable repository files (operations and views, index
# segments, loose objects, pack files with their six extensions).
IMMUTABLE_FILES = (
    r"^(?:op_store/(?:operations|views)/[0-9A-Fa-f]+"
    r"|index/(?:segments|changed_paths)/[0-9A-Fa-f]+"
    r"|store/git/objects/[0-9A-Fa-f]{2}/(?:[0-9A-Fa-f]{38}|[0-9A-Fa-f]{62})"
    r"|store/git/objects/pack/pack-(?:[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})"
    r"\.(?:pack|idx|rev|bitmap|promisor|mtimes))$"
)


def immutable_file(path: Column) -> Column:
    return path.rlike(IMMUTABLE_FILES)


def sync_plan(source: DataFrame, dest: DataFrame, can_link: bool = True) -> DataFrame:
    """Action per file (session_id, path, bytes, digest, file_type).

    Immutable files are reused by name alone; others are reused only when
    length and digest agree.
    """
    old = dest.select(
        "session_id", "path", F.col("bytes").alias("dest_bytes"), F.col("digest").alias("dest_digest"),
        F.lit(True).alias("in_dest"),
    )
    new = source.select(
        "session_id", "path", "bytes", "digest", "file_type", F.lit(True).alias("in_source")
    )
    joined = new.join(old, ["session_id", "path"], "full_outer")
    fixed = immutable_file(F.col("path"))
    equal = (F.col("bytes") == F.col("dest_bytes")) & (F.col("digest") == F.col("dest_digest"))
    action = (
        F.when(F.col("in_source") & (F.col("file_type") == "symlink"), "error_symlink")
        .when(F.col("in_source").isNull(), F.when(fixed, "keep").otherwise("remove"))
        .when(F.col("in_dest").isNull(), F.when(fixed & F.lit(can_link), "link").otherwise("copy"))
        .when(fixed | F.coalesce(equal, F.lit(False)), "reuse")
        .otherwise("replace")
    )
    return joined.select(
        "session_id",
        "path",
        action.alias("action"),
        F.when(action.isin("copy", "replace"), F.col("bytes")).otherwise(0).cast("bigint").alias("bytes_copied"),
    )


def sync_stats(plan: DataFrame) -> DataFrame:
    """Totals per session of a sync plan."""
    names = {"link": "files_linked", "copy": "files_copied", "replace": "files_replaced",
             "reuse": "files_reused", "remove": "files_removed"}
    return plan.groupBy("session_id").agg(
        *[F.count_if(F.col("action") == action).alias(name) for action, name in names.items()],
        F.sum("bytes_copied").alias("bytes_copied"),
        F.count_if(F.col("action") == "error_symlink").alias("errors"),
    )


def store_composition(listing: DataFrame) -> DataFrame:
    """Immutable and mutable objects and bytes per session."""
    return (
        listing.withColumn("immutable", immutable_file(F.col("path")))
        .groupBy("session_id", "immutable")
        .agg(F.count(F.lit(1)).alias("objects"), F.sum("bytes").alias("bytes"))
    )


# ------------------------------------------------------------ logs, listings


def redact_log(log: DataFrame, secrets: DataFrame) -> DataFrame:
    """Messages (session_id, message_id, message) without the secrets
    (session_id, secrets) of their session."""
    return attach_facts(log, secrets, ["session_id"], F.col("message_id")).select(
        "session_id", "message_id", redact(F.col("message"), F.col("secrets")).alias("message")
    )


def folder_of(prefix: str | Column) -> Column:
    """A prefix as a folder name that ends in one slash; NULL when a segment
    of it is empty, ``.`` or ``..``.  Outer blanks and slashes do not count."""
    bare = F.btrim(F.btrim(F.lit(prefix) if isinstance(prefix, str) else prefix), F.lit("/"))
    return F.when(~bad_segment(bare), F.concat(bare, F.lit("/")))


def audit_listing(listing: DataFrame, prefix: str) -> DataFrame:
    """Broken rules of an object listing (key_name, size) under a prefix: one
    row per key and rule with the number of listed objects.  An unusable prefix
    is the only row, as rule ``bad_prefix``."""
    exact = folder_of(prefix)
    key = F.col("key_name")
    inside = key.startswith(exact)
    relative = F.substr(key, F.length(exact) + 1)
    usable = listing.filter(exact.isNotNull())
    rules = rule_violations(
        [
            ("outside_prefix", inside),
            ("invalid_size", F.col("size") >= 0),
            ("trailing_slash", ~(inside & ((relative == "") | relative.endswith("/")))),
            ("unsafe_segment", ~(inside & bad_segment(F.regexp_replace(relative, "/$", "")))),
        ]
    )
    per_row = usable.select("key_name", F.explode(rules).alias("rule")).groupBy("key_name", "rule").agg(
        F.count(F.lit(1)).alias("objects")
    )
    repeated = (
        usable.groupBy("key_name")
        .agg(F.count(F.lit(1)).alias("objects"))
        .filter(F.col("objects") > 1)
        .select("key_name", F.lit("duplicate").alias("rule"), "objects")
    )
    empty = (
        listing.filter(inside)
        .agg(F.count(F.lit(1)).alias("objects"))
        .filter(F.col("objects") == 0)
        .select(
            F.coalesce(exact, F.lit(prefix)).alias("key_name"),
            F.when(exact.isNull(), "bad_prefix").otherwise("empty").alias("rule"),
            "objects",
        )
    )
    return per_row.unionByName(repeated).unionByName(empty)


def listing_totals(listing: DataFrame, prefix: str) -> DataFrame:
    """Objects and bytes of the keys that ``audit_listing`` has no rule for."""
    exact = folder_of(prefix)
    broken = audit_listing(listing, prefix).select("key_name").distinct()
    return listing.filter(F.col("key_name").startswith(exact)).join(broken, "key_name", "left_anti").agg(
        F.count(F.lit(1)).alias("object_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("object_bytes")
    )


def sessions_in_listing(listing: DataFrame, prefix: str) -> DataFrame:
    """Objects and bytes per session below a parent prefix, with the outcome
    ``ok``; the session is the single segment that follows the prefix.  Keys
    whose segment is no name are counted in one row without session, as
    ``unnamed``.  An unusable prefix is the only row, as ``bad_prefix``."""
    exact = folder_of(prefix)
    segment = F.split_part(F.substr(F.col("key_name"), F.length(exact) + 1), F.lit("/"), F.lit(1))
    named = (
        listing.filter(F.col("key_name").startswith(exact))
        .withColumn("session_id", F.when(~segment.isin("", ".", ".."), segment))
        .groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"))
        .withColumn("outcome", F.when(F.col("session_id").isNull(), "unnamed").otherwise("ok"))
    )
    refused = listing.sparkSession.range(1).filter(exact.isNull()).select(
        F.lit(None).cast("string").alias("session_id"), F.lit(0).cast("bigint").alias("objects"),
        F.lit(0).cast("bigint").alias("bytes"), F.lit("bad_prefix").alias("outcome"),
    )
    return named.unionByName(refused)
