"""Trees, diffs, history, restore."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlog.functions.values import CHANGE_KINDS, change_kind, valid_object_id
from driftlog.operators.ordered import (
    attach_facts,
    ordered_scan,
    seq_chunk,
    smallest_per_group,
)

MAX_CHANGES = 5_000


def _entry() -> Column:
    return F.struct("entry_type", "blob", "executable")


def with_entry_defaults(tree: DataFrame) -> DataFrame:
    """Sources without inode data hold plain, non-executable files."""
    if "entry_type" not in tree.columns:
        tree = tree.withColumn("entry_type", F.lit("file"))
    if "executable" not in tree.columns:
        tree = tree.withColumn("executable", F.lit(False))
    return tree


def content_ids(inventory: DataFrame, prior: DataFrame | None = None, full_scan: bool = False) -> DataFrame:
    """Blob id per inventory row (session_id, path, bytes, mtime_ms, content).

    An incremental scan trusts unchanged (path, bytes, mtime_ms) and hashes
    only the rest; a full scan hashes everything.  Listings are compared without
    contents, and contents are only read for the paths that changed; while
    these are few, adaptive execution broadcasts them and moves no content.
    """
    digest = F.sha2("content", 256)
    if full_scan or prior is None:
        return inventory.withColumn("blob", digest).withColumn("reused", F.lit(False)).drop("content")
    known = prior.select("session_id", "path", "bytes", "mtime_ms", F.col("blob").alias("known_blob"))
    listing = inventory.drop("content").join(known, ["session_id", "path", "bytes", "mtime_ms"], "left")
    columns = [c for c in inventory.columns if c != "content"]
    reused = listing.filter(F.col("known_blob").isNotNull()).select(
        *columns, F.col("known_blob").alias("blob"), F.lit(True).alias("reused")
    )
    changed = listing.filter(F.col("known_blob").isNull()).select("session_id", "path")
    hashed = inventory.join(changed, ["session_id", "path"], "left_semi").select(
        *columns, digest.alias("blob"), F.lit(False).alias("reused")
    )
    return reused.unionByName(hashed)


LANES = 4


def _lanes(path: Column, entry: Column) -> list[Column]:
    """The parts of an entry's digest that are summed up."""
    digest = F.sha2(
        F.concat_ws("\u0000", path, entry["entry_type"], F.coalesce(entry["blob"], F.lit("")),
                    entry["executable"].cast("string")),
        256,
    )
    return [F.conv(F.substring(digest, 1 + 15 * lane, 15), 16, 10).cast("decimal(20,0)") for lane in range(LANES)]


def _tree_id() -> Column:
    sums = [F.col(f"_lane{lane}").cast("string") for lane in range(LANES)]
    return F.concat(F.lit("t:"), F.sha2(F.concat_ws(":", F.col("entries").cast("string"), *sums), 256))


def tree_ids(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Content-derived id of each entry set.

    The id hashes the entry count and four sums over entry digests, so it
    needs no order and is combined before the shuffle.
    """
    lanes = [F.sum(lane).alias(f"_lane{i}") for i, lane in enumerate(_lanes(F.col("path"), _entry()))]
    return (
        with_entry_defaults(entries)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("entries"), F.sum("bytes").alias("bytes"), *lanes)
        .select(*keys, _tree_id().alias("tree"), "entries", "bytes")
    )


def running_tree_ids(changes: DataFrame, generations: DataFrame, order: str) -> DataFrame:
    """``tree_ids`` of every generation, from the changes between them alone.

    ``changes`` holds session_id, the generation in ``order``, path, the entry
    structs before and after (NULL where absent) and after_bytes, before_bytes;
    ``generations`` all pairs of session_id and ``order``.  Ids are hashes of
    sums, so a generation's sums are those before it plus the digests of new
    entries less those of old ones: unchanged entries are never read.
    """
    zero = F.lit(0).cast("decimal(20,0)")
    before, after = F.col("before"), F.col("after")

    def change(new: Column, old: Column) -> Column:
        return F.when(after.isNotNull(), new).otherwise(zero) - F.when(before.isNotNull(), old).otherwise(zero)

    lanes = [
        F.sum(change(new, old)).cast("decimal(38,0)").alias(f"_lane{i}")
        for i, (new, old) in enumerate(zip(_lanes(F.col("path"), after), _lanes(F.col("path"), before), strict=True))
    ]
    step = changes.groupBy("session_id", order).agg(
        F.sum(after.isNotNull().cast("bigint") - before.isNotNull().cast("bigint")).alias("entries"),
        F.sum(F.coalesce("after_bytes", F.lit(0)) - F.coalesce("before_bytes", F.lit(0))).alias("bytes"),
        *lanes,
    )
    names = ["entries", "bytes", *[f"_lane{i}" for i in range(LANES)]]
    return ordered_scan(
        generations.select("session_id", order).join(step, ["session_id", order], "left"),
        ["session_id"],
        [order],
        seq_chunk(order),
        sums={f"_sum{name}": F.col(name) for name in names},
    ).select("session_id", order, *[F.col(f"_sum{name}").alias(name) for name in names]).select(
        "session_id", order, _tree_id().alias("tree"), "entries", "bytes"
    )


def store_blobs(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Each new blob once; ids already stored are left out unread."""
    fresh = rows if stored is None else rows.join(stored.select("blob"), "blob", "left_anti")
    return fresh.dropDuplicates(["blob"])


def classify(before: DataFrame, after: DataFrame) -> DataFrame:
    """All differing paths of two trees per session, with their change kind.

    A removal and an addition stay two rows: renames are not inferred.
    """
    old = with_entry_defaults(before).select(
        "session_id", "path", _entry().alias("before")
    )
    new = with_entry_defaults(after).select(
        "session_id", "path", _entry().alias("after"), F.col("bytes").cast("bigint").alias("after_bytes")
    )
    return (
        old.join(new, ["session_id", "path"], "full_outer")
        .withColumn("kind", change_kind(F.col("before"), F.col("after")))
        .filter(F.col("kind").isNotNull())
    )


def _blob_id(entry: str) -> Column:
    value = F.col(entry)
    return F.when(
        value["entry_type"].isin("file", "symlink"), F.concat(F.lit("b:"), value["blob"])
    )


def diff_rows(differing: DataFrame) -> DataFrame:
    """Uncapped change rows of ``classify``."""
    return differing.select(
        "session_id",
        "path",
        "kind",
        _blob_id("after").alias("blob"),
        _blob_id("before").alias("prev_blob"),
        F.lit(None).cast("string").alias("from"),
        F.when(F.col("after").isNotNull(), F.col("after_bytes")).alias("bytes"),
    )


def diff_stats(rows: DataFrame, max_changes: int) -> DataFrame:
    """Counts per kind over the complete diff and the truncation flag."""
    return rows.groupBy("session_id").agg(
        *[F.count_if(F.col("kind") == kind).alias(kind) for kind in CHANGE_KINDS],
        (F.count(F.lit(1)) > max_changes).alias("truncated"),
    )


def capped_changes(rows: DataFrame, max_changes: int) -> DataFrame:
    """The first ``max_changes`` change rows of each session by path."""
    return smallest_per_group(rows, ["session_id"], ["path"], max_changes)


def project_diff(
    before: DataFrame, after: DataFrame, max_changes: int = MAX_CHANGES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Complete change rows, capped change rows, stats."""
    rows = diff_rows(classify(before, after))
    return rows, capped_changes(rows, max_changes), diff_stats(rows, max_changes)


def operations(snapshots: DataFrame) -> DataFrame:
    """Operation chain: each snapshot's parent is the operation before it;
    the baseline has none."""
    op = F.concat(
        F.lit("op:"),
        F.sha2(F.concat_ws(":", "session_id", F.col("seq").cast("string"), "tree"), 256),
    )
    commit = F.concat(
        F.lit("c:"),
        F.substring(F.sha2(F.concat_ws(":", F.lit("commit"), "session_id",
                                       F.col("seq").cast("string"), "tree"), 256), 1, 40),
    )
    named = snapshots.withColumn("op", op).withColumn("commit", commit)
    return ordered_scan(
        named, ["session_id"], ["seq"], seq_chunk("seq"), prev={"parent_op": F.col("op")}
    ).select("session_id", "seq", "op", "parent_op", "commit", "tree")


def history(changes: DataFrame) -> DataFrame:
    """Validity interval of every path version from uncapped change rows
    (session_id, seq, path, kind, entry columns).  An open end is NULL."""
    return (
        ordered_scan(
            changes,
            ["session_id", "path"],
            ["seq"],
            seq_chunk("seq"),
            following={"valid_to": F.col("seq")},
        )
        .filter(F.col("kind") != "removed")
        .withColumnRenamed("seq", "valid_from")
        .drop("kind")
    )


def changes_between_generations(trees: DataFrame) -> DataFrame:
    """Change rows of consecutive full trees (session_id, gen, path, blob,
    executable, bytes) numbered without gaps from 0."""
    typed = with_entry_defaults(trees)
    last = typed.groupBy("session_id").agg(F.max("gen").alias("last_gen"))
    old = attach_facts(typed, last, ["session_id"], F.col("path")).filter(
        F.col("gen") < F.col("last_gen")
    ).select("session_id", (F.col("gen") + 1).alias("gen"), "path", _entry().alias("before"))
    new = typed.select("session_id", "gen", "path", _entry().alias("after"), "bytes")
    return (
        old.join(new, ["session_id", "gen", "path"], "full_outer")
        .withColumn("kind", change_kind(F.col("before"), F.col("after")))
        .filter(F.col("kind").isNotNull())
        .select(
            "session_id",
            F.col("gen").cast("bigint").alias("seq"),
            "path",
            "kind",
            F.col("after.entry_type").alias("entry_type"),
            F.col("after.blob").alias("blob"),
            F.col("after.executable").alias("executable"),
            "bytes",
        )
    )


def _shifted(number: Column, level: Column) -> Column:
    return F.call_function("shiftright", number, level)


def dyadic_nodes(start: Column, stop: Column, levels: int) -> Column:
    """The nodes (level, place) that make up [start, stop): aligned intervals
    of 2^level numbers from place * 2^level, at most two of each level.  Bounds
    are clipped to 0 and 2^levels."""
    low = F.greatest(start, F.lit(0)).cast("bigint")
    high = F.least(stop, F.lit(1 << levels)).cast("bigint")

    def of_level(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        first, last = _shifted(low + size - 1, level), _shifted(high, level)
        some = first < last
        left = F.when(some & (first % 2 == 1), F.struct(level.alias("level"), first.alias("place")))
        right = F.when(some & (last % 2 == 1), F.struct(level.alias("level"), (last - 1).alias("place")))
        return F.array(left, right)

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of_level)))


def dyadic_parents(point: Column, levels: int) -> Column:
    """The node of every level that holds a point."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(levels)),
        lambda level: F.struct(level.alias("level"), _shifted(point.cast("bigint"), level).alias("place")),
    )


def _levels(points: DataFrame, *columns: str) -> int | None:
    """Levels that cover the asked points; None if nothing is asked."""
    top = points.agg(F.max(F.greatest(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0]))).first()[0]
    return None if top is None else max(int(top) + 1, 1).bit_length()


def tree_at(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """Entries valid at each requested (session_id, at_seq).

    A version's interval is cut into dyadic nodes and a request names the nodes
    that hold its point; they meet in exactly one node or none.  So both sides
    are joined by equality, and no version is compared with a request it does
    not serve.  Spark broadcasts the requests where their measured size allows
    it, else it can split a session that holds most rows.
    """
    asked = requests.select("session_id", "at_seq").filter("at_seq >= 0").distinct()
    levels = _levels(asked, "at_seq")
    if levels is None:
        return versions.withColumn("at_seq", F.lit(None).cast("bigint")).limit(0)
    stop = F.coalesce("valid_to", F.lit(1 << levels))
    cut = versions.withColumn("_node", F.explode(dyadic_nodes(F.col("valid_from"), stop, levels)))
    held = asked.withColumn("_node", F.explode(dyadic_parents(F.col("at_seq"), levels)))
    return cut.join(held, ["session_id", "_node"]).select(*versions.columns, "at_seq")


def _resolved(requests: DataFrame, known: DataFrame, durable: DataFrame | None, *ops: tuple[str, str]) -> DataFrame:
    """Requests with the sequence number of each operation and the outcome:
    ``unknown_op``, ``not_durable`` behind no watermark, or ``ok``."""
    out = requests
    for op, seq in ops:
        out = out.join(known.select("session_id", F.col("op").alias(op), F.col("seq").alias(seq)), ["session_id", op], "left")
    numbers = [F.col(seq) for _, seq in ops]
    missing = functools.reduce(operator.or_, [n.isNull() for n in numbers])
    outcome = F.when(missing, "unknown_op")
    if durable is not None:
        out = out.join(durable.select("session_id", "durable_seq"), "session_id", "left")
        late = functools.reduce(operator.or_, [n > F.coalesce("durable_seq", F.lit(-1)) for n in numbers])
        outcome = outcome.when(late, "not_durable")
    return out.withColumn("outcome", outcome.otherwise("ok")).drop("durable_seq")


def materialize(
    versions: DataFrame, requests: DataFrame, known: DataFrame, blobs: DataFrame, durable: DataFrame | None = None
) -> DataFrame:
    """Files of each requested (session_id, op) with their content.

    ``known`` maps operations to sequence numbers (session_id, op, seq).  A
    request for another operation is one row with the outcome ``unknown_op``
    and no path; with ``durable`` (session_id, durable_seq), one for an
    operation behind the watermark is one row ``not_durable``.  Files have the
    outcome ``ok``, or ``missing_content`` when no blob holds theirs.  Joins are
    plain, so that adaptive execution splits a content shared by very many paths.
    """
    at = _resolved(requests.select("session_id", "op"), known, durable, ("op", "at_seq"))
    served = at.filter("outcome = 'ok'").select("session_id", "op", "at_seq")
    entries = tree_at(versions, served).join(served, ["session_id", "at_seq"])
    files = with_entry_defaults(entries).join(blobs.select("blob", "content"), "blob", "left").select(
        "session_id",
        "op",
        F.when(F.col("content").isNull(), "missing_content").otherwise("ok").alias("outcome"),
        "path",
        "entry_type",
        "executable",
        "bytes",
        "content",
    )
    refused = at.filter("outcome <> 'ok'").select("session_id", "op", "outcome")
    return files.unionByName(refused, allowMissingColumns=True)


def diff_operations(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """Differences between two points per request (session_id, before_seq,
    after_seq), as bare ids.

    A path can only differ where a version begins or ends between the points,
    so requests are cut into dyadic nodes and met by the nodes that hold a
    version's ends.  A version with both ends inside is alive at neither point;
    every other one meets a request once.
    """
    asked = requests.select("session_id", "before_seq", "after_seq").filter("before_seq >= 0 and after_seq >= 0").distinct()
    low, high = F.least("before_seq", "after_seq"), F.greatest("before_seq", "after_seq")
    levels = _levels(asked, "before_seq", "after_seq") or 1
    spans = asked.withColumn("_node", F.explode(dyadic_nodes(low + 1, high + 1, levels)))
    entry = _entry().alias("_entry")
    ends = versions.select(
        "session_id", "path", "valid_from", "valid_to", entry,
        F.explode(F.array_compact(F.array(
            F.struct(F.col("valid_from").alias("at"), F.lit(True).alias("begins")),
            F.when(F.col("valid_to").isNotNull(), F.struct(F.col("valid_to").alias("at"), F.lit(False).alias("begins"))),
        ))).alias("_end"),
    ).filter(F.col("_end.at") < (1 << levels))
    held = ends.withColumn("_node", F.explode(dyadic_parents(F.col("_end.at"), levels)))
    other_end = F.when(F.col("_end.begins"), F.coalesce(F.col("valid_to") > high, F.lit(True))).otherwise(
        F.col("valid_from") <= low
    )

    def alive(point: str) -> Column:
        at = F.col(point)
        return (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))

    return (
        held.join(spans, ["session_id", "_node"])
        .filter(other_end)
        .groupBy("session_id", "before_seq", "after_seq", "path")
        .agg(
            F.max(F.when(alive("before_seq"), F.col("_entry"))).alias("old"),
            F.max(F.when(alive("after_seq"), F.col("_entry"))).alias("new"),
        )
        .filter(~F.col("old").eqNullSafe(F.col("new")))
        .select(
            "session_id",
            "before_seq",
            "after_seq",
            "path",
            F.col("old.blob").alias("before"),
            F.col("new.blob").alias("after"),
            (F.col("old.executable") != F.col("new.executable")).alias("executable_changed"),
        )
    )


def diff(
    versions: DataFrame, requests: DataFrame, known: DataFrame, durable: DataFrame | None = None
) -> DataFrame:
    """``diff_operations`` for requests by operation (session_id, before_op,
    after_op), with the outcome ``ok``.  A request with an operation that is
    not in ``known`` (session_id, op, seq) is one row with the outcome
    ``unknown_op``, the sequence numbers that are known, and no path; with
    ``durable`` (session_id, durable_seq), one with an operation behind the
    watermark is one row ``not_durable``."""
    asked = requests.select("session_id", "before_op", "after_op")
    resolved = _resolved(asked, known, durable, ("before_op", "before_seq"), ("after_op", "after_seq"))
    changed = diff_operations(versions, resolved.filter("outcome = 'ok'")).withColumn("outcome", F.lit("ok"))
    refused = resolved.filter("outcome <> 'ok'").select("session_id", "before_seq", "after_seq", "outcome")
    return changed.unionByName(refused, allowMissingColumns=True)


def compare_trees(expected: DataFrame, actual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Missing, extra, changed and refused paths of a restored tree, and
    totals per session that also hold the equal ones."""
    want = with_entry_defaults(expected).select(
        "session_id", "path", F.col("blob").alias("want"), (F.col("entry_type") == "symlink").alias("want_link")
    )
    got = with_entry_defaults(actual).select(
        "session_id", "path", F.col("blob").alias("got"), (F.col("entry_type") == "symlink").alias("got_link")
    )
    rows = want.join(got, ["session_id", "path"], "full_outer").withColumn(
        "outcome",
        F.when(F.coalesce("want_link", F.lit(False)) | F.coalesce("got_link", F.lit(False)), "symlink")
        .when(F.col("got_link").isNull(), "missing")
        .when(F.col("want_link").isNull(), "extra")
        .when(F.col("want").eqNullSafe(F.col("got")), "equal")
        .otherwise("changed"),
    )
    totals = rows.groupBy("session_id").agg(
        F.count("want_link").alias("expected_files"),
        F.count("got_link").alias("actual_files"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("equal", "missing", "extra", "changed", "symlink")],
    ).withColumn("ok", F.col("equal") == F.greatest("expected_files", "actual_files"))
    return rows.filter(F.col("outcome") != "equal").select("session_id", "path", "outcome", "want", "got"), totals


def growth(entries: DataFrame) -> DataFrame:
    """Entries per tree and the bytes each snapshot adds to the blob store of
    its session (session_id, gen, path, blob, bytes)."""
    per_tree = entries.groupBy("session_id", "gen").agg(F.count(F.lit(1)).alias("entries"))
    first = entries.groupBy("session_id", "blob").agg(
        F.min("gen").alias("gen"), F.max("bytes").alias("bytes")
    )
    added = first.groupBy("session_id", "gen").agg(
        F.count(F.lit(1)).alias("new_blobs"), F.sum("bytes").alias("new_bytes")
    )
    return per_tree.join(added, ["session_id", "gen"], "left").select(
        "session_id",
        "gen",
        "entries",
        F.coalesce("new_blobs", F.lit(0)).alias("new_blobs"),
        F.coalesce("new_bytes", F.lit(0)).alias("new_bytes"),
    )


def audit_ids(timeline: DataFrame) -> DataFrame:
    """Identifiers of all events that are not even-length hex after their
    optional prefix."""
    columns = [
        ("baseline_op", "session_start.baseline_op"),
        ("baseline_tree", "session_start.baseline_tree"),
        ("op", "snapshot.op"),
        ("parent_op", "snapshot.parent_op"),
        ("commit", "snapshot.commit"),
        ("tree", "snapshot.tree"),
        ("ref_op", "mark.ref_op"),
        ("flush_op", "flush.op"),
        ("final_op", "session_end.final_op"),
    ]
    single = F.array(
        *[F.struct(F.lit(name).alias("column"), F.col(path).alias("value")) for name, path in columns]
    )

    def from_changes(field: str) -> Column:
        return F.transform(
            F.coalesce("snapshot.changes", F.array().cast(
                "array<struct<path:string,kind:string,blob:string,prev_blob:string,`from`:string,bytes:bigint>>")),
            lambda c: F.struct(F.lit(field).alias("column"), c[field].alias("value")),
        )

    ids = F.concat(single, from_changes("blob"), from_changes("prev_blob"))
    bad = F.filter(ids, lambda i: i["value"].isNotNull() & ~valid_object_id(i["value"]))
    return timeline.select("session_id", "seq", F.inline(bad))
