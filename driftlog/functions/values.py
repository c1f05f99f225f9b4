"""Column functions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Touch operations in their defined order.
TOUCH_OPERATIONS = ("create", "modify", "remove", "rename", "other")
# Change kinds in their defined order.
CHANGE_KINDS = ("added", "removed", "modified", "renamed", "mode_changed")


def touch_operation(kind: Column, rename_mode: Column) -> Column:
    """Operation of a raw notification; NULL for accesses."""
    return (
        F.when(kind == "access", F.lit(None).cast("string"))
        .when(kind.isin("create", "remove"), kind)
        .when((kind == "modify") & rename_mode.isNotNull(), "rename")
        .when(kind == "modify", "modify")
        .otherwise("other")
    )


def operation_bit(operation: Column) -> Column:
    """One bit per operation, so a set is a bitwise OR."""
    bit = F.lit(None).cast("int")
    for position, name in enumerate(TOUCH_OPERATIONS):
        bit = F.when(operation == name, F.lit(1 << position)).otherwise(bit)
    return bit


def operations_of(bits: Column) -> Column:
    """The sorted operation array of a bit set, in the defined order."""
    present = [
        F.when(bits.bitwiseAND(F.lit(1 << position)) != 0, F.lit(name))
        for position, name in enumerate(TOUCH_OPERATIONS)
    ]
    return F.array_compact(F.array(*present))


def operation_rank(operation: Column) -> Column:
    """Position of an operation in the defined order."""
    return F.array_position(F.array(*[F.lit(name) for name in TOUCH_OPERATIONS]), operation)


def change_kind(before: Column, after: Column) -> Column:
    """Kind of a difference between two entries, structs of entry_type, blob,
    executable; NULL when they are equal or both absent."""
    same_content = (
        (before["entry_type"] == after["entry_type"])
        & before["blob"].eqNullSafe(after["blob"])
    )
    both_files = (before["entry_type"] == "file") & (after["entry_type"] == "file")
    return (
        F.when(before.isNull() & after.isNull(), F.lit(None).cast("string"))
        .when(before.isNull(), "added")
        .when(after.isNull(), "removed")
        .when(same_content & ~both_files, F.lit(None).cast("string"))
        .when(same_content & (before["executable"].eqNullSafe(after["executable"])), F.lit(None).cast("string"))
        .when(same_content & both_files, "mode_changed")
        .otherwise("modified")
    )


def response_class(status: Column) -> Column:
    """success, conflict, retry or permanent for an HTTP status; a NULL status
    is a request that got no answer and is tried again."""
    return (
        F.when(status.between(200, 299), "success")
        .when(status == 409, "conflict")
        .when(status.isNull() | (status == 429) | status.between(500, 599), "retry")
        .otherwise("permanent")
    )


def checkpoint_hex(commit: Column) -> Column:
    """Lower-case 40- or 64-digit hex of a commit id, else NULL."""
    bare = F.regexp_replace(commit, "^c:", "")
    return F.when(bare.rlike("^(?:[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})$"), F.lower(bare))


def valid_object_id(value: Column) -> Column:
    """Even-length hex after an optional ``kind:`` prefix."""
    bare = F.when(value.contains(":"), F.regexp_replace(value, "^[^:]*:", "")).otherwise(value)
    return bare.rlike("^(?:[0-9A-Fa-f]{2})*$")


def event_object_name(seq: Column) -> Column:
    """Immutable object that holds a timeline through ``seq``."""
    return F.concat(F.lit("events/"), F.lpad(seq.cast("string"), 20, "0"), F.lit(".ndjson"))


def safe_object_path(path: Column) -> Column:
    """Relative and free of ``..`` segments."""
    return ~path.startswith("/") & ~F.arrays_overlap(F.split(path, "/"), F.array(F.lit("..")))


def clock_ns(text: Column) -> Column:
    """Unix nanoseconds of an RFC 3339 time, exact to nine digits; NULL when
    the text is not a time or has no offset."""
    pattern = (
        r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(?:[.,](\d+))?"
        r"(?:([Zz])|([+-]\d{2}:?\d{2}))$"
    )
    fraction = F.regexp_extract(text, pattern, 3)
    offset = F.regexp_extract(text, pattern, 5)
    zone = F.when(offset == "", F.lit("Z")).otherwise(
        F.concat(F.substring(offset, 1, 3), F.lit(":"), F.right(offset, F.lit(2)))
    )
    moment = F.try_to_timestamp(
        F.concat(F.regexp_extract(text, pattern, 1), F.lit("T"), F.regexp_extract(text, pattern, 2), zone),
        F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"),
    )
    nanos = F.rpad(F.substring(fraction, 1, 9), 9, "0").cast("bigint")
    return F.when(text.rlike(pattern), F.unix_seconds(moment) * F.lit(1_000_000_000) + nanos)


def redact(message: Column, secrets: Column) -> Column:
    """Replace every non-empty secret of the array by ``***``."""
    return F.aggregate(
        F.filter(F.coalesce(secrets, F.array().cast("array<string>")), lambda s: s != ""),
        message,
        lambda text, secret: F.replace(text, secret, F.lit("***")),
    )


def rule_violations(checks: Sequence[tuple[str, Column]]) -> Column:
    """Names of the rules whose condition is not true, in the given order."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks])
    )
