"""Ordered calculations inside a key that may hold a large share of all rows.

A plain ``Window.partitionBy(session).orderBy(seq)`` sends a whole session to
one task.  Here every key is cut into chunks of its order column, the window
runs inside ``(key, chunk)``, and one small row per chunk carries totals and
edge values across chunk borders:

    rows --window per (key, chunk)--> local result --join on (key, chunk)--> result
      \\-- aggregate per (key, chunk) --window over chunk rows per key--/

Only chunk rows are ever ordered per whole key.  Their number is bounded by
the key's span divided by the chunk width, not by its rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQ_CHUNK = 65_536
TIME_CHUNK_MS = 600_000

_CHUNK = "_chunk"


def seq_chunk(column: str | Column, width: int | None = None) -> Column:
    """Chunk number of a contiguous counter."""
    return F.floor(_col(column) / F.lit(width or SEQ_CHUNK)).cast("bigint")


def time_chunk(column: str | Column, width_ms: int | None = None) -> Column:
    """Chunk number of an epoch-millisecond column."""
    return F.floor(_col(column) / F.lit(width_ms or TIME_CHUNK_MS)).cast("bigint")


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    chunk: Column,
    *,
    rank: str | None = None,
    sums: Mapping[str, Column] | None = None,
    prev: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    upcoming: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add ordered columns to ``df``; ``by`` must order each key totally,
    ``chunk`` must not decrease along it, and keys must not be NULL.

    rank       0-based row number
    sums       running sum, current row included (NULL counts as 0)
    prev       value in the row before; NULL at the start
    following  value in the row after; NULL at the end
    last       latest non-NULL value up to and including the current row
    upcoming   earliest non-NULL value after the current row
    """
    sums, prev, following = dict(sums or {}), dict(prev or {}), dict(following or {})
    last, upcoming = dict(last or {}), dict(upcoming or {})
    base = df.withColumn(_CHUNK, chunk)
    # A single number as order keeps the chunk aggregate hash-based.
    order = F.col(by[0]) if len(by) == 1 else F.struct(*[F.col(name) for name in by])

    ascending = Window.partitionBy(*keys, _CHUNK).orderBy(*by)
    descending = Window.partitionBy(*keys, _CHUNK).orderBy(*[F.col(name).desc() for name in by])
    running = ascending.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before_in_reverse = descending.rowsBetween(Window.unboundedPreceding, -1)

    local: list[Column] = []
    totals: list[Column] = []
    if rank:
        local.append((F.row_number().over(ascending) - 1).cast("bigint").alias("_rank"))
        totals.append(F.count(F.lit(1)).alias("_n"))
    for name, value in sums.items():
        local.append(F.sum(F.coalesce(value, F.lit(0))).over(running).alias(f"_sum_{name}"))
        totals.append(F.sum(F.coalesce(value, F.lit(0))).alias(f"_tot_{name}"))
    if prev:
        local.append((F.row_number().over(ascending) == 1).alias("_first_row"))
    for name, value in prev.items():
        local.append(F.lag(value).over(ascending).alias(f"_prev_{name}"))
        totals.append(F.max_by(value, order).alias(f"_end_{name}"))
    if following:
        local.append(F.lead(F.lit(True)).over(ascending).isNull().alias("_last_row"))
    for name, value in following.items():
        local.append(F.lead(value).over(ascending).alias(f"_next_{name}"))
        totals.append(F.min_by(value, order).alias(f"_begin_{name}"))
    for name, value in last.items():
        local.append(F.last(value, ignorenulls=True).over(running).alias(f"_last_{name}"))
        totals.append(
            F.max_by(value, F.when(value.isNotNull(), order)).alias(f"_latest_{name}")
        )
    for name, value in upcoming.items():
        local.append(
            F.last(value, ignorenulls=True).over(before_in_reverse).alias(f"_up_{name}")
        )
        totals.append(
            F.min_by(value, F.when(value.isNotNull(), order)).alias(f"_first_{name}")
        )

    along = Window.partitionBy(*keys).orderBy(_CHUNK)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    against = Window.partitionBy(*keys).orderBy(F.col(_CHUNK).desc())
    after = against.rowsBetween(Window.unboundedPreceding, -1)

    carried: list[Column] = []
    if rank:
        carried.append(F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    for name in sums:
        carried.append(
            F.coalesce(F.sum(f"_tot_{name}").over(before), F.lit(0)).alias(f"_base_{name}")
        )
    for name in prev:
        carried.append(F.lag(f"_end_{name}").over(along).alias(f"_carry_{name}"))
    for name in following:
        carried.append(F.lead(f"_begin_{name}").over(along).alias(f"_carry_{name}"))
    for name in last:
        carried.append(
            F.last(f"_latest_{name}", ignorenulls=True).over(before).alias(f"_carry_{name}")
        )
    for name in upcoming:
        carried.append(
            F.last(f"_first_{name}", ignorenulls=True).over(after).alias(f"_carry_{name}")
        )

    edges = base.groupBy(*keys, _CHUNK).agg(*totals).select(*keys, _CHUNK, *carried)
    joined = base.select("*", *local).join(edges, [*keys, _CHUNK])

    out = [F.col(name) for name in df.columns]
    if rank:
        out.append((F.col("_rank") + F.col("_base")).alias(rank))
    for name in sums:
        out.append((F.col(f"_sum_{name}") + F.col(f"_base_{name}")).alias(name))
    for name in prev:
        out.append(
            F.when(F.col("_first_row"), F.col(f"_carry_{name}")).otherwise(F.col(f"_prev_{name}")).alias(name)
        )
    for name in following:
        out.append(
            F.when(F.col("_last_row"), F.col(f"_carry_{name}")).otherwise(F.col(f"_next_{name}")).alias(name)
        )
    for name in last:
        out.append(F.coalesce(f"_last_{name}", f"_carry_{name}").alias(name))
    for name in upcoming:
        out.append(F.coalesce(f"_up_{name}", f"_carry_{name}").alias(name))
    return joined.select(*out)


def attach_facts(
    rows: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    spread: Column,
    how: str = "left",
    salts: int = 16,
) -> DataFrame:
    """Join one-row-per-key ``facts`` to ``rows`` whose keys may be very uneven.

    Rows of one key are spread over ``salts`` join keys and each fact row is
    repeated as often, so no task gets a whole hot key.  Spark still replaces
    this by a broadcast when the measured size of ``facts`` allows it.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def first_per_group(
    df: DataFrame, keys: Sequence[str], by: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """The smallest row of each key by ``by``; combines before the shuffle."""
    order = F.struct(*[F.col(name) for name in by])
    row = F.struct(*[F.col(name) for name in columns])
    return (
        df.groupBy(*keys)
        .agg(F.min_by(row, order).alias("_row"))
        .select(*keys, *[F.col(f"_row.{name}").alias(name) for name in columns])
    )


def smallest_per_group(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    count: int,
    rank: str = "rank",
    salts: int = 32,
) -> DataFrame:
    """The ``count`` smallest rows of each key with their 0-based rank.

    A first cut inside ``(key, salt)`` leaves at most ``salts * count`` rows
    per key for the final ordering.
    """
    order = [F.col(name) for name in by]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rn", F.row_number().over(inner))
        .filter(F.col("_rn") <= count)
        .withColumn(rank, (F.row_number().over(outer) - 1).cast("bigint"))
        .filter(F.col(rank) < count)
        .drop("_salt", "_rn")
    )


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column
