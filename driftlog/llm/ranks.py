"""Places of rows inside ordered groups of any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlog.session import save_and_reload


def _changes(batch: pa.RecordBatch, keys: Sequence[int]) -> np.ndarray:
    """Whether each row but the first has another key than the row before."""
    out = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in keys:
        here, before = batch.column(k).slice(1), batch.column(k).slice(0, len(out))
        same = pc.or_(pc.fill_null(pc.equal(here, before), False), pc.and_(pc.is_null(here), pc.is_null(before)))
        out |= ~np.asarray(same)
    return out


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """Add each row's place, from 0, among the rows with its ``keys``.

    Rows stand in the order of ``order``, NULL first; equal rows in any order.
    The table is range-partitioned by keys, order and row, so a group with very
    many rows is spread over tasks.  A border between two tasks cuts one group
    at most; the rows before it are counted and added, a table with no more
    rows than two for each task.  Without keys the table is one group.
    """
    names = df.columns
    placed = df.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order, "_tie")]
    at = [placed.columns.index(c) for c in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            first = tuple(batch.column(k)[0].as_py() for k in at)
            change = np.concatenate(([first != last], _changes(batch, at)))
            row = np.arange(batch.num_rows)
            begin = np.maximum.accumulate(np.where(change, row, -1))
            local = np.where(begin >= 0, row - begin, row + count)
            last, count = tuple(batch.column(k)[-1].as_py() for k in at), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(local), pa.array(np.full(batch.num_rows, part, np.int64))],
                [*names, "_local", "_part"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    ordered = placed.repartitionByRange(*by).sortWithinPartitions(*by)
    local = save_and_reload(ordered.mapInArrow(run, f"{schema}, _local bigint, _part bigint"), "numbered")
    along = Window.partitionBy(*keys).orderBy("_part")
    before = (
        local.groupBy(*keys, "_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_part", F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
        .filter("_before is not null")
    )
    before = before.select(*[F.col(c).alias(f"_key_{i}") for i, c in enumerate(keys)], F.col("_part").alias("_their"), "_before")
    match = F.col("_part") == F.col("_their")
    for i, c in enumerate(keys):
        match &= F.col(c).eqNullSafe(F.col(f"_key_{i}"))
    return local.join(F.broadcast(before), match, "left").select(
        *names, (F.col("_local") + F.coalesce("_before", F.lit(0))).alias(name)
    )
