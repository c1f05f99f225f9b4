"""Sums of fixed-length count vectors over all rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FAN_IN = 8
#: Numbers that one row brings to the driver at most.
SLICE = 1 << 15


def sum_vectors(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """Add up ``count``'s vector of ``size`` float64 numbers of every partition.

    Vectors are added in a tree on the executors, one Python worker a task, and
    the last few of them slice by slice; the driver only gets the slices of one
    vector, whose size does not depend on the data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.asarray(count(batches), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for row in batch.column(0):
                total += np.frombuffer(row.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0):
                total = np.frombuffer(row.as_buffer(), np.float64)
                for at in range(0, size, SLICE):
                    own = total[at : at + SLICE].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([own], pa.binary())], ["at", "v"])

    def add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                totals[at] = totals.get(at, 0.0) + np.frombuffer(row.as_buffer(), np.float64)
        for at, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["at", "v"]
            )

    parts = df.mapInArrow(run, "v binary")
    number = df.rdd.getNumPartitions()
    while number > FAN_IN:
        number = math.ceil(number / FAN_IN)
        parts = parts.repartition(number).mapInArrow(add, "v binary")
    slices = parts.mapInArrow(cut, "at bigint, v binary")
    if number > 1:
        slices = slices.repartition(min(FAN_IN, math.ceil(size / SLICE)), "at").mapInArrow(add_slices, "at bigint, v binary")
    out = np.zeros(size)
    for row in slices.collect():
        out[row.at : row.at + SLICE] += np.frombuffer(row.v, np.float64)
    return out
