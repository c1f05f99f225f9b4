"""Samples of labelled ids with a fixed bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FINE = 1 << 40


def bounded_sample(ids: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``ids``, those of the least doc_id hashes.

    All rows if there are no more; the same rows on every run.  A hash border
    leaves little more than ``rows`` rows before they are ordered, so no task
    sorts the whole table, and the result is small enough to broadcast.
    """
    total = ids.count()
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(_FINE))
    if total > rows:
        slack = 6 * rows**0.5 + 100
        ids = ids.filter(rank < int(_FINE * min(1.0, (rows + slack) / total)))
    return ids.orderBy(rank, "doc_id").limit(rows)
