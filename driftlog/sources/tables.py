"""Engine tables: sessions in buckets, sorted, read with pruning.

The interchange format keeps a folder per session; a table that jobs read keeps
its rows in a fixed number of buckets instead.  A bucket is a folder, named
with their number, and files in it are sorted by (session_id, order), so a
lookup reads a few folders, and in them only the row groups whose ranges can
hold what it asks for.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.operators.ordered import seq_chunk
from driftlog.sources.sinks import folder_names

BUCKETS = 64
RUN_ROWS = 65_536
ROW_GROUP_BYTES = 16 << 20
# Sessions that are named in a pushed-down filter; more are joined.
NAMED_SESSIONS = 1_000
_PREFIX = "bucket_of_"


def _bucket(session: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(buckets)).cast("int")


def write_table(
    rows: DataFrame, path: str, order: str = "seq", buckets: int = BUCKETS, row_group_bytes: int = ROW_GROUP_BYTES
) -> None:
    """Write rows with session_id and a BIGINT ``order`` as an engine table.

    Rows are dealt by bucket and by run of ``RUN_ROWS`` of the order, so a
    session with very many rows is sorted and written by many tasks, to several
    files of its bucket; adaptive execution splits other large buckets and
    packs small ones.
    """
    name = f"{_PREFIX}{buckets}"
    dealt = rows.withColumn(name, _bucket(F.col("session_id"), buckets)).withColumn("_run", seq_chunk(order, RUN_ROWS))
    (
        dealt.hint("rebalance", F.col(name), F.col("_run"))
        .sortWithinPartitions(name, "session_id", order)
        .drop("_run")
        .write.partitionBy(name)
        .option("parquet.block.size", row_group_bytes)
        .parquet(path)
    )


def _bucket_column(spark: SparkSession, path: str) -> tuple[str, int]:
    for name in folder_names(spark, path):
        found = re.match(rf"({_PREFIX}(\d+))=", name)
        if found:
            return found.group(1), int(found.group(2))
    return f"{_PREFIX}1", 1


def read_table(
    spark: SparkSession,
    path: str,
    sessions: list[str] | None = None,
    first: int | None = None,
    last: int | None = None,
    order: str = "seq",
    schema: str | None = None,
) -> DataFrame:
    """Rows of an engine table, of some sessions and from ``first`` to
    ``last``.  Buckets are pruned as folders; sessions and the range are
    pushed down to the row groups.  An empty table needs ``schema``."""
    name, buckets = _bucket_column(spark, path)
    rows = (spark.read if schema is None else spark.read.schema(f"{schema}, {name} int")).parquet(path)
    if sessions is not None:
        # Constant expressions, so that Spark selects folders while planning.
        rows = rows.filter(F.col(name).isin([_bucket(F.lit(s), buckets) for s in sorted(set(sessions))]))
        rows = rows.filter(F.col("session_id").isin(sorted(set(sessions))))
    if first is not None:
        rows = rows.filter(F.col(order) >= first)
    if last is not None:
        rows = rows.filter(F.col(order) <= last)
    return rows.drop(name)


def rows_for(spark: SparkSession, path: str, requests: DataFrame, schema: str | None = None) -> DataFrame:
    """Rows of the sessions that ``requests`` names.

    Up to ``NAMED_SESSIONS`` sessions are named in the scan; with more, the
    buckets they fall into are, at most one number per bucket, and the sessions
    are joined.
    """
    asked = requests.select("session_id").filter("session_id is not null").distinct()
    few = [r.session_id for r in asked.limit(NAMED_SESSIONS + 1).collect()]
    if len(few) <= NAMED_SESSIONS:
        return read_table(spark, path, few, schema=schema)
    name, buckets = _bucket_column(spark, path)
    places = [r[0] for r in asked.select(_bucket(F.col("session_id"), buckets)).distinct().collect()]
    rows = (spark.read if schema is None else spark.read.schema(f"{schema}, {name} int")).parquet(path)
    return rows.filter(F.col(name).isin(places)).drop(name).join(asked, "session_id", "left_semi")
