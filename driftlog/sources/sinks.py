"""Sinks: timeline export, durable publication, cursors, restore."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.functions.values import event_object_name
from driftlog.operators.ordered import attach_facts, ordered_scan, seq_chunk
from driftlog.schemas import BODIES
from driftlog.session import save_and_reload
from driftlog.sources import export
from driftlog.sources.restore import restore as restore_files
from driftlog.sources.restore import restore_plan


def event_json(timeline: DataFrame) -> DataFrame:
    """Events (session_id, seq, ts, type, data) as JSON lines."""
    return timeline.select(
        "session_id",
        "seq",
        F.to_json(
            F.struct(F.lit(0).alias("v"), "seq", "session_id", "ts", "type", "data")
        ).alias("value"),
    )


def typed_json(timeline: DataFrame, start_fields: dict[str, str] | None = None) -> DataFrame:
    """Typed events, one body column per event type, as JSON lines.  Absent
    optional fields are left out; ``start_fields`` are further text fields of
    session_start, as a producer's versions."""
    more = [F.lit(value).alias(name) for name, value in (start_fields or {}).items()]
    bodies = [
        F.when(F.col("type") == name, F.to_json(F.struct(f"{name}.*", *more) if name == "session_start" and more else F.col(name)))
        for name in BODIES
    ]
    return event_json(timeline.withColumn("data", F.parse_json(F.coalesce(*bodies))))


def write_timeline(lines: DataFrame, path: str, part_rows: int = 65_536) -> None:
    """Export JSON lines (session_id, seq, value) as text.

    A session becomes a folder of parts in sequence order; a part holds at
    most ``part_rows`` consecutive events, so a long session is written by
    many tasks.
    """
    part = F.lpad(seq_chunk("seq", part_rows).cast("string"), 12, "0")
    spark = lines.sparkSession
    # A fixed count keeps the writers parallel when the data is small.
    writers = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    parts = (
        lines.withColumn("part", part)
        .repartition(writers, "session_id", "part")
        .sortWithinPartitions("session_id", "part", "seq")
        .select("session_id", "part", "value")
    )
    named = spark.conf.get("spark.hadoop.fs.defaultFS", "file:///")
    if export.is_local(path) and (path.startswith("file:") or named.startswith("file:")):
        export.write_parts(parts, path)
    else:
        parts.write.partitionBy("session_id", "part").option("lineSep", "\n").text(path)


def unpublished_objects(watermarks: DataFrame, published: DataFrame) -> DataFrame:
    """Immutable objects still to be written for session_id, durable_seq."""
    named = watermarks.select(
        "session_id", "durable_seq", event_object_name(F.col("durable_seq")).alias("events_object")
    )
    return named.join(
        published.select("session_id", "events_object"), ["session_id", "events_object"], "left_anti"
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [found.getPath().getName() for found in system.listStatus(where)] if system.exists(where) else []


class DurableStore:
    """Accepted events and their watermark as parquet below one folder.

    Publication n writes, in this order:

    ``staged/pub=n``     events that wait behind a gap, by bucket of sessions
    ``conflicts/pub=n``  events refused because another content was there
    ``state/pub=n``      of every bucket it touches, the runs of each session's
                         sequence numbers: the accepted prefix from 0, and the
                         staged runs with the publication that holds them
    ``accepted/pub=n``   events that now continue the gapless prefixes
    ``heads/n``          which publication has each bucket's state

    The head makes the publication visible; a failed attempt is written over or,
    if only its head is missing, finished by the next one.  So data comes first,
    the watermark last, and it never passes a gap.

    A batch reads the state of its buckets, staged events only where a run is
    released or written again, and accepted events only for sequence numbers
    behind the watermark: what it reads follows the batch, not the history.
    A replayed event is ignored; one with another content for an accepted or
    staged number, or two in one batch, of which the least digest is taken, is a
    conflict row.  One writer publishes at a time.  Numbers start at 0.
    """

    BUCKETS = 64
    _STATE = "session_id string, from_seq bigint, to_seq bigint, held bigint"
    # A run that stands in the accepted table.
    _ACCEPTED = -1

    def __init__(self, spark: SparkSession, path: str, schema: str, writer: str | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema
        self.writer = writer or uuid.uuid4().hex
        self.columns = spark.createDataFrame([], schema).columns

    # ------------------------------------------------------------- reading

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("session_id"), F.lit(self.BUCKETS)).cast("int").alias("bucket")

    def _latest(self) -> int:
        """The last complete publication, -1 before the first."""
        done = [int(n) for n in folder_names(self.spark, f"{self.path}/heads") if n.isdigit()]
        done = sorted((n for n in done if path_exists(self.spark, f"{self.path}/heads/{n}/_SUCCESS")), reverse=True)
        return done[0] if done else -1

    def _heads(self, publication: int) -> dict[int, int]:
        """The publication with the state of each bucket; one row per bucket."""
        if publication < 0:
            return {}
        found = self.spark.read.schema("bucket int, pub bigint").parquet(f"{self.path}/heads/{publication}")
        return {r.bucket: r.pub for r in found.collect()}

    def _partitions(self, kind: str, places: list[str], schema: str) -> DataFrame:
        there = [p for p in (f"{self.path}/{kind}/{place}" for place in places) if path_exists(self.spark, p)]
        if not there:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*there)

    def _state(self, heads: dict[int, int], buckets: list[int] | None = None) -> DataFrame:
        wanted = [b for b in heads if buckets is None or b in buckets]
        return self._partitions("state", [f"pub={heads[b]}/bucket={b}" for b in sorted(wanted)], self._STATE)

    def _table(self, kind: str) -> DataFrame:
        """All committed publications of a table, pruned by pub and bucket."""
        if not path_exists(self.spark, f"{self.path}/{kind}"):
            return self.spark.createDataFrame([], f"{self.schema}, pub bigint, bucket int")
        whole = self.spark.read.schema(f"{self.schema}, pub bigint, bucket int").parquet(f"{self.path}/{kind}")
        return whole.filter(F.col("pub") <= self._latest())

    def watermarks(self) -> DataFrame:
        """Newest durable sequence per session; all events up to it are there."""
        state = self._state(self._heads(self._latest()))
        return state.filter(F.col("held") == self._ACCEPTED).select("session_id", F.col("to_seq").alias("durable_seq"))

    def visible(self) -> DataFrame:
        """Events at or behind the watermark, each (session_id, seq) once."""
        return self._table("accepted").select(*self.columns)

    def conflicts(self) -> DataFrame:
        """Refused events with the ``reason``: what holds their number."""
        if not path_exists(self.spark, f"{self.path}/conflicts"):
            return self.spark.createDataFrame([], f"{self.schema}, reason string")
        whole = self.spark.read.schema(f"{self.schema}, reason string, pub bigint").parquet(f"{self.path}/conflicts")
        return whole.filter(F.col("pub") <= self._latest()).drop("pub")

    def live(self) -> DataFrame:
        """Stream over accepted events, each (session_id, seq) once; it may
        start before the first publication."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/accepted")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(where)
        return self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/accepted")

    # ---------------------------------------------------------- publishing

    def _write(self, rows: DataFrame, kind: str, publication: int, by_bucket: bool = True) -> None:
        writer = rows.write.mode("overwrite")
        if by_bucket:
            writer = writer.partitionBy("bucket")
        writer.parquet(f"{self.path}/{kind}/pub={publication}")

    def _commit(self, heads: dict[int, int], publication: int) -> None:
        rows = self.spark.createDataFrame(sorted(heads.items()), "bucket int, pub bigint")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/heads/{publication}")

    def _next(self) -> tuple[int, dict[int, int]]:
        """The number of the publication to write, after finishing one that
        wrote its data but no head; and the heads before it."""
        latest = self._latest()
        heads, coming = self._heads(latest), latest + 1
        if path_exists(self.spark, f"{self.path}/accepted/pub={coming}/_SUCCESS"):
            names = folder_names(self.spark, f"{self.path}/state/pub={coming}")
            heads |= {int(n.split("=")[1]): coming for n in names if n.startswith("bucket=")}
            self._commit(heads, coming)
            coming += 1
        return coming, heads

    def _sort_out(self, batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The events of a batch whose number nothing holds, and conflicts."""
        key = ["session_id", "seq"]
        whole = F.struct(*self.columns)
        marked = batch.withColumn("digest", F.sha2(F.to_json(whole), 256))
        chosen = marked.groupBy(*key).agg(
            F.min_by(whole, "digest").alias("event"), F.min("digest").alias("digest"), F.max("digest").alias("other")
        )
        chosen = save_and_reload(chosen, "chosen")
        doubled = chosen.filter("digest <> other").select(*key, F.col("digest").alias("taken"))
        conflicts = marked.join(doubled, key).filter("digest <> taken").select(*self.columns, F.lit("batch").alias("reason"))

        # The run that a number falls into is the last one to begin before it.
        run = F.struct("to_seq", "held")
        places = chosen.select(*key, "digest", F.lit(1).alias("kind")).unionByName(
            state.select("session_id", F.col("from_seq").alias("seq"), F.lit(0).alias("kind"), run.alias("run")),
            allowMissingColumns=True,
        )
        placed = ordered_scan(
            places, ["session_id"], ["seq", "kind"], seq_chunk("seq"), last={"inside": F.col("run")}
        ).filter("kind = 1")
        placed = save_and_reload(placed.withColumn("held", F.when(F.col("inside.to_seq") >= F.col("seq"), F.col("inside.held"))), "placed")
        events = chosen.select(*key, "event")
        fresh = placed.filter("held is null").select(*key).join(events, key).select("event.*")
        known = placed.filter("held is not null")
        if known.isEmpty():
            return fresh, conflicts
        late = known.filter(F.col("held") == self._ACCEPTED).withColumn("bucket", self._bucket())
        buckets = [r.bucket for r in late.select("bucket").distinct().collect()]
        pubs = [r.held for r in known.filter(F.col("held") >= 0).select("held").distinct().collect()]
        for kind, reason, held in (
            ("accepted", "accepted", self._table("accepted").filter(F.col("bucket").isin(buckets))),
            ("staged", "staged", self._partitions("staged", [f"pub={p}" for p in pubs], self.schema)),
        ):
            again = known.filter((F.col("held") == self._ACCEPTED) == (kind == "accepted"))
            there = held.select(*key, F.sha2(F.to_json(whole), 256).alias("there"))
            unlike = again.join(there, key).filter("digest <> there").select(*key)
            conflicts = conflicts.unionByName(
                unlike.join(events, key).select("event.*").withColumn("reason", F.lit(reason))
            )
        return fresh, conflicts

    def publish(self, batch: DataFrame, batch_id: int) -> None:
        """Publish one batch; usable as a ``foreachBatch`` function."""
        batch = save_and_reload(batch.select(*self.columns), "batch")
        touched = [r.bucket for r in batch.select(self._bucket()).distinct().collect()]
        if not touched:
            return
        number, heads = self._next()
        state = save_and_reload(self._state(heads, touched), "state")
        own = state.join(batch.select("session_id").distinct(), "session_id", "left_semi")
        fresh, conflicts = self._sort_out(batch, own)
        fresh = save_and_reload(fresh, "fresh")

        # New runs, and which runs continue the prefix without a gap.
        ranked = ordered_scan(fresh.select("session_id", "seq"), ["session_id"], ["seq"], seq_chunk("seq"), rank="rank")
        runs = ranked.groupBy("session_id", F.col("seq") - F.col("rank")).agg(
            F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq")
        ).select("session_id", "from_seq", "to_seq", F.lit(number).cast("bigint").alias("held"))
        chain = ordered_scan(
            own.unionByName(runs), ["session_id"], ["from_seq"], seq_chunk("from_seq"), prev={"before": F.col("to_seq")}
        )
        gap = F.col("from_seq") != F.coalesce("before", F.lit(-1)) + 1
        chain = ordered_scan(
            chain, ["session_id"], ["from_seq"], seq_chunk("from_seq"), sums={"gaps": gap.cast("bigint")}
        )
        chain = save_and_reload(chain, "chain")
        prefix = chain.filter("gaps = 0")
        reached = prefix.groupBy("session_id").agg(F.max("to_seq").alias("durable_seq"))
        released = prefix.filter((F.col("held") >= 0) & (F.col("held") != number))
        pubs = [r.held for r in released.select("held").distinct().collect()]

        marked = attach_facts(fresh, reached, ["session_id"], F.col("seq"))
        ahead = F.col("durable_seq").isNull() | (F.col("seq") > F.col("durable_seq"))
        staged = marked.filter(ahead).select(*self.columns, self._bucket())
        waiting = self._partitions("staged", [f"pub={p}" for p in pubs], self.schema)
        old = own.filter(F.col("held") == self._ACCEPTED).select("session_id", F.col("to_seq").alias("old_seq"))
        now_free = waiting.join(reached.join(old, "session_id", "left"), "session_id").filter(
            "seq <= durable_seq and seq > coalesce(old_seq, -1)"
        )
        accepted = marked.filter(~ahead).select(*self.columns).unionByName(now_free.select(*self.columns))
        kept = chain.filter("gaps > 0").select("session_id", "from_seq", "to_seq", "held").unionByName(
            reached.select("session_id", F.lit(0).cast("bigint").alias("from_seq"), F.col("durable_seq").alias("to_seq"),
                           F.lit(self._ACCEPTED).cast("bigint").alias("held"))
        )
        others = state.join(batch.select("session_id").distinct(), "session_id", "left_anti")

        self._write(staged, "staged", number)
        self._write(conflicts, "conflicts", number, by_bucket=False)
        self._write(kept.unionByName(others).select("*", self._bucket()), "state", number)
        self._write(accepted.select("*", self._bucket()), "accepted", number)
        self._commit(heads | dict.fromkeys(touched, number), number)

    def write_objects(self) -> None:
        """Write the immutable event object of every session's watermark that is
        not there yet: ``objects/session_id=S/object=NAME`` in seq order."""
        named = unpublished_objects(self.watermarks(), self.published())
        events = attach_facts(self.visible(), named.select("session_id", "events_object"), ["session_id"], F.col("seq"), how="inner")
        columns = [F.col(c) for c in self.spark.createDataFrame([], self.schema).columns]
        lines = events.select(
            "session_id", F.replace("events_object", F.lit("events/"), F.lit("")).alias("object"), "seq",
            F.to_json(F.struct(*columns)).alias("value"),
        )
        chunk = F.lpad(seq_chunk("seq").cast("string"), 12, "0")
        (
            lines.withColumn("part", chunk)
            .repartition("session_id", "object", "part")
            .sortWithinPartitions("session_id", "object", "part", "seq")
            .drop("seq")
            .write.mode("append").partitionBy("session_id", "object", "part").text(f"{self.path}/objects")
        )

    def published(self) -> DataFrame:
        """session_id and events_object of the objects that are there."""
        found = list_files(self.spark, f"{self.path}/objects")
        return found.select(
            F.regexp_extract("path", "session_id=([^/]+)/", 1).alias("session_id"),
            F.concat(F.lit("events/"), F.regexp_extract("path", "object=([^/]+)/", 1)).alias("events_object"),
        ).distinct()


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files below a folder, empty ones too; their
    content is not read.  A folder that is not there has none."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "path string, length bigint")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def advance_cursor(acks: DataFrame, path: str) -> None:
    """Append acknowledgements (session_id, sink, delivered_seq) to a log."""
    acks.select("session_id", "sink", "delivered_seq").write.mode("append").parquet(path)


def load_cursor(spark: SparkSession, path: str) -> DataFrame:
    """Current position per session and sink: the highest acknowledged one."""
    log = spark.read.schema("session_id string, sink string, delivered_seq bigint").parquet(path)
    return log.groupBy("session_id", "sink").agg(F.max("delivered_seq").alias("delivered_seq"))


def restore(files: DataFrame, destination: str, session_folder: str) -> int:
    """``restore.restore``; returns how many files and links were written, and
    refuses everything if one path is unsafe."""
    plan = restore_plan(files)
    if not plan.filter("outcome = 'unsafe_path'").isEmpty():
        raise ValueError("unsafe path")
    done = restore_files(files, destination, session_folder)
    return done.filter(F.col("outcome").isin("write", "link")).count()
