"""Greedy segments of ordered rows: activity windows and delivery batches.

The next segment start depends on the current one, so a key is a chain.  The
chain is cut into chunks of the order column and followed in three steps:

1. per chunk (parallel): for every position where a segment could enter the
   chunk, where would the chain leave it;
2. follow these small tables from chunk to chunk;
3. per chunk (parallel): with the true entry known, emit the segment starts.

For windows, step 2 is a tree: a chunk maps the window carried into it to the
one carried out, piecewise constant, and such maps compose.  Blocks of chunks
are composed in parallel, one row per block is followed per key, and the blocks
are followed again in parallel, each from its own entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Stands for "no value" in integer columns that pandas must keep exact.
_NONE = -(1 << 63)


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole key groups from key-sorted Arrow batches, several per frame.

    A batch may end inside a group; its last group waits for the next batch.
    """
    pending: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        last_key = frame[keys].iloc[-1]
        same = np.ones(len(frame), dtype=bool)
        for key in keys:
            same &= (frame[key] == last_key[key]).to_numpy()
        cut = len(frame) - int(same[::-1].argmin()) if not same.all() else 0
        if cut == 0:
            previous = pending[-1] if pending else None
            if previous is not None and not (previous[keys].iloc[-1] == last_key).all():
                yield pd.concat(pending, ignore_index=True)
                pending = []
            pending.append(frame)
            continue
        yield pd.concat([*pending, frame.iloc[:cut]], ignore_index=True)
        pending = [frame.iloc[cut:]]
    if pending:
        yield pd.concat(pending, ignore_index=True)


def _starts_of_groups(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    changed = np.zeros(len(frame), dtype=bool)
    changed[0] = True
    for key in keys:
        values = frame[key].to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)


def _bounds_of_groups(frame: pd.DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    low = _starts_of_groups(frame, keys)
    return list(zip(low.tolist(), [*low[1:].tolist(), len(frame)], strict=True))


def _by_chunk(rows: DataFrame, order: str) -> DataFrame:
    """Whole chunks per task, in order."""
    return rows.repartition("session_id", "chunk").sortWithinPartitions("session_id", "chunk", order)


def _chain_end(step: np.ndarray, stop: int) -> np.ndarray:
    """For every position, the last chain position before ``stop``."""
    here = np.arange(len(step))
    jump = np.where(step >= stop, here, step)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return jump
        jump = further


# --------------------------------------------------------------------------
# Capped debounce over distinct instants
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Debounce:
    """Window rule: open at the first instant, close once ``quiescence_ms``
    pass without another one or ``max_delay_ms`` after the first."""

    quiescence_ms: int = 1_500
    max_delay_ms: int = 10_000
    chunk_width_ms: int | None = None

    def __post_init__(self) -> None:
        if self.quiescence_ms <= 0 or self.max_delay_ms <= 0:
            raise ValueError("quiescence and max delay must be positive")

    @property
    def chunk_ms(self) -> int:
        """Several caps long, so few positions can be an entry; a chunk holds
        at most this many distinct milliseconds."""
        return self.chunk_width_ms or max(600_000, 8 * self.max_delay_ms)


class _Chunks:
    """All chunks of a frame at once: next window starts and entry positions.

    Positions of all chunks share one sorted key (chunk number, deadline), so
    one binary search serves every chunk.
    """

    def __init__(self, frame: pd.DataFrame, rule: Debounce):
        self.t, self.eff = frame["t_ms"].to_numpy(), frame["eff_ms"].to_numpy()
        self.epoch, self.rule = frame["epoch"].to_numpy(), rule
        count = len(frame)
        self.low = _starts_of_groups(frame, ["session_id", "chunk"])
        self.high = np.append(self.low[1:], count)
        self.group = np.repeat(np.arange(len(self.low)), self.high - self.low)
        self.floor = min(int(self.eff.min()), int(self.t.min()))
        self.span = int(max(self.eff.max(), self.t.max())) + rule.max_delay_ms - self.floor + 2
        self.key = self.group * self.span + (self.eff - self.floor)

        gap = self.t[:-1] + rule.quiescence_ms <= self.eff[1:]
        forced = np.zeros(count, dtype=bool)
        forced[1:] = (self.epoch[1:] != self.epoch[:-1]) | gap
        forced[self.low] = False
        at = np.where(forced, np.arange(count), count)
        nearest = np.append(np.minimum.accumulate(at[::-1])[::-1], count)
        end = self.high[self.group]
        self.first_forced = np.minimum(nearest[self.low], self.high)
        capped = self.at_or_after(self.group, self.t + rule.max_delay_ms)
        self.step = np.minimum(np.minimum(nearest[1:], capped), end)

    def at_or_after(self, group: np.ndarray, deadline: np.ndarray) -> np.ndarray:
        """First position of the chunk whose eff reaches the deadline."""
        offset = np.clip(deadline - self.floor, 0, self.span - 1)
        return np.searchsorted(self.key, group * self.span + offset, side="left")

    def window_ends(self) -> np.ndarray:
        """For every position, the last window start of its chain."""
        here = np.arange(len(self.step))
        jump = np.where(self.step >= self.high[self.group], here, self.step)
        while True:
            further = jump[jump]
            if np.array_equal(further, jump):
                return jump
            jump = further


# Chunks composed by one task; a key is followed over its blocks alone.
FOLD_CHUNKS = 512

_TIME_EDGE_SCHEMA = (
    "session_id string, chunk bigint, first_t bigint, first_eff bigint, first_epoch bigint, "
    "last_t bigint, last_epoch bigint, entries array<bigint>, exits array<bigint>, forced_exit bigint"
)
_TIME_EDGE_COLUMNS = [field.split(" ")[0] for field in _TIME_EDGE_SCHEMA.split(", ")]


def _distinct_exits(entries: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Breakpoints only: the last entry of each run with one exit."""
    kept = np.append(exits[1:] != exits[:-1], True)
    return entries[kept], exits[kept]


def _pieces(maps) -> dict[str, list[np.ndarray]]:
    small = [_distinct_exits(entries, exits) for entries, exits in maps]
    return {"entries": [m[0] for m in small], "exits": [m[1] for m in small]}


class _Fold:
    """Follows chunk rows of one key; what is carried may be many values."""

    def __init__(self, rule: Debounce):
        self.rule = rule

    def connected(self, before, row) -> bool:
        """Whether a window can reach from one chunk row into the next."""
        return row.first_epoch == before.last_epoch and before.last_t + self.rule.quiescence_ms > row.first_eff

    def through(self, row, carried: np.ndarray) -> np.ndarray:
        """The windows carried out of a chunk by those carried into it."""
        at = np.searchsorted(row.entries, carried + self.rule.max_delay_ms, side="left")
        inside = at < len(row.exits)
        past = carried if pd.isna(row.forced_exit) else np.full(len(carried), int(row.forced_exit))
        return np.where(inside, np.asarray(row.exits)[np.minimum(at, len(row.exits) - 1)], past)


def _time_compose(rule: Debounce):
    """One row per block of chunks, with the map of the whole block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = _Fold(rule)
        for frame in _groups(frames, ["session_id", "block"]):
            rows = []
            for a, b in _bounds_of_groups(frame, ["session_id", "block"]):
                block = list(frame.iloc[a:b].itertuples(index=False))
                first, before = block[0], block[0]
                entries, exits = np.asarray(first.entries), np.asarray(first.exits)
                tail = None if pd.isna(first.forced_exit) else int(first.forced_exit)
                # What is carried in began before the block: its latest deadline.
                due = first.chunk * rule.chunk_ms + rule.max_delay_ms
                for row in block[1:]:
                    if not fold.connected(before, row):
                        tail = int(row.exits[0])
                        exits = np.full(len(exits), tail)
                    else:
                        exits = fold.through(row, exits)
                        if tail is not None:
                            tail = int(fold.through(row, np.array([tail]))[0])
                        elif entries[-1] < due:
                            # A window may have come through all chunks so far.
                            later = np.flatnonzero(np.asarray(row.entries) > entries[-1])
                            later = later[: np.searchsorted(np.asarray(row.entries)[later], due, "left") + 1]
                            entries = np.concatenate((entries, np.asarray(row.entries)[later]))
                            exits = np.concatenate((exits, np.asarray(row.exits)[later]))
                            tail = None if pd.isna(row.forced_exit) else int(row.forced_exit)
                    entries, exits = _distinct_exits(entries, exits)
                    before = row
                rows.append((first.session_id, first.block, first.first_t, first.first_eff, first.first_epoch,
                             before.last_t, before.last_epoch, entries, exits, tail))
            out = pd.DataFrame(rows, columns=_TIME_EDGE_COLUMNS)
            out["forced_exit"] = out["forced_exit"].astype("Int64")
            yield out

    return run


def _time_edges(rule: Debounce):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _groups(frames, ["session_id", "chunk"]):
            c = _Chunks(frame, rule)
            sessions, chunks = frame["session_id"].to_numpy()[c.low], frame["chunk"].to_numpy()[c.low]
            ends = c.t[c.window_ends()]
            reach = c.at_or_after(np.arange(len(c.low)), chunks * rule.chunk_ms + rule.max_delay_ms)
            stop = np.minimum(np.minimum(reach + 1, c.high), c.first_forced)
            has_forced = c.first_forced < c.high
            forced_exit = np.where(has_forced, ends[np.minimum(c.first_forced, len(ends) - 1)], 0)
            yield pd.DataFrame(
                {
                    "session_id": sessions,
                    "chunk": chunks,
                    "first_t": c.t[c.low],
                    "first_eff": c.eff[c.low],
                    "first_epoch": c.epoch[c.low],
                    "last_t": c.t[c.high - 1],
                    "last_epoch": c.epoch[c.high - 1],
                    **_pieces((c.eff[a:b], ends[a:b]) for a, b in zip(c.low, stop)),
                    "forced_exit": pd.array(forced_exit, dtype="Int64"),
                }
            ).assign(forced_exit=lambda out: out["forced_exit"].where(has_forced))

    return run


def _time_fold(rule: Debounce):
    """The window carried into every row, following rows sorted by (session,
    chunk); a row without entries states what is carried into its block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = _Fold(rule)
        before, start, given = None, None, False
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                if row.entries is None:
                    before, start, given = row, None if pd.isna(row.forced_exit) else int(row.forced_exit), True
                    continue
                same = before is not None and row.session_id == before.session_id
                carried = start if same and (given or fold.connected(before, row)) else None
                given = False
                rows.append((row.session_id, row.chunk, carried))
                start = int(row.exits[0]) if carried is None else int(fold.through(row, np.array([carried]))[0])
                before = row
            out = pd.DataFrame(rows, columns=["session_id", "chunk", "carried"])
            out["carried"] = out["carried"].astype("Int64")
            yield out

    return run


def _time_assign(rule: Debounce, extra: list[str]):
    """Windows of the instants of each chunk; a chunk's first row holds the
    window carried into it instead of an instant."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _groups(frames, ["session_id", "chunk"]):
            is_lead = frame["t_ms"].to_numpy() == _NONE
            carried = frame["eff_ms"].to_numpy()[is_lead]
            frame = frame[~is_lead]
            c = _Chunks(frame, rule)
            known = carried != _NONE
            due = np.where(known, carried, 0) + rule.max_delay_ms
            entry = np.where(
                known, np.minimum(c.at_or_after(np.arange(len(c.low)), due), c.first_forced), c.low
            )
            step, is_start = c.step.tolist(), np.zeros(len(frame), dtype=bool)
            starts: list[int] = []
            for position, end in zip(entry.tolist(), c.high.tolist()):
                while position < end:
                    starts.append(position)
                    position = step[position]
            is_start[starts] = True
            # Instants before a chunk's first start belong to the carried window.
            value = np.where(is_start, c.t, carried[c.group])
            known_at = is_start.copy()
            known_at[c.low] = True
            source = np.maximum.accumulate(np.where(known_at, np.arange(len(frame)), 0))
            out = frame[["session_id", "t_ms"]].copy()
            out["window_start"] = value[source]
            for name in extra:
                out[name] = frame[name]
            yield out

    return run


def debounce_instants(
    instants: DataFrame, rule: Debounce, extra: tuple[str, ...] = ()
) -> DataFrame:
    """Map each distinct (session_id, t_ms) to its window's start.

    ``instants`` has session_id, t_ms, eff_ms (the latest deadline that has
    fired before this instant is at most eff_ms; equals t_ms outside pauses)
    and epoch (changes where a command closes the open window).  The BIGINT
    columns named in ``extra`` are passed on.
    """
    absent = F.lit(_NONE)
    chunked = instants.select(
        "session_id",
        F.floor(F.col("t_ms") / rule.chunk_ms).cast("bigint").alias("chunk"),
        "t_ms",
        "eff_ms",
        "epoch",
        *[F.coalesce(name, absent).alias(name) for name in extra],
    )
    # Both passes read the same columns, so Spark shares the work below them.
    edges = _by_chunk(chunked, "t_ms").mapInPandas(_time_edges(rule), _TIME_EDGE_SCHEMA)
    edges = edges.withColumn("block", F.floor(F.col("chunk") / FOLD_CHUNKS).cast("bigint"))

    def by_block(rows: DataFrame) -> DataFrame:
        order = ["session_id", "block", F.col("entries").isNotNull(), "chunk"]
        return rows.repartition("session_id", "block").sortWithinPartitions(*order)

    carried = "session_id string, chunk bigint, carried bigint"
    into_blocks = (
        by_block(edges)
        .mapInPandas(_time_compose(rule), _TIME_EDGE_SCHEMA)
        .repartition("session_id")
        .sortWithinPartitions("session_id", "chunk")
        .mapInPandas(_time_fold(rule), carried)
    )
    given = into_blocks.select("session_id", F.col("chunk").alias("block"), F.col("carried").alias("forced_exit"))
    entries = by_block(edges.unionByName(given, allowMissingColumns=True)).mapInPandas(_time_fold(rule), carried)
    # The carried window travels as the first row of its chunk.  A join would
    # let skew handling split a chunk between tasks.
    lead = entries.select(
        "session_id",
        "chunk",
        absent.alias("t_ms"),
        F.coalesce("carried", absent).alias("eff_ms"),
        F.lit(0).cast("bigint").alias("epoch"),
        *[absent.alias(name) for name in extra],
    )
    schema = "session_id string, t_ms bigint, window_start bigint" + "".join(
        f", {name} bigint" for name in extra
    )
    return (
        _by_chunk(chunked.unionByName(lead), "t_ms")
        .mapInPandas(_time_assign(rule, list(extra)), schema)
        .select(
            "session_id",
            "t_ms",
            "window_start",
            *[F.nullif(F.col(name), absent).alias(name) for name in extra],
        )
    )


# --------------------------------------------------------------------------
# Batches by count and bytes over contiguous sequence numbers
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class BatchLimit:
    """A batch holds at most ``max_events`` events and, as a JSON array, at
    most ``max_bytes`` bytes: two brackets, the events, commas between."""

    max_events: int = 100
    max_bytes: int = 1 << 20
    chunk_width: int | None = None

    def __post_init__(self) -> None:
        if self.max_events <= 0 or self.max_bytes <= 0:
            raise ValueError("batch limits must be positive")

    @property
    def chunk_rows(self) -> int:
        return max(self.chunk_width or max(65_536, 16 * self.max_events), self.max_events)


def _batch_steps(length: np.ndarray, limit: BatchLimit) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(length + 1)])
    here = np.arange(len(length))
    by_bytes = np.searchsorted(total, total[:-1] + limit.max_bytes - 1, side="right") - 1
    return np.maximum(here + 1, np.minimum(by_bytes, here + limit.max_events))


def _batch_edges(limit: BatchLimit):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _groups(frames, ["session_id", "chunk"]):
            bounds = np.append(_starts_of_groups(frame, ["session_id", "chunk"]), len(frame))
            sessions, chunks, seqs = (frame[c].to_numpy() for c in ("session_id", "chunk", "seq"))
            lengths, aheads = frame["len"].to_numpy(), frame["ahead"].to_numpy()
            rows = []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                own = int((~aheads[lo:hi]).sum())
                if own == 0:
                    continue
                step = _batch_steps(lengths[lo:hi], limit)
                leave = step[_chain_end(step, own)]
                count = min(own, limit.max_events)
                rows.append((sessions[lo], chunks[lo], seqs[lo], seqs[lo] + leave[:count]))
            yield pd.DataFrame(rows, columns=["session_id", "chunk", "first_seq", "leaves"])

    return run


def _batch_fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    session, entry = None, None
    for frame in frames:
        rows = []
        for row in frame.itertuples(index=False):
            if row.session_id != session:
                session, entry = row.session_id, row.first_seq
            rows.append((row.session_id, row.chunk, entry))
            position = int(entry - row.first_seq)
            if 0 <= position < len(row.leaves):
                entry = int(row.leaves[position])
        yield pd.DataFrame(rows, columns=["session_id", "chunk", "entry"])


def _batch_assign(limit: BatchLimit):
    """Batches that start in each chunk; a chunk's first row holds where the
    first of them starts instead of an event."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _groups(frames, ["session_id", "chunk"]):
            bounds = np.append(_starts_of_groups(frame, ["session_id", "chunk"]), len(frame))
            sessions, seqs = frame["session_id"].to_numpy(), frame["seq"].to_numpy()
            lengths, aheads = frame["len"].to_numpy(), frame["ahead"].to_numpy()
            rows: list[tuple] = []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if seqs[lo] != _NONE:
                    continue  # only the head of the next chunk
                entry = lengths[lo]
                seq, length = seqs[lo + 1 : hi], lengths[lo + 1 : hi]
                own = int((~aheads[lo + 1 : hi]).sum())
                step = _batch_steps(length, limit)
                total = np.concatenate([[0], np.cumsum(length + 1)])
                position = int(entry - seq[0])
                while position < own:
                    until = min(int(step[position]), len(seq))
                    rows.append(
                        (sessions[lo], seq[position], seq[until - 1], until - position,
                         int(total[until] - total[position]) + 1)
                    )
                    position = until
            yield pd.DataFrame(
                rows, columns=["session_id", "first_seq", "last_seq", "events", "bytes"]
            )

    return run


def batch_bounds(events: DataFrame, limit: BatchLimit) -> DataFrame:
    """Batches of contiguous ``events`` (session_id, seq, len): first_seq,
    last_seq, events, bytes.  An event that exceeds the byte limit alone gets
    a batch of its own whose ``bytes`` is over the limit."""
    width = limit.chunk_rows
    chunk = F.floor(F.col("seq") / width).cast("bigint")
    slim = events.select(
        "session_id", F.col("seq").cast("bigint").alias("seq"), F.col("len").cast("bigint").alias("len")
    )
    # The head of a chunk is also sent to the chunk before it, because a batch
    # that starts there may end here.
    heads = F.when(
        F.col("seq") % width < limit.max_events, F.array(chunk, chunk - 1)
    ).otherwise(F.array(chunk))
    chunked = slim.withColumn("chunk", F.explode(heads)).withColumn("ahead", F.col("chunk") < chunk)
    edges = _by_chunk(chunked, "seq").mapInPandas(
        _batch_edges(limit),
        "session_id string, chunk bigint, first_seq bigint, leaves array<bigint>",
    )
    entries = (
        edges.repartition("session_id")
        .sortWithinPartitions("session_id", "chunk")
        .mapInPandas(_batch_fold, "session_id string, chunk bigint, entry bigint")
    )
    lead = entries.select(
        "session_id",
        F.lit(_NONE).alias("seq"),
        F.col("entry").alias("len"),
        "chunk",
        F.lit(False).alias("ahead"),
    )
    return _by_chunk(chunked.unionByName(lead), "seq").mapInPandas(
        _batch_assign(limit),
        "session_id string, first_seq bigint, last_seq bigint, events bigint, bytes bigint",
    )


__all__ = ["BatchLimit", "Debounce", "batch_bounds", "debounce_instants"]
