"""Mixing sources to target weights by Sainte-Laguë apportionment.

The words of every source are laid out as streams: a document belongs to a
shard of its source, and inside a shard documents follow each other in a seeded
order.  Streams are cut into blocks of equally many words.  Blocks are given to
sources by highest quotients ``target / (2 * blocks + 1)``, and the blocks of a
source to its shards in the same way, so every quota is an integer.  A shard
then takes whole passes over its stream and, for the rest, the blocks that a
seeded permutation puts first.  No block is stored: a document finds its share
from its own place in the stream.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlog.llm.text import Texts, find_words, slices
from driftlog.session import save_and_reload

BLOCK_WORDS = 16
SHARD_WORDS = 4_000_000
TOTAL = 1.5
MOST = 2.0
WEIGHTS = (5.0, 2.0, 1.0)
SEED = 7


def word_count(text: Column) -> Column:
    """Number of words; a word starts where a space or the text's start ends."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def capped_targets(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> np.ndarray:
    """Shares of ``total`` words by weight; what exceeds ``most`` times a size
    goes to the others by weight until none exceeds it."""
    caps = most * sizes.astype(np.float64)
    full = np.zeros(len(sizes), bool)
    target = np.zeros(len(sizes))
    while True:
        free = ~full
        rest = total - caps[full].sum()
        target = np.where(full, caps, 0.0)
        if free.any():
            target[free] = rest * weights[free] / weights[free].sum()
        over = free & (target > caps)
        if not over.any():
            return target
        full |= over


def sainte_lague(claims: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients claim / (2 k + 1), at most ``most`` each.

    Equal quotients go to the earlier claim.  The seat counts follow from the
    least quotient that still gets a seat, found by bisection, so the work does
    not depend on the number of seats.
    """
    claims = np.asarray(claims, np.float64)
    most = np.where(claims > 0, most, 0).astype(np.int64)
    seats = int(min(seats, most.sum()))

    def above(quotient: float) -> np.ndarray:
        return np.minimum(np.maximum(np.ceil((claims / quotient - 1) / 2), 0), most).astype(np.int64)

    if seats <= 0:
        return np.zeros(len(claims), np.int64)
    low, high = 0.0, float(claims.max()) * 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (low, middle) if above(middle).sum() <= seats else (middle, high)
    given = above(high)
    while given.sum() < seats:
        open_ = given < most
        quotient = np.where(open_, claims / (2 * given + 1), -1.0)
        given[int(np.argmax(quotient))] += 1
    return given


class Plan(NamedTuple):
    """Per source: name, size and target.  Per shard: words to take."""

    sources: list[str | None]
    sizes: np.ndarray
    targets: np.ndarray
    shard_source: np.ndarray
    shard: np.ndarray
    shard_size: np.ndarray
    shard_take: np.ndarray


def plan_mix(shards: DataFrame, block: int, total: float = TOTAL, most: float = MOST) -> Plan:
    """Targets and quotas from (source, shard, words), one row per shard.

    A shard holds ``SHARD_WORDS`` words, so the driver gets one short row for
    each few megabytes of text.
    """
    rows = shards.toArrow().to_pydict()
    # Code point order is the order of the UTF-8 bytes; NULL comes last.
    names = sorted(set(rows["source"]), key=lambda s: (s is None, (s or "").encode()))
    place = {name: i for i, name in enumerate(names)}
    source = np.array([place[s] for s in rows["source"]], np.int64)
    order = np.lexsort((np.array(rows["shard"], np.int64), source))
    source, shard = source[order], np.array(rows["shard"], np.int64)[order]
    words = np.array(rows["words"], np.int64)[order]
    sizes = np.bincount(source, words, minlength=len(names)).astype(np.int64)
    weights = np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))])
    targets = capped_targets(sizes, weights, total * float(sizes.sum()), most) if len(names) else np.zeros(0)

    quotas = sainte_lague(targets, round(targets.sum() / block), np.floor(most * sizes / block))
    take = np.zeros(len(words), np.int64)
    first = np.searchsorted(source, np.arange(len(names) + 1))
    for i in range(len(names)):
        own = slice(first[i], first[i + 1])
        take[own] = block * sainte_lague(words[own], int(quotas[i]), np.floor(most * words[own] / block))
        # Whole blocks may not fill a capped source: it ends in part of one.
        short = int(targets[i]) - int(take[own].sum())
        if short > 0 and quotas[i] >= math.floor(most * sizes[i] / block):
            room = np.floor(most * words[own]).astype(np.int64) - take[own]
            before = np.cumsum(room) - room
            take[own] += np.clip(short - before, 0, room)
    return Plan(names, sizes, targets, source, shard, words, take)


def _step(blocks: int, seed: int) -> tuple[int, int]:
    """A multiplier without a common factor with ``blocks``, and an offset."""
    rng = np.random.default_rng([seed, blocks])
    step = int(rng.integers(max(blocks // 3, 1), max(blocks, 2)))
    while math.gcd(step, blocks) != 1:
        step += 1
    return step, int(rng.integers(0, blocks))


def _place(docs: DataFrame, seed: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """(row, source, size, shard, first word in the shard's stream) and shard sizes."""
    sized = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
    )
    sized = save_and_reload(sized, "mix-sizes")
    shares = sized.groupBy("source").agg(
        F.ceil(F.sum("size") / F.lit(shard_words)).alias("_shards")
    )
    # Sources are joined by the null-safe equality, so NULL is a source too.
    shares = shares.select(F.col("source").alias("_source"), F.greatest("_shards", F.lit(1)).alias("_shards"))
    rank = F.xxhash64(F.lit(seed), F.col("doc_id"))
    dealt = (
        sized.filter("size > 0")
        .join(shares, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), "_shards"))
        .drop("_source", "_shards")
        # Repeated rows of a document are one run in the stream.
        .groupBy("source", "shard", "doc_id", "size")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    before = Window.partitionBy("source", "shard").orderBy(rank, "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    runs = dealt.withColumn("start", F.coalesce(F.sum(F.col("size") * F.col("rows")).over(before), F.lit(0)))
    placed = runs.withColumn("copy", F.explode(F.expr("sequence(0L, rows - 1)"))).withColumn(
        "start", F.col("start") + F.col("copy") * F.col("size")
    )
    # Texts without words have no place in a stream; however many there are,
    # they stand in no window.
    zero = F.lit(0).cast("bigint")
    wordless = sized.filter("size = 0").select(
        "source", zero.alias("shard"), "doc_id", "size", zero.alias("start"), zero.alias("copy")
    )
    words = dealt.select("source", "shard", (F.col("size") * F.col("rows")).alias("words")).union(
        wordless.select("source", "shard", zero.alias("words")).distinct()
    )
    placed = placed.drop("rows").unionByName(wordless)
    return placed, words.groupBy("source", "shard").agg(F.sum("words").alias("words"))


def _selected(start: np.ndarray, length: np.ndarray, rest: np.ndarray, blocks: np.ndarray, step: np.ndarray, offset: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """Pieces of word runs that lie in chosen blocks: (run, first, last) with
    ``last`` exclusive, counted from the run's first word.

    Block k has rank ``(step * k + offset) mod blocks``; it is taken whole if
    its rank lies below ``rest // block``, and the next block up to the rest.
    """
    low, high = start // block, -(-(start + length) // block)
    count = np.where(length > 0, high - low, 0)
    run = np.repeat(np.arange(len(start)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[run]
    rank = (step[run] * k + offset[run]) % blocks[run]
    whole = rest[run] // block
    take = np.where(rank < whole, block, np.where(rank == whole, rest[run] % block, 0))
    first = np.maximum(k * block, start[run])
    last = np.minimum(k * block + take, start[run] + length[run])
    some = last > first
    return run[some], (first - start[run])[some], (last - start[run])[some]


def _deal(docs: DataFrame, block: int, seed: int, shard_words: int, total: float, most: float) -> DataFrame:
    """Every row's share of the mix; ``copy`` numbers the rows of a document."""
    placed, shards = _place(docs, seed, shard_words)
    placed = save_and_reload(placed, "mix-places")
    plan = plan_mix(save_and_reload(shards, "mix-shards"), block, total, most)
    by_shard = {
        (plan.sources[s], int(j)): i
        for i, (s, j) in enumerate(zip(plan.shard_source, plan.shard, strict=True))
    }
    spots = docs.sparkSession.sparkContext.broadcast((plan, by_shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, by_shard = spots.value
        steps: dict[int, tuple[int, int]] = {}
        for batch in batches:
            source, shard = (batch.column(c).to_pylist() for c in ("source", "shard"))
            at = np.array([by_shard[key] for key in zip(source, shard, strict=True)], np.int64)
            size, start = (np.asarray(batch.column(c)).astype(np.int64) for c in ("size", "start"))
            words = np.maximum(plan.shard_size[at], 1)
            passes, rest = plan.shard_take[at] // words, plan.shard_take[at] % words
            blocks = -(-words // block)
            for n in set(blocks.tolist()) - steps.keys():
                steps[n] = _step(n, seed)
            step, offset = (np.array([steps[n][i] for n in blocks.tolist()], np.int64) for i in range(2))
            run_of, first, last = _selected(start, size, rest, blocks, step, offset, block)
            extra = np.bincount(run_of, last - first, minlength=len(size)).astype(np.int64)
            cuts = np.searchsorted(run_of, np.arange(len(size) + 1)).astype(np.int32)
            pair = pa.StructArray.from_arrays([pa.array(first), pa.array(last)], ["first", "last"])
            owner = plan.shard_source[at]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "source", "copy", "size")),
                    pa.array(plan.sizes[owner]), pa.array(plan.targets[owner]), pa.array(passes * size + extra),
                    pa.array(passes), pa.ListArray.from_arrays(pa.array(cuts), pair),
                ],
                ["doc_id", "source", "copy", "size", "source_size", "target", "taken", "passes", "pieces"],
            )

    return placed.mapInArrow(
        run,
        "doc_id bigint, source string, copy bigint, size bigint, source_size bigint, target double, taken bigint, "
        "passes bigint, pieces array<struct<first:bigint,last:bigint>>",
    )


def mix(
    docs: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED, shard_words: int = SHARD_WORDS,
    total: float = TOTAL, most: float = MOST,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, passes and pieces.

    Sizes are words.  ``taken`` counts the words the mix takes of a row, repeats
    included, and never exceeds ``most`` times its size; ``passes`` says how
    often the whole text is taken and ``pieces`` names the word ranges taken
    besides, as (first, last) with last exclusive.

    A NULL source is a source of its own, the last one.  NULL and empty texts
    have size 0 and nothing is taken of them.  Rows repeating a doc_id follow
    each other in the stream.  The words taken of a source differ from its
    target by at most about a block per cap that binds.  The same table gives
    the same mix on every run.  Other columns are ignored; an empty table gives
    an empty result.
    """
    return _deal(docs, block, seed, shard_words, total, most).drop("copy")


def _cut(text: bytes, pieces: list[dict[str, int]]) -> str:
    one = Texts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    words = find_words(one)
    parts = [text[words.starts[p["first"]] : words.ends[p["last"] - 1]] for p in pieces]
    return b" ".join(parts).decode()


def mix_documents(
    docs: DataFrame, block: int = 512, seed: int = SEED, shard_words: int = SHARD_WORDS,
    total: float = TOTAL, most: float = MOST,
) -> DataFrame:
    """The mixed corpus with the columns of ``docs`` (doc_id, text, source ...).

    A document stands once for each whole pass, and once more with the words of
    its chosen blocks if only some are taken; n_chars, where present, follows
    the text.  Documents that get no words are left out.  Repeated rows of one
    document and size all get the share of the first of them.
    """
    keys = {"doc_id": "bigint", "source": "string"}
    shares = _deal(docs, block, seed, shard_words, total, most).filter("copy = 0 and taken > 0").select(
        *[F.col(c).alias(f"_mix_{c}") for c in ("doc_id", "source", "size", "passes", "pieces")]
    )
    size = word_count(F.col("text").cast("string"))
    same = size == F.col("_mix_size")
    for name, kind in keys.items():
        same = same & F.col(name).cast(kind).eqNullSafe(F.col(f"_mix_{name}"))
    columns = docs.columns
    chosen = docs.join(shares, same).select(*columns, "_mix_passes", "_mix_pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            passes = np.asarray(part.column("_mix_passes"))
            pieces = part.column("_mix_pieces").to_pylist()
            rest = part.select(columns)
            yield rest.take(pa.array(np.repeat(np.arange(len(passes)), passes)))
            some = [i for i, p in enumerate(pieces) if p]
            if some:
                cut = rest.take(pa.array(some))
                new = [_cut(texts.raw(i), pieces[i]) for i in some]
                at = cut.schema.get_field_index("text")
                cut = cut.set_column(at, cut.schema.field(at), pa.array(new, cut.schema.field(at).type))
                if "n_chars" in columns:
                    at = cut.schema.get_field_index("n_chars")
                    cut = cut.set_column(at, cut.schema.field(at), pa.array([len(t) for t in new], cut.schema.field(at).type))
                yield cut

    return chosen.mapInArrow(run, docs.schema)
