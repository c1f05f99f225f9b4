"""Benchmark passages in documents by a prefix-filtered set join.

A benchmark item is cut into windows of ten words, a shorter one is one window.
A window is the set of its three-word shingles.  It stands in a document only
if all of them do, so one shingle is its necessary prefix: the rarest over all
documents.  Documents are joined with the windows on these prefix shingles
alone.  A candidate must have room for the words before and after the shingle,
and is verified word by word over the size of its window.

The documents are read twice, once to count shingles and once to find
prefixes.  Both times a bit map of fixed size tells which shingles can belong
to a window; the windows themselves are never collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlog.llm.text import Texts, Words, find_words, hash_spans, mix, pack, slices, windows
from driftlog.session import save_and_reload

WINDOW_WORDS = 10
SHINGLE = 3
MAP_BITS = 22
COUNTED = 1 << 20

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[:128] = True
_SEPARATORS[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = False


def _shingles(texts: Texts, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text and their first word."""
    hashes = hash_spans(texts.data, words.starts, words.ends)
    values, first = windows(hashes, words, size)
    return mix(values ^ np.uint64(size)), first


def _normal(texts: Texts, words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words with one space after each, and where each begins and ends."""
    sizes = words.ends - words.starts
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    inside = ~_SEPARATORS[texts.data]
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    place = np.ones(len(out), bool)
    place[ends] = False
    out[place] = texts.data[inside]
    return out.tobytes(), starts, ends


def _item_windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, window, words, shingles): the distinct windows of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            low = texts.lowered()
            words = find_words(low, _SEPARATORS)
            plain, starts, ends = _normal(low, words)
            counts = words.counts()
            hashes = {n: _shingles(low, words, n) for n in range(1, SHINGLE + 1)}
            ids = part.column(0).to_pylist()
            rows: list[tuple] = []
            for i in np.flatnonzero(counts).tolist():
                a, n = int(words.bounds[i]), int(counts[i])
                length = min(size, n)
                values, first = hashes[min(SHINGLE, length)]
                at = int(np.searchsorted(first, a))
                own = values[at : at + n - min(SHINGLE, length) + 1].view(np.int64).tolist()
                seen = set()
                for k in range(n - length + 1):
                    window = plain[starts[a + k] : ends[a + k + length - 1]].decode()
                    if window not in seen:
                        seen.add(window)
                        rows.append((ids[i], window, length, own[k : k + length - min(SHINGLE, length) + 1]))
                if len(rows) > 2_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["item_id", "window", "words", "shingles"]
        )

    return items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "item_id string, window string, words bigint, shingles array<bigint>"
    )


def _bit_map(shingles: DataFrame) -> Broadcast:
    """A map of the leading bits of some shingles, of fixed size."""
    cells = shingles.select(F.shiftrightunsigned("shingle", 64 - MAP_BITS).alias("cell")).distinct()
    bits = np.zeros(1 << MAP_BITS, bool)
    bits[cells.toArrow().column("cell").to_numpy()] = True
    return shingles.sparkSession.sparkContext.broadcast(np.packbits(bits))


def _listed(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    cell = (values >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    return np.flatnonzero(bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1)


def _count_shingles(docs: DataFrame, bits: Broadcast, sizes: list[int]) -> DataFrame:
    """(shingle, n) of listed shingles over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def add() -> None:
            nonlocal held, counts
            values = np.concatenate([held, *waiting])
            weights = np.concatenate((counts, np.ones(len(values) - len(held), np.int64)))
            held, which = np.unique(values, return_inverse=True)
            counts = np.bincount(which, weights, len(held)).astype(np.int64)
            waiting.clear()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(counts)], ["shingle", "n"])

        for _, texts in slices(batches):
            low = texts.lowered()
            words = find_words(low, _SEPARATORS)
            for size in sizes:
                values, _ = _shingles(low, words, size)
                waiting.append(values[_listed(bits.value, values)])
            if sum(map(len, waiting)) > COUNTED:
                add()
                if len(held) > COUNTED:
                    yield rows()
                    held, counts = held[:0], counts[:0]
        if waiting:
            add()
        if len(held):
            yield rows()

    return docs.mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))


_HITS = pa.list_(
    pa.struct([("pos", pa.int64()), ("shingle", pa.int64()), ("at", pa.int32()), ("context", pa.string())])
)


def _find_prefixes(docs: DataFrame, bits: Broadcast, sizes: list[int], size: int) -> DataFrame:
    """doc_id, n_words and hits of every row: the places of listed shingles,
    each with the words around it that a window of ``size`` words can cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            low = texts.lowered()
            words = find_words(low, _SEPARATORS)
            plain, starts, ends = _normal(low, words)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for length in sizes:
                values, first = _shingles(low, words, length)
                at = _listed(bits.value, values)
                found.append((first[at], values[at]))
            place = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
            value = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.uint64)
            order = np.argsort(place, kind="stable")
            place, value = place[order], value[order]
            owner = np.searchsorted(words.bounds, place, "right") - 1
            begin = words.bounds[owner]
            left = np.maximum(begin, place - size + 1)
            right = np.minimum(words.bounds[owner + 1], place + size)
            context = [plain[a:b].decode() for a, b in zip(starts[left].tolist(), ends[right - 1].tolist(), strict=True)]
            hits = pa.StructArray.from_arrays(
                [pa.array(place - begin), pa.array(value.view(np.int64)), pa.array((place - left).astype(np.int32)), pa.array(context, pa.string())],
                fields=list(_HITS.value_type),
            )
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)), hits)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.counts()), lists], ["doc_id", "n_words", "hits"])

    return docs.mapInArrow(
        run, "doc_id bigint, n_words bigint, hits array<struct<pos:bigint,shingle:bigint,at:int,context:string>>"
    )


def find_passages(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, doc_id, n_words) of every document row, (row, start, words, window)
    of every place where a window stands, and (window, item_id)."""
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    listed = save_and_reload(_item_windows(items, size), "windows")
    owners = listed.select("window", "item_id").distinct()
    distinct = listed.groupBy("window").agg(F.first("words").alias("words"), F.first("shingles").alias("shingles"))
    tokens = save_and_reload(distinct.select("window", "words", F.posexplode("shingles").alias("offset", "shingle")), "tokens")
    lengths = F.least("words", F.lit(SHINGLE)).cast("int")
    sizes = sorted(r.size for r in tokens.select(lengths.alias("size")).distinct().collect())
    counts = _count_shingles(named.select("text"), _bit_map(tokens), sizes)
    prefixes = (
        tokens.join(counts, "shingle", "left")
        .groupBy("window", "words")
        .agg(F.min(F.struct("n", "shingle", "offset")).alias("rarest"), F.count("n").alias("met"), F.count(F.lit(1)).alias("all"))
        # A window with a shingle that no document has stands nowhere.
        .filter("met = all")
        .select("window", "words", "rarest.shingle", "rarest.offset")
    )
    prefixes = save_and_reload(prefixes, "prefixes")
    rows = _find_prefixes(named, _bit_map(prefixes), sizes, size)
    rows = save_and_reload(rows.withColumn("row", F.monotonically_increasing_id()), "prefix-places")
    candidates = rows.select("row", "n_words", F.explode("hits").alias("hit")).select("row", "n_words", "hit.*")
    start = F.col("at") - F.col("offset")
    passage = F.expr("array_join(slice(split(context, ' '), at - offset + 1, cast(words as int)), ' ')")
    places = (
        candidates.join(prefixes, "shingle")
        .filter((start >= 0) & (F.col("pos") - F.col("offset") + F.col("words") <= F.col("n_words")))
        .filter(passage == F.col("window"))
        .select("row", (F.col("pos") - F.col("offset")).alias("start"), "words", "window")
    )
    return rows.select("row", "doc_id", "n_words"), save_and_reload(places, "places"), owners


def contaminated_documents(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, one row
    per row of ``docs``.

    Words are runs of ASCII letters, digits and all non-ASCII characters, after
    lower-casing A-Z; a word inside any place of a window counts once in n_hit.
    NULL and empty texts and items have no words and no windows.  Rows of
    ``items`` with one item_id are one item; words of a row without item_id
    count as hit, but it is no item to name.  Repeated documents get equal
    rows; other columns are ignored.  Very long texts are searched whole.  An
    empty table of documents gives an empty result, without items nothing is hit.
    """
    rows, places, owners = find_passages(docs, items, size)
    # Windows of one document, in order: what none before has covered.
    end = F.col("start") + F.col("words")
    before = Window.partitionBy("row").orderBy("start", "words").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
    spans = places.select("row", "start", "words").distinct()
    covered = spans.select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    named = places.select("row", "window").distinct().join(owners.filter("item_id is not null"), "window").select("row", "item_id")
    found = named.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return (
        rows.join(covered.join(found, "row", "left"), "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )
