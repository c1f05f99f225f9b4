"""Near-duplicate documents by one-permutation MinHash.

A text's shingle hashes are cut into bins by their leading bits; each bin keeps
its least hash, and empty bins borrow from a full one by a fixed random probe
sequence (optimal densification).  Six bins make a band.  Texts that agree in a
band form a bucket, and a bucket only proposes the edges of a star: its hub
with each member.  Every proposed edge is confirmed on the full shingle sets.

A star alone could hide a link between two members that are both unlike the
hub, so buckets that still hold several components choose another hub and are
tried again while that finds links.  Bands only find links soon; what they miss
is finished exactly: a pair at the threshold shares one of the rarest shingles
of both texts, so all texts, in a bucket or not, are joined by these across
components and confirmed like the rest.
Texts with the same shingle set are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlog.llm.components import connected_components
from driftlog.llm.reduce import sum_vectors
from driftlog.llm.text import mix, pack, shingle_sets, slices
from driftlog.session import save_and_reload

BANDS = 32
ROWS = 6
THRESHOLD = 85
RARITY_BITS = 20
BATCH_BYTES = 16 << 20


def signatures(values: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signatures of sorted sets; all sets must be non-empty."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    cell = owner * bins + ((values >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    # Bins follow the order of the hashes, so the first of a bin is its least.
    first = np.concatenate(([True], cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, bool)
    out = np.zeros((len(bounds) - 1) * bins, np.uint64)
    full = np.zeros(len(out), bool)
    out[cell[first]] = values[first]
    full[cell[first]] = True
    empty = np.flatnonzero(~full)
    attempt = 0
    while len(empty):
        attempt += 1
        place = empty % bins
        probe = (mix(place.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(attempt << 32)) % np.uint64(bins)).astype(np.int64)
        lender = empty - place + probe
        found = full[lender]
        out[empty[found]] = out[lender[found]]
        empty = empty[~found]
    return out.reshape(-1, bins)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per text and band; bands do not share keys."""
    parts = mix(signature.reshape(-1, bands, rows))
    weights = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    salt = mix(np.arange(bands, dtype=np.uint64) + np.uint64(7_777))
    return mix((parts * weights).sum(axis=2, dtype=np.uint64) + salt)


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set, and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            values, bounds = shingle_sets(texts)
            sizes = np.diff(bounds)
            some = np.flatnonzero(sizes)
            keys = np.zeros((len(sizes), bands), np.uint64)
            if len(some):
                packed = np.concatenate(([0], np.cumsum(sizes[some])))
                keys[some] = band_keys(signatures(values, packed, bands * rows), bands, rows)
            prints = []
            for salt in (0x51ED, 0xC0DE):
                sums = np.zeros(len(values) + 1, np.uint64)
                np.cumsum(mix(values ^ mix(np.array([salt], np.uint64))), out=sums[1:])
                prints.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * bands),
                pa.array(keys.reshape(-1).view(np.int64)),
            )
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes), pa.array(prints[0]), pa.array(prints[1]), lists],
                ["doc_id", "n", "f1", "f2", "bands"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>"
    )


def _confirm(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for outer, _ in slices(batches, "text_u"):
            for part, right in slices(iter([outer]), "text_v"):
                a, at_a = shingle_sets(pack(part.column("text_u")))
                b, at_b = shingle_sets(right)
                linked = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    x, y = a[at_a[i] : at_a[i + 1]], b[at_b[i] : at_b[i + 1]]
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    linked[i] = shared and 100 * shared >= threshold * (len(x) + len(y) - shared)
                yield part.select(["u", "v"]).filter(pa.array(linked))

    right = texts.select(F.col("id").alias("v"), F.col("text").alias("text_v"))
    left = texts.select(F.col("id").alias("u"), F.col("text").alias("text_u"))
    return pairs.join(right, "v").join(left, "u").select("u", "v", "text_u", "text_v").mapInArrow(
        run, "u bigint, v bigint"
    )


def _open_pairs(nodes: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """All pairs (u, v) of different components that can reach the threshold.

    ``nodes`` holds id and component of every row of ``texts``.  Shingles are
    ordered by rarity, as far as a table of 2 to the ``RARITY_BITS`` counters
    tells; any order gives the same links.  Only a text's prefix is joined: its
    rarest shingles, as many as could be missing in a similar text, and one
    more.  Common places are left out from where the two orders leave too little
    in common, and pairs whose places before that are so few that what follows
    cannot make up for it.
    """

    def cells(values: np.ndarray) -> np.ndarray:
        return (values >> np.uint64(64 - RARITY_BITS)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(1 << RARITY_BITS)
        for _, part in slices(batches):
            total += np.bincount(cells(shingle_sets(part)[0]), minlength=len(total))
        return total

    counts = sum_vectors(texts.select("text"), count, 1 << RARITY_BITS)
    rarity = texts.sparkSession.sparkContext.broadcast(counts.astype(np.int32))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in slices(batches):
            values, bounds = shingle_sets(own)
            sizes = np.diff(bounds)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((values, rarity.value[cells(values)], owner))
            place = np.arange(len(values)) - bounds[owner]
            kept = np.flatnonzero(100 * (sizes[owner] - place) >= threshold * sizes[owner])
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(owner[kept], np.arange(len(sizes) + 1)).astype(np.int32)),
                pa.array(values[order][kept].view(np.int64)),
            )
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), lists], ["id", "n", "prefix"])

    # A text's prefix stays one row until its component is known.
    tokens = (
        texts.select("id", "text").mapInArrow(prefixes, "id bigint, n bigint, prefix array<bigint>")
        .join(nodes, "id")
        .select("id", "n", "component", F.posexplode("prefix").alias("place", "shingle"))
    )
    own = Window.partitionBy("shingle")
    tokens = (
        tokens.select("*", F.min("component").over(own).alias("low"), F.max("component").over(own).alias("high"))
        .filter("low < high")
        .drop("low", "high")
    )
    tokens = save_and_reload(tokens, "prefixes")
    left = tokens.select("shingle", *[F.col(c).alias(f"{c}_u") for c in ("id", "n", "place", "component")])
    right = tokens.select("shingle", *[F.col(c).alias(f"{c}_v") for c in ("id", "n", "place", "component")])
    needed = threshold * (F.col("n_u") + F.col("n_v"))
    left_over = F.least(F.col("n_u") - F.col("place_u"), F.col("n_v") - F.col("place_v"))
    return (
        left.join(right, "shingle")
        .filter("id_u < id_v and component_u != component_v")
        # No less than needed can be common from a pair's first common place on.
        .filter(left_over * (100 + threshold) >= needed)
        .groupBy(F.col("id_u").alias("u"), F.col("id_v").alias("v"))
        .agg(
            F.count(F.lit(1)).alias("shared"), F.min(left_over).alias("from_last"),
            F.max("n_u").alias("n_u"), F.max("n_v").alias("n_v"),
        )
        # The common places left are the pair's first; all others come after.
        .filter((F.col("shared") - 1 + F.col("from_last")) * (100 + threshold) >= needed)
        .select("u", "v")
    )


def near_duplicates(
    docs: DataFrame, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Texts are linked at ``100 * |A and B| >= threshold * |A or B|`` of their
    distinct five-word shingles, lower-cased in A-Z.  ``component_id`` is the
    least doc_id reachable, and the document with that id is kept.

    Empty, NULL and word-free texts have no shingle, stay alone and are kept.
    A row without doc_id cannot be named: it links nothing, has no component
    and is kept.  Rows repeating a doc_id are one document; if their texts
    differ, links are confirmed on the least text.  Other columns are ignored.
    An empty table gives an empty result.
    """
    # Pairs of very long texts would make very large Arrow batches.
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    drawn = save_and_reload(sketch(docs, bands, rows), "sketches")
    linked = drawn.filter("doc_id is not null and n > 0")
    prints = ["n", "f1", "f2"]
    sets = save_and_reload(linked.groupBy(*prints).agg(F.min("doc_id").alias("rep")), "sets")
    members = (
        linked.join(sets.select(*prints, F.col("rep").alias("doc_id")), [*prints, "doc_id"], "left_semi")
        .select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket"))
    )
    hubs = (
        members.groupBy("bucket")
        .agg(F.min("id").alias("hub"), F.max("id").alias("other"))
        .filter("hub < other")
        .select("bucket", "hub")
    )
    shared = save_and_reload(members.join(hubs, "bucket"), "buckets")
    nodes = shared.select("id").distinct()
    named = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    reps = sets.select(F.col("rep").alias("id")).distinct()
    every = save_and_reload(
        named.join(reps, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "every-text"
    )
    texts = save_and_reload(every.join(nodes, "id", "left_semi"), "texts")

    pairs = shared.filter("hub < id").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct()
    tried = save_and_reload(pairs, "pairs")
    found = save_and_reload(_confirm(tried, texts, threshold), "found")
    groups = save_and_reload(connected_components(found), "groups")
    turn = 0
    while True:
        turn += 1
        # Buckets that still hold more than one component get another hub.
        placed = shared.select("bucket", "id").join(groups, "id", "left").select(
            "bucket", "id", F.coalesce("component", "id").alias("component")
        )
        order = F.struct(F.xxhash64("id", "bucket", F.lit(turn)), "id", "component")
        open_hubs = (
            placed.groupBy("bucket")
            .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(order).alias("hub"))
            .filter("low < high")
            .select("bucket", F.col("hub.id").alias("hub"), F.col("hub.component").alias("hub_component"))
        )
        # A bucket that is one component stays so; later rounds skip it.
        still_open = save_and_reload(placed.join(open_hubs, "bucket"), "open")
        shared = still_open.select("bucket", "id")
        pairs = (
            still_open.filter("component != hub_component")
            .select(F.least("hub", "id").alias("u"), F.greatest("hub", "id").alias("v"))
            .distinct()
            .join(tried, ["u", "v"], "left_anti")
        )
        fresh = save_and_reload(pairs, "pairs")
        links = save_and_reload(_confirm(fresh, texts, threshold), "found")
        if links.isEmpty():
            break
        tried = tried.union(fresh)
        groups = save_and_reload(connected_components(groups.union(links)), "groups")
    # Texts that share no band, or only with others, can still be similar.
    placed = save_and_reload(
        reps.join(groups, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "placed"
    )
    tried = tried.union(fresh)
    last = save_and_reload(_open_pairs(placed, every, threshold).join(tried, ["u", "v"], "left_anti"), "pairs")
    links = save_and_reload(_confirm(last, every, threshold), "found")
    if not links.isEmpty():
        groups = save_and_reload(connected_components(groups.union(links)), "groups")

    labels = sets.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select(
        *prints, F.coalesce("component", "rep").alias("component_id")
    )
    # Rows without a set or an id stay out of the join, so they make no hot key.
    named_rows = linked.select("doc_id", *prints).join(labels, prints).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id"
    )
    alone = drawn.filter("doc_id is null or n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    return named_rows.union(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group, all columns unchanged.

    Rows without doc_id stay.  Repeated rows of a kept document stay.
    """
    gone = near_duplicates(docs, threshold).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
