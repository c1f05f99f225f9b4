"""Prefix tree of conversations by burst tries.

A conversation is a sequence of turn ids, digests of role and text.  Suffixes
stand in containers, each under the trie head that is their common prefix; the
first container is that of the root.  A container that grows over ``BURST``
turns bursts: the part its suffixes have in common becomes a path of nodes, and
the next turn id deals the suffixes to new containers.  The remaining
containers are small; each is sorted and swept into nodes by one task, many
containers to a task.  Long conversations are cut every ``SEGMENT`` turns, and
a segment hangs under the head that all turns before it lead to, so no row
holds more than ``SEGMENT`` turns.

Equal suffixes of a container are one row from the start.  What lies below a
container is added up along the containers' heads by pointer doubling.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlog.llm.ranks import number_rows
from driftlog.session import save_and_reload

BURST = 16_384
SEGMENT = 1_024
SHARED_EVERY = 20
MOST_SHARED = 3
MEMBER_BITS = 10
ROOT = "root"
EMPTY = hashlib.sha256(b"").hexdigest()


def _digest(column: Column) -> Column:
    """128 bits of SHA-256 as 32 hexadecimal digits."""
    return F.substring(F.sha2(column, 256), 1, 32)


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, id, words) of the rebuilt conversations and (conv_id, n),
    their lengths.

    Turns are ordered by turn, NULL first, then by role and text; NULL role or
    text is empty; rows without conv_id belong to no conversation.  A
    conversation starts with the first h turns of the one whose id is the next
    multiple of ``SHARED_EVERY`` towards zero, then follow its own turns after
    its first h; h is the CRC-32 of its decimal id modulo ``MOST_SHARED`` + 1.
    """
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id is not null")
    numbered = number_rows(turns, ["conv_id"], ["turn", "role", "text"]).select(
        "conv_id",
        "pos",
        F.unhex(_digest(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("id"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    )
    numbered = save_and_reload(numbered, "turns")
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_SHARED + 1)).cast("bigint")
    source = F.col("conv_id") - F.col("conv_id") % SHARED_EVERY
    sizes = save_and_reload(numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")), "sizes")
    sources = sizes.filter(F.col("conv_id") % SHARED_EVERY == 0)
    taken = (
        sizes.select("conv_id", "own", shared.alias("h"), source.alias("source"))
        .join(sources.select(F.col("conv_id").alias("source"), F.col("own").alias("there")), "source", "left")
        .withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    )
    taken = save_and_reload(taken, "taken")
    first = numbered.filter((F.col("conv_id") % SHARED_EVERY == 0) & (F.col("pos") < MOST_SHARED)).withColumnRenamed(
        "conv_id", "source"
    )
    lent = taken.select("conv_id", "source", "taken").join(first, "source").filter("pos < taken")
    kept = numbered.withColumn("h", shared).filter("pos >= h")
    own = kept.join(taken.select("conv_id", "taken"), "conv_id").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "pos", "id", "words"]
    lengths = taken.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    return lent.select(*columns).union(own.select(*columns)), lengths


def _segments(turns: DataFrame, lengths: DataFrame, segment: int) -> DataFrame:
    """(conv_id, key, top, ids, w, digest, child): one row per conversation and
    segment; ``key`` names the container, ``top`` is its head's depth, and
    ``child`` is the container that a full segment leads to.  The last segment
    of a conversation is never full, so it may be empty."""
    block = F.floor(F.col("pos") / segment).cast("bigint")
    order = F.sort_array(F.collect_list(F.struct("pos", "id", "words")))
    full = turns.groupBy("conv_id", block.alias("block")).agg(order.alias("turns"))
    full = full.select("conv_id", "block", F.col("turns.id").alias("ids"), F.col("turns.words").alias("w"))
    empty = lengths.filter(F.col("n") % segment == 0).select(
        "conv_id",
        F.floor(F.col("n") / segment).cast("bigint").alias("block"),
        F.array().cast("array<binary>").alias("ids"),
        F.array().cast("array<bigint>").alias("w"),
    )
    spelled = F.array_join(F.transform("ids", lambda x: F.hex(x)), "")
    cut = full.union(empty).withColumn("digest", _digest(F.concat_ws(":", F.col("block").cast("string"), spelled)))
    longest = lengths.agg(F.max("n")).first()[0] or 0
    if longest < segment:
        return cut.select(
            "conv_id", F.lit(ROOT).alias("key"), F.lit(0).cast("bigint").alias("top"), "ids", "w", "digest",
            F.lit(None).cast("string").alias("child"),
        )
    # Sums of two 60-bit numbers per segment name what lies before the next;
    # one short row per segment is ordered for each conversation.
    cut = save_and_reload(cut, "segments")
    upto = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = [F.conv(F.substring("digest", at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 17)]
    sums = cut.select(
        "conv_id", "block", *[F.sum(p).over(upto).cast("string").alias(f"s{i}") for i, p in enumerate(parts)]
    ).select(
        "conv_id", (F.col("block") + 1).alias("block"),
        _digest(F.concat_ws(":", (F.col("block") + 1).cast("string"), "s0", "s1")).alias("name"),
    )
    before = sums.withColumnRenamed("name", "key")
    after = sums.select("conv_id", (F.col("block") - 1).alias("block"), F.col("name").alias("child"))
    return (
        cut.join(before, ["conv_id", "block"], "left")
        .join(after, ["conv_id", "block"], "left")
        .select(
            "conv_id",
            F.coalesce("key", F.lit(ROOT)).alias("key"),
            (F.col("block") * segment).alias("top"),
            "ids", "w", "digest",
            F.when(F.size("ids") == segment, F.col("child")).alias("child"),
        )
    )


def _end_hashes(segments: DataFrame) -> DataFrame:
    """(key, digest, ends): the hash of the ids of the conversations that end
    with each suffix.  Ids are joined in runs of 2 to the ``MEMBER_BITS``; a
    hash then only has to read its runs in order."""
    runs = (
        segments.filter("child is null")
        .groupBy("key", "digest", F.shiftright("conv_id", MEMBER_BITS).alias("run"))
        .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
        .select("key", "digest", "run", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done = []
            for key, suffix, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (key, suffix) == name:
                    state.update(b"," + ids.encode())
                    continue
                if name:
                    done.append((*name, state.hexdigest()))
                name, state = (key, suffix), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], ["key", "digest", "ends"])
        if name:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.string()) for c in (*name, state.hexdigest())], ["key", "digest", "ends"])

    ordered = runs.repartition("key", "digest").sortWithinPartitions("key", "digest", "run")
    return ordered.mapInArrow(digest, "key string, digest string, ends string")


# ------------------------------------------------------------------- sweeping

_NODE = (
    "key string, top bigint, depth bigint, low bigint, parent_low bigint, n bigint, children bigint, leaves bigint, "
    "saved bigint, ends string, child string"
)
_NODE_TYPES = pa.schema(
    [(c.split(" ")[0], pa.string() if c.endswith("string") else pa.int64()) for c in _NODE.split(", ")]
)


class _Node:
    __slots__ = ("words", "n", "low", "children", "leaves", "saved", "ends", "child", "kids")

    def __init__(self, words: int):
        self.words, self.n, self.low = words, 0, None
        self.children = self.leaves = self.saved = 0
        self.ends = self.child = None
        self.kids: list[list] = []


class _Sweep:
    """Nodes of containers whose suffixes come sorted."""

    def __init__(self) -> None:
        self.key: str | None = None
        self.top = 0
        self.path: list[bytes] = []
        self.stack: list[_Node] = []
        self.out: list[list] = []

    def _close(self) -> None:
        """Finish the deepest node; its own row waits for its parent's id."""
        node = self.stack.pop()
        if not node.children and node.child is None:
            node.leaves = 1
        node.saved += (node.n - 1) * node.words
        for kid in node.kids:
            kid[4] = node.low
        self.out += node.kids
        row = [self.key, self.top, len(self.stack), node.low, None, node.n, node.children, node.leaves, node.saved, node.ends, node.child]
        if self.stack:
            above = self.stack[-1]
            above.n += node.n
            above.low = node.low if above.low is None else min(above.low, node.low)
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved
            above.kids.append(row)
            self.path.pop()
        else:
            self.out.append(row)

    def finish(self) -> None:
        while self.stack:
            self._close()

    def add(self, row: dict) -> None:
        if row["key"] != self.key:
            self.finish()
            self.key, self.top, self.stack = row["key"], row["top"], [_Node(0)]
        ids, same = row["ids"], 0
        for a, b in zip(self.path, ids, strict=False):
            if a != b:
                break
            same += 1
        while len(self.path) > same:
            self._close()
        for i in range(same, len(ids)):
            self.path.append(ids[i])
            self.stack.append(_Node(row["w"][i]))
        node = self.stack[-1]
        node.n += row["n"]
        node.low = row["low"] if node.low is None else min(node.low, row["low"])
        node.ends = row["ends"] or node.ends
        if row["child"] is not None:
            # What hangs below, once it is known.
            node.child, node.ends = row["child"], row["far_ends"]
            node.children += row["far_children"] or 0
            node.leaves += row["far_leaves"] or 0
            node.saved += row["far_saved"] or 0


def _swept(rows: DataFrame) -> DataFrame:
    """The nodes of all containers, their heads at depth 0 included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = _Sweep()

        def flush() -> pa.RecordBatch:
            done, sweep.out = sweep.out, []
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done, strict=True), _NODE_TYPES.types, strict=True)], schema=_NODE_TYPES
            )

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    sweep.add(row)
                if len(sweep.out) >= 4_096:
                    yield flush()
        sweep.finish()
        if sweep.out:
            yield flush()

    for name, kind in (("far_children", "bigint"), ("far_leaves", "bigint"), ("far_saved", "bigint"), ("far_ends", "string")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    ordered = rows.repartition("key").sortWithinPartitions("key", "ids")
    return ordered.mapInArrow(run, _NODE)


# ------------------------------------------------------------------- bursting


def _burst(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Containers that stay, paths of those that burst, and the new containers."""
    weight = F.sum(F.size("ids") + 1)
    large = save_and_reload(
        rows.groupBy("key").agg(weight.alias("weight")).filter(F.col("weight") > limit).select("key"), "large"
    )
    if large.isEmpty():
        return rows, None, None
    stay = save_and_reload(rows.join(large, "key", "left_anti"), "containers")
    opened = save_and_reload(rows.join(large, "key", "left_semi"), "opened")
    least, most = F.col("least.ids"), F.col("most")
    split = F.array_position(F.zip_with(least, most, lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int")
    paths = (
        opened.groupBy("key")
        .agg(
            F.first("top").alias("top"), F.sum("n").alias("n"), F.min("low").alias("low"),
            F.min(F.struct("ids", "w", "ends")).alias("least"), F.max("ids").alias("most"),
        )
        .withColumn("common", F.when(split == 0, F.size(least)).otherwise(split - 1))
        .select(
            "key", "top", "n", "low", "common",
            F.slice("least.w", F.lit(1), F.col("common")).alias("path"),
            F.when(F.size(least) == F.col("common"), F.col("least.ends")).alias("ends"),
        )
    )
    paths = save_and_reload(paths, "paths")
    turn = F.element_at("ids", F.col("common") + 1)
    moved = (
        opened.join(paths.select("key", "common"), "key")
        .filter(F.size("ids") > F.col("common"))
        .select(
            _digest(F.concat_ws(":", "key", F.col("common").cast("string"), F.hex(turn))).alias("key"),
            (F.col("top") + F.col("common") + 1).alias("top"),
            F.expr("slice(ids, common + 2, greatest(size(ids) - common - 1, 0))").alias("ids"),
            F.expr("slice(w, common + 2, greatest(size(w) - common - 1, 0))").alias("w"),
            "n", "low", "ends", "child",
            F.col("key").alias("above"),
            F.element_at("w", F.col("common") + 1).alias("head_words"),
        )
    )
    return stay, paths, save_and_reload(moved, "moved")


def _subtree_sums(heads: DataFrame) -> DataFrame:
    """(key, leaves, saved) summed over each container and all below it, from
    (key, above, leaves, saved): after k rounds, sums reach 2^k levels."""
    now = save_and_reload(heads, "sums")
    while not now.filter("above is not null").isEmpty():
        added = now.filter("above is not null").groupBy(F.col("above").alias("key")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        further = now.filter("above is not null").select(F.col("key").alias("above"), F.col("above").alias("further"))
        now = save_and_reload(
            now.join(added, "key", "left")
            .join(further, "above", "left")
            .select(
                "key",
                F.col("further").alias("above"),
                (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            ),
            "sums",
        )
    return now.select("key", "leaves", "saved")


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def prefix_trie(conversations: DataFrame, burst: int = BURST, segment: int = SEGMENT) -> DataFrame:
    """One row per node of the prefix tree of the rebuilt conversations.

    conv_id, the smallest member; depth; parent_conv_id; n_convs, the members;
    n_children; n_leaves, the childless nodes of the subtree; saved_tokens, the
    words of last turns that need not be stored again, over the subtree;
    ends_sha256, the hash of the ids of the members that end here.

    Rows without conv_id are ignored, NULL role or text is empty, and turns
    with equal numbers are ordered by role and text; repeated rows are turns of
    their own.  A conversation may come out without turns; it is a member of
    the root alone.  An empty table has no root and gives an empty result.
    Other columns are ignored.  ``burst`` must be over ``segment`` + 1.
    """
    if burst <= segment + 1:
        raise ValueError("a container must hold more than one full segment")
    turns, lengths = rebuilt_turns(conversations)
    lengths = save_and_reload(lengths, "lengths")
    segments = save_and_reload(_segments(turns, lengths, segment), "suffixes")
    rows = (
        segments.groupBy("key", "top", "digest", "child")
        .agg(F.first("ids").alias("ids"), F.first("w").alias("w"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"))
        .join(_end_hashes(segments), ["key", "digest"], "left")
        .select("key", "top", "ids", "w", "n", "low", "ends", "child")
    )
    rows = save_and_reload(rows, "containers")

    contained, paths, dealt = [], [], []
    while True:
        stay, path, moved = _burst(rows, burst)
        contained.append(stay.select("key", "top", "ids", "w", "n", "low", "ends", "child"))
        if path is None:
            break
        paths.append(path)
        dealt.append(moved.select("key", "above", "head_words").distinct())
        rows = moved
    small = _union(contained)
    nodes = save_and_reload(_swept(small), "nodes")
    linked = nodes.filter("child is not null")
    if not paths and linked.isEmpty():
        return _report([_below(nodes), _root(nodes)])

    # One row per container: its head's numbers without what hangs below.
    swept_heads = nodes.filter("depth = 0").select("key", "top", "low", "n", "children", "ends", "child", "leaves", "saved")
    links = linked.select(F.col("child").alias("key"), F.col("key").alias("above")).distinct()
    heads = swept_heads
    if paths:
        burst_heads = _union(paths)
        fresh = save_and_reload(_union(dealt), "dealt")
        owned = swept_heads.select("key", "n").union(burst_heads.select("key", "n"))
        below = (
            fresh.join(owned, "key")
            .groupBy(F.col("above").alias("key"))
            .agg(F.count(F.lit(1)).alias("fan"), F.sum((F.col("n") - 1) * F.col("head_words")).alias("head_saved"))
        )
        on_path = (F.col("n") - 1) * F.aggregate("path", F.lit(0).cast("bigint"), lambda a, x: a + x)
        burst_heads = save_and_reload(burst_heads.join(below, "key"), "bursts")
        heads = swept_heads.union(
            burst_heads.select(
                "key", "top", "low", "n",
                F.when(F.col("common") > 0, F.lit(1)).otherwise(F.col("fan")).alias("children"),
                F.when(F.col("common") == 0, F.col("ends")).alias("ends"),
                F.lit(None).cast("string").alias("child"),
                F.lit(0).alias("leaves"),
                (on_path + F.col("head_saved")).alias("saved"),
            )
        )
        links = links.union(fresh.select("key", "above"))
    heads = save_and_reload(heads, "heads")
    sums = _subtree_sums(heads.join(links, "key", "left").select("key", "above", "leaves", "saved"))
    # A head that only leads on to a segment takes that container's children.
    further = heads.select(F.col("key").alias("child"), F.col("children").alias("their_children"), F.col("ends").alias("their_ends"))
    whole = (
        heads.drop("leaves", "saved")
        .join(further, "child", "left")
        .join(sums, "key")
        .select(
            "key", "top", "low", "n", "leaves", "saved",
            F.coalesce("their_children", "children").alias("children"),
            F.coalesce("their_ends", "ends").alias("ends"),
        )
    )
    whole = save_and_reload(whole, "whole")
    parts = [_root(whole)]
    open_keys = linked.select("key").distinct()
    parts.append(_below(nodes.join(open_keys, "key", "left_anti")))
    far = whole.select(
        F.col("key").alias("child"), F.col("children").alias("far_children"), F.col("leaves").alias("far_leaves"),
        F.col("saved").alias("far_saved"), F.col("ends").alias("far_ends"),
    )
    parts.append(_below(_swept(small.join(open_keys, "key", "left_semi").join(far, "child", "left"))))
    if paths:
        sums_of_path = burst_heads.filter("common > 0").join(sums, "key").select(
            "top", "low", "n", "common", "fan", "ends", "leaves", "saved", F.posexplode("path").alias("i", "words"),
            F.col("path").alias("whole_path"),
        )
        earlier = F.expr("aggregate(slice(whole_path, 1, i), 0L, (a, x) -> a + x)")
        last = F.col("i") == F.col("common") - 1
        parts.append(
            sums_of_path.select(
                "low", (F.col("top") + F.col("i") + 1).alias("depth"), F.col("low").alias("parent_low"), "n",
                F.when(last, F.col("fan")).otherwise(F.lit(1)).alias("children"), "leaves",
                (F.col("saved") - (F.col("n") - 1) * earlier).alias("saved"), F.when(last, F.col("ends")).alias("ends"),
            )
        )
        lows = burst_heads.select(F.col("key").alias("above"), F.col("low").alias("parent_low"))
        parts.append(
            whole.join(fresh, "key").join(lows, "above").select(
                "low", F.col("top").alias("depth"), "parent_low", "n", "children", "leaves",
                (F.col("saved") + (F.col("n") - 1) * F.col("head_words")).alias("saved"), "ends",
            )
        )
    return _report(parts)


_PARTS = ["low", "depth", "parent_low", "n", "children", "leaves", "saved", "ends"]


def _below(nodes: DataFrame) -> DataFrame:
    return nodes.filter("depth > 0").withColumn("depth", F.col("top") + F.col("depth")).select(*_PARTS)


def _root(heads: DataFrame) -> DataFrame:
    root = heads.filter((F.col("key") == ROOT) & (F.col("top") == 0))
    if "depth" in heads.columns:
        root = root.filter("depth = 0")
    return root.select(
        "low", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_low"),
        "n", "children", "leaves", "saved", "ends",
    )


def _report(parts: list[DataFrame]) -> DataFrame:
    return _union(parts).select(
        F.col("low").alias("conv_id"),
        F.col("depth").cast("bigint").alias("depth"),
        F.col("parent_low").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").cast("bigint").alias("n_children"),
        F.col("leaves").cast("bigint").alias("n_leaves"),
        F.col("saved").cast("bigint").alias("saved_tokens"),
        F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )
