"""Merkle manifest of a dataset as postorder append logs.

Leaves are digests of rows, in order within their language.  Aligned builders
take runs of ``2 ** BITS`` consecutive leaves and append every node to their
part of the log the moment it is complete: a leaf, then the parents that it
completes.  The tops of one floor's builders are the leaves of the next floor,
until each language has one node; the languages' nodes are the leaves of a last
tree with the root.

In such a log leaf j stands at ``2 j - popcount(j)``, since each node before it
closed a subtree of known size; a node of level l over leaves up to j stands l
places after leaf j.  So the siblings of a proof are read at computed places,
and nothing is searched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlog.llm.ranks import number_rows
from driftlog.session import save_and_reload

BITS = 9
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 7
_SIZE = 32


def combine(digests: list[bytes]) -> bytes:
    """The digest of digests in hexadecimal, joined."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def leaf_place(j: np.ndarray | int) -> np.ndarray:
    """Where leaf ``j`` stands in a postorder log of pairs."""
    j = np.asarray(j, np.int64)
    return 2 * j - np.bitwise_count(j)


def node_place(level: int, index: np.ndarray | int, leaves: int) -> np.ndarray:
    """Where a node stands in the log of ``leaves`` leaves."""
    last = np.minimum((np.asarray(index, np.int64) + 1) << level, leaves) - 1
    return leaf_place(last) + level


def build_log(leaves: list[bytes], height: int) -> bytes:
    """All nodes up to level ``height`` in completion order.  The last node of
    a level may have one child; it is complete with the last leaf."""
    log: list[bytes] = []
    waiting: list[list[bytes]] = [[] for _ in range(height + 1)]
    for j, leaf in enumerate(leaves):
        node, final = leaf, j == len(leaves) - 1
        log.append(node)
        for level in range(height):
            waiting[level].append(node)
            if len(waiting[level]) < 2 and not final:
                break
            node = combine(waiting[level])
            waiting[level] = []
            log.append(node)
    return b"".join(log)


def siblings(log: bytes, leaves: int, height: int) -> list[list[bytes]]:
    """For each leaf its sibling on each level: b"L" or b"R" for its side and
    the digest, or nothing where the run has one node."""
    out: list[list[bytes]] = [[] for _ in range(leaves)]
    for level in range(height):
        index = np.arange(leaves) >> level
        other = index ^ 1
        there = other < -(-leaves >> level)
        places = node_place(level, np.where(there, other, 0), leaves).tolist()
        for j, (place, right, some) in enumerate(zip(places, (other > index).tolist(), there.tolist(), strict=True)):
            at = place * _SIZE
            out[j].append((b"R" if right else b"L") + log[at : at + _SIZE] if some else b"")
    return out


def fold(leaf: bytes, path: list[bytes]) -> bytes:
    """The top that a leaf and its siblings lead to."""
    for sibling in path:
        if not sibling:
            leaf = combine([leaf])
        elif sibling[:1] == b"L":
            leaf = combine([sibling[1:], leaf])
        else:
            leaf = combine([leaf, sibling[1:]])
    return leaf


class Manifest(NamedTuple):
    """leaves: tree, doc_id, leaf, changed, pos; floors: the logs of the
    languages, and of the root's tree over them; tops: tree, top, pos."""

    leaves: DataFrame
    floors: list[DataFrame]
    tops: DataFrame
    root_floors: list[DataFrame]
    root: bytes | None


_LOG = "tree string, chunk bigint, leaves bigint, height int, nodes binary"


def _build_floors(leaves: DataFrame, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """The logs of all floors and the (tree, top) of every tree, from
    (tree, pos, leaf)."""
    width = 1 << bits

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("pos").to_numpy(), kind="stable")
        own = table.column("leaf").take(pa.array(order)).to_pylist()
        # A first run that is not full is its tree's only one.
        height = bits if key[1].as_py() or len(own) == width else (len(own) - 1).bit_length()
        return pa.table(
            {
                "tree": pa.array([key[0].as_py()], pa.string()), "chunk": pa.array([key[1].as_py()], pa.int64()),
                "leaves": pa.array([len(own)], pa.int64()), "height": pa.array([height], pa.int32()),
                "nodes": pa.array([build_log(own, height)], pa.binary()),
            }
        )

    top = F.expr(f"substring(nodes, length(nodes) - {_SIZE - 1}, {_SIZE})")
    floors, tops = [], []
    while True:
        chunk = F.floor(F.col("pos") / width).cast("bigint").alias("chunk")
        runs = leaves.select("tree", "pos", "leaf", chunk).groupBy("tree", "chunk")
        log = save_and_reload(runs.applyInArrow(build, _LOG), "merkle-log")
        floors.append(log)
        open_trees = log.filter("chunk > 0").select("tree").distinct()
        if open_trees.isEmpty():
            tops.append(log.select("tree", top.alias("top")))
            break
        tops.append(log.join(open_trees, "tree", "left_anti").select("tree", top.alias("top")))
        leaves = log.join(open_trees, "tree", "left_semi").select("tree", F.col("chunk").alias("pos"), top.alias("leaf"))
    whole = tops[0]
    for more in tops[1:]:
        whole = whole.union(more)
    return floors, whole


def _field(name: str | Column) -> Column:
    value = F.col(name).cast("string") if isinstance(name, str) else name.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def build_manifest(docs: DataFrame, bits: int = BITS) -> Manifest:
    """Logs of the trees of all rows of ``docs``, written to the shared folder.

    Per language the leaves ascend by doc_id, NULL first, then by digest; so
    repeated ids and repeated rows are leaves of their own in a defined order.
    ``changed`` is the leaf of the tampered row where the CRC-32 of the decimal
    doc_id is divisible by ``TAMPER_EVERY`` and n_chars is not NULL, else NULL.
    An empty table has no root.
    """
    lang = F.col("lang").cast("string")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    other = F.concat(*[_field(F.col(c) + 1 if c == "n_chars" else c) for c in FIELDS])
    rows = docs.select(
        # Languages by name, the missing one before all others.
        F.when(lang.isNull(), "").otherwise(F.concat(F.lit("="), lang)).alias("tree"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(F.concat(*[_field(c) for c in FIELDS]), 256)).alias("leaf"),
        F.when(hit & F.col("n_chars").isNotNull(), F.unhex(F.sha2(other, 256))).alias("changed"),
    )
    leaves = save_and_reload(number_rows(rows, ["tree"], ["doc_id", "leaf"]), "merkle-leaves")
    floors, tops = _build_floors(leaves, bits)
    tops = save_and_reload(number_rows(tops, [], ["tree"]), "merkle-tops")
    root_floors, root = _build_floors(tops.select(F.lit("").alias("tree"), "pos", F.col("top").alias("leaf")), bits)
    found = root.first()
    return Manifest(leaves, floors, tops, root_floors, bytes(found.top) if found else None)


_PATHS = "tree string, pos bigint, path array<binary>"


def _paths(floors: list[DataFrame], bits: int) -> DataFrame | None:
    """(tree, pos, path): siblings of every leaf of the lowest of ``floors``."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                above = row["above"] or []
                own = siblings(row["nodes"], row["leaves"], row["height"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * len(own), pa.string()),
                        pa.array((row["chunk"] << bits) + np.arange(len(own))),
                        pa.array([path + above for path in own], pa.list_(pa.binary())),
                    ],
                    ["tree", "pos", "path"],
                )

    paths = None
    for log in reversed(floors):
        if paths is None:
            log = log.withColumn("above", F.array().cast("array<binary>"))
        else:
            up = paths.select("tree", F.col("pos").alias("chunk"), F.col("path").alias("above"))
            log = log.join(up, ["tree", "chunk"], "left")
        paths = log.mapInArrow(extract, _PATHS)
    return paths


def prove(manifest: Manifest, bits: int = BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of
    every leaf, digests as lower-case hexadecimal.

    The proof is read from the logs: siblings of the leaf's own run, and for
    the whole run those of the floors above and of the root's tree.  The root is
    folded again from the tampered leaf where there is one.
    """
    if manifest.root is None:
        return manifest.leaves.select(
            "doc_id", *[F.lit(None).cast("string").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")],
            F.lit(None).cast("boolean").alias("verified"),
        )
    root = manifest.root
    to_root = _paths(manifest.root_floors, bits).select("pos", F.col("path").alias("to_root"))
    trees = manifest.tops.join(to_root, "pos").select("tree", "top", "to_root")
    runs = manifest.floors[0].join(trees, "tree")
    if len(manifest.floors) > 1:
        up = _paths(manifest.floors[1:], bits).select("tree", F.col("pos").alias("chunk"), F.col("path").alias("above"))
        runs = runs.join(up, ["tree", "chunk"], "left")
        runs = runs.withColumn("above", F.concat(F.coalesce("above", F.array().cast("array<binary>")), "to_root"))
    else:
        runs = runs.withColumn("above", F.col("to_root"))
    runs = save_and_reload(runs.select("tree", "chunk", "leaves", "height", "nodes", "above", "top"), "merkle-runs")
    width = 1 << bits
    # Other names, so that the two sides stay apart.
    runs = runs.select(F.col("tree").alias("run_tree"), F.col("chunk").alias("run_chunk"), "leaves", "height", "nodes", "above", "top")
    members = manifest.leaves.withColumn("chunk", F.floor(F.col("pos") / width).cast("bigint"))

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        run = right.slice(0, 1).to_pylist()[0]
        paths = siblings(run["nodes"], run["leaves"], run["height"])
        rows = left.select(["doc_id", "leaf", "changed", "pos"]).to_pylist()
        out = []
        for row in rows:
            path = paths[row["pos"] % width] + run["above"]
            folded = fold(row["changed"] or row["leaf"], path)
            proof = combine([s[1:] for s in path if s]).hex()
            out.append((row["doc_id"], row["leaf"].hex(), run["top"].hex(), root.hex(), proof, folded.hex(), folded == root))
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return (
        members.groupBy("tree", "chunk")
        .cogroup(runs.groupBy("run_tree", "run_chunk"))
        .applyInArrow(
            check,
            "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
        )
    )


def verify_documents(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Proof and check of every row of ``docs``, see ``build_manifest`` for the
    order of ties and ``prove`` for the columns.

    NULL fields count as ``-``; a row with NULL doc_id or NULL n_chars is not
    tampered with, so it verifies.  A lone row is its language's subroot, and a
    lone language the root.  Very long texts are hashed whole.  Extra columns
    are ignored; an empty table gives an empty result.
    """
    return prove(build_manifest(docs, bits), bits)
