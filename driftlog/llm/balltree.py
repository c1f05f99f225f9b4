"""Exact top-k inner products by ball-tree branch and bound.

Vectors are dealt to shards of bounded size and each shard is searched through
a ball tree.  Queries come in blocks.  A query first searches its own shard;
the k-th score found there is shared with all other shards as the score to
beat.  Inside a shard, balls are opened in the order of their upper bound
``q . centre + |q| * radius``, and a query stops as soon as no ball left can
beat its current k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.session import save_and_reload

LEAF = 64
SHARD_ROWS = 8_192
BLOCK_QUERIES = 4_096
BATCH = 512
_LEAST = np.iinfo(np.int64).min


class BallTree:
    """Balls over the rows of an integer matrix, level by level."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        points = vectors.astype(np.float64)
        order = np.arange(len(ids))
        self.spans: list[list[tuple[int, int]]] = [[(0, len(ids))]]
        while self.spans[-1][0][1] - self.spans[-1][0][0] > leaf:
            level = []
            for a, b in self.spans[-1]:
                rows = order[a:b]
                # Split at the median along the widest direction of two far points.
                here = points[rows]
                one = here[np.argmax(((here - here[0]) ** 2).sum(1))]
                two = here[np.argmax(((here - one) ** 2).sum(1))]
                along = here @ (two - one)
                middle = (b - a) // 2
                order[a:b] = rows[np.argpartition(along, middle)] if b - a > 1 else rows
                level += [(a, a + middle), (a + middle, b)]
            self.spans.append(level)
        self.ids, self.vectors, self.points = ids[order], vectors[order], points[order]
        self.centres, self.radii = [], []
        for level in self.spans:
            centres = np.array([self.points[a:b].mean(0) if b > a else np.zeros(points.shape[1]) for a, b in level])
            self.centres.append(centres)
            self.radii.append(
                np.array([
                    np.sqrt(((self.points[a:b] - c) ** 2).sum(1).max()) if b > a else 0.0
                    for (a, b), c in zip(level, centres, strict=True)
                ])
            )
        peak = float(np.abs(points).max()) if points.size else 0.0
        self.peak = peak

    def exact(self, queries: np.ndarray, a: int, b: int) -> np.ndarray:
        """Integer inner products; floats only while they are exact."""
        largest = self.peak * float(np.abs(queries).max() if queries.size else 0) * max(queries.shape[1], 1)
        if largest < 2**53:
            return (queries.astype(np.float64) @ self.points[a:b].T).astype(np.int64)
        return queries @ self.vectors[a:b].T

    def search(self, queries: np.ndarray, own: np.ndarray, beat: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of each query's best k rows that reach ``beat``; rows
        with the query's own id are left out, and free places have id -1."""
        floats = queries.astype(np.float64)
        lengths = np.sqrt((floats**2).sum(1))
        ids = np.full((len(queries), k), -1, np.int64)
        scores = np.full((len(queries), k), _LEAST, np.int64)
        kth = beat.copy()
        # Branch: all balls of a level at once, for the queries they may serve.
        who = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        bound = np.full(len(queries), np.inf)
        for depth in range(len(self.spans)):
            if depth:
                who, node = np.repeat(who, 2), np.repeat(2 * node, 2) + np.tile([0, 1], len(node))
            near = np.einsum("ij,ij->i", floats[who], self.centres[depth][node])
            bound = near + lengths[who] * self.radii[depth][node]
            bound += 1e-9 * (np.abs(near) + np.abs(bound)) + 1e-6
            open_ = bound >= kth[who]
            who, node, bound = who[open_], node[open_], bound[open_]
        # Bound: every query opens its leaves from the highest bound down.
        order = np.lexsort((-bound, who))
        who, node, bound = who[order], node[order], bound[order]
        begins = np.searchsorted(who, np.arange(len(queries) + 1))
        turn = np.zeros(len(queries), np.int64)
        active = np.flatnonzero(begins[1:] > begins[:-1])
        while len(active):
            at = begins[active] + turn[active]
            going = at < begins[active + 1]
            active, at = active[going], at[going]
            going = bound[at] >= kth[active]
            active, at = active[going], at[going]
            for leaf in np.unique(node[at]):
                these = active[node[at] == leaf]
                a, b = self.spans[-1][leaf]
                found = self.exact(queries[these], a, b)
                names = np.broadcast_to(self.ids[a:b], found.shape)
                free = (names == own[these][:, None]) | (found < beat[these][:, None])
                all_scores = np.concatenate((scores[these], np.where(free, _LEAST, found)), axis=1)
                all_ids = np.concatenate((ids[these], np.where(free, -1, names)), axis=1)
                last = np.where(all_ids < 0, np.iinfo(np.int64).max, all_ids)
                best = np.lexsort((last, -np.maximum(all_scores, _LEAST + 1)), axis=1)[:, :k]
                ids[these] = np.take_along_axis(all_ids, best, 1)
                scores[these] = np.take_along_axis(all_scores, best, 1)
                full = ids[these][:, -1] >= 0
                kth[these] = np.maximum(kth[these], np.where(full, scores[these][:, -1], _LEAST))
            turn[active] += 1
        return ids, scores


def usable_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v) with every component x as floor(scale * x).

    Rows without id or vector, or with a NULL, NaN or infinite component, take
    no part.  Of rows repeating a vec_id the least vector counts.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    cells = F.transform("embedding", lambda x: F.floor(x * F.lit(scale)).cast("bigint"))
    return (
        vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .filter("vec_id is not null and embedding is not null")
        .filter(fine)
        .select("vec_id", cells.alias("v"))
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
    )


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    lists = table.column(column).combine_chunks()
    flat = np.asarray(lists.flatten(), np.int64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


_FOUND = "query_id bigint, vec_id bigint, score bigint"


def _rows(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.Table:
    some = ids >= 0
    owner = np.broadcast_to(queries[:, None], ids.shape)
    return pa.table({"query_id": owner[some], "vec_id": ids[some], "score": scores[some]})


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows.

    Queries are the rows whose vec_id is divisible by ``every``; every other
    row of the same vector length is a candidate.  The score is the exact
    integer inner product; ties go to the smaller vec_id.  With fewer than k
    candidates all are returned.  An empty table gives an empty result.
    """
    usable = save_and_reload(usable_vectors(vectors), "vectors")
    sizes = usable.groupBy(F.size("v").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")
    )
    sizes = sizes.select(
        "dim",
        F.ceil(F.col("n") / shard_rows).alias("shards"),
        F.greatest(F.ceil(F.col("q") / block_queries), F.lit(1)).alias("blocks"),
    )
    placed = (
        usable.withColumn("dim", F.size("v"))
        .join(sizes, "dim")
        .withColumn("shard", F.pmod(F.xxhash64("vec_id"), "shards"))
        .withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), "blocks"))
    )

    def at_home(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, matrix = table.column("vec_id").to_numpy(), _matrix(table, "v")
        mine = np.flatnonzero(ids % every == 0)
        if not len(mine):
            return _rows(ids[:0], np.zeros((0, k), np.int64), np.zeros((0, k), np.int64))
        tree = BallTree(matrix, ids)
        parts = [
            tree.search(matrix[rows], ids[rows], np.full(len(rows), _LEAST), k)
            for rows in np.array_split(mine, -(-len(mine) // BATCH))
        ]
        return _rows(ids[mine], *(np.concatenate(x) for x in zip(*parts, strict=True)))

    home = placed.groupBy("dim", "shard").applyInArrow(at_home, _FOUND)
    home = save_and_reload(home, "home-best")
    # Only a full list of k gives a score that others must reach.
    to_beat = home.groupBy(F.col("query_id").alias("vec_id")).agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("beat")
    )
    queries = (
        placed.filter(F.col("vec_id") % every == 0)
        .join(to_beat, "vec_id", "left")
        .withColumn("other", F.explode(F.expr("sequence(0L, shards - 1)")))
        .filter("other != shard")
        .select("dim", F.col("other").alias("shard"), "block", "vec_id", "v", F.coalesce("beat", F.lit(_LEAST)).alias("beat"))
    )
    # Other names, so that the two sides of the same table stay apart.
    shards = placed.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(
        *[F.col(name).alias(f"row_{name}") for name in ("dim", "shard", "block", "vec_id", "v")]
    )

    def elsewhere(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("vec_id").to_numpy()
        beat = left.column("beat").to_numpy()
        if not len(ids) or not right.num_rows:
            return _rows(ids[:0], np.zeros((0, k), np.int64), np.zeros((0, k), np.int64))
        matrix = _matrix(left, "v")
        tree = BallTree(_matrix(right, "row_v"), right.column("row_vec_id").to_numpy())
        parts = [
            tree.search(matrix[rows], ids[rows], beat[rows], k)
            for rows in np.array_split(np.arange(len(ids)), -(-len(ids) // BATCH))
        ]
        return _rows(ids, *(np.concatenate(x) for x in zip(*parts, strict=True)))

    keys = ["dim", "shard", "block"]
    away = (
        queries.groupBy(*keys)
        .cogroup(shards.groupBy(*[f"row_{name}" for name in keys]))
        .applyInArrow(elsewhere, _FOUND)
    )
    # A query has at most k rows from each shard.
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id")))
    return (
        home.union(away)
        .groupBy("query_id")
        .agg(F.slice(best, 1, k).alias("best"))
        .select("query_id", F.posexplode("best"))
        .select("query_id", (F.col("pos") + 1).alias("rank"), "col.vec_id", (-F.col("col.down")).alias("score"))
    )
