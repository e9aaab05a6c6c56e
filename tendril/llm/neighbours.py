"""Nearest neighbours by cosine: a vantage-point tree per shard, searched with relaxed triangle-inequality pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .words import whole_groups

#: Vectors of a shard at most and at least (while there are few shards), queries of a block, points of a leaf and of one comparison.
SHARD, SMALL, BLOCK, LEAF, TOGETHER = 65_536, 2_048, 16_384, 48, 512
#: How far rounding may move a cosine of unit vectors, and a distance of such: near 0 a distance is off by the root of a cosine's error.
SLACK, ROOM = 1e-12, 3e-6


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of rows, in double precision, summed from the first component on."""
    dot, x, y = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for i in range(a.shape[1]):
        dot += a[:, i] * b[:, i]
        x += a[:, i] * a[:, i]
        y += b[:, i] * b[:, i]
    return dot / (np.sqrt(x) * np.sqrt(y))


class Tree:
    """A vantage point, the median distance to it, and the points inside and outside of that radius."""

    def __init__(self, unit: np.ndarray, which: np.ndarray):
        self.leaf = which if len(which) <= LEAF else None
        if self.leaf is None:
            self.at = which[0]
            far = np.sqrt(np.maximum(0, 2 - 2 * (unit[which[1:]] @ unit[self.at])))
            self.radius = float(np.median(far))
            near = far < self.radius
            if not near.any() or near.all():
                self.leaf = which
                return
            self.inside, self.outside = Tree(unit, which[1:][near]), Tree(unit, which[1:][~near])


class Search:
    """The k rows of ``rows`` of the largest cosine for each of ``asked``, ties to the smaller id.

    Unit vectors' products, which are quick, only tell which rows could be among the k: of those the exact cosine of
    the original vectors decides.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, asked: np.ndarray, asked_ids: np.ndarray, k: int, factor: float):
        self.rows, self.ids, self.asked, self.asked_ids, self.k, self.factor = rows, ids, asked, asked_ids, k, factor
        self.unit, self.asked_unit = _unit(rows), _unit(asked)
        self.score = np.full((len(asked), k), -np.inf)
        self.found = np.full((len(asked), k), -1)
        if len(rows):
            self.visit(Tree(self.unit, np.arange(len(rows))), np.arange(len(asked)))

    def offer(self, which: np.ndarray, q: np.ndarray) -> None:
        near = self.asked_unit[q] @ self.unit[which].T
        near[self.ids[which][None, :] == self.asked_ids[q][:, None]] = -np.inf
        least = self.score[q, -1]
        if len(which) >= self.k:
            least = np.maximum(least, np.partition(near, -self.k, axis=1)[:, -self.k])
        could = (near >= least[:, None] - 2 * SLACK) & (near > -np.inf)
        some = np.flatnonzero(could.any(axis=1))
        if not len(some):
            return
        i, j = np.nonzero(could[some])
        exact = np.full((len(some), len(which)), -np.inf)
        exact[i, j] = cosine(self.rows[which[j]], self.asked[q[some[i]]])
        mine = q[some]
        score = np.concatenate([self.score[mine], exact], axis=1)
        at = np.concatenate([self.found[mine], np.broadcast_to(which, exact.shape)], axis=1)
        order = np.lexsort((np.where(at < 0, np.iinfo(np.int64).max, self.ids[at]), -score), axis=1)[:, : self.k]
        score, at = np.take_along_axis(score, order, 1), np.take_along_axis(at, order, 1)
        self.score[mine], self.found[mine] = score, np.where(score == -np.inf, -1, at)

    def visit(self, node: Tree, q: np.ndarray) -> None:
        if not len(q):
            return
        if node.leaf is not None:
            for i in range(0, len(node.leaf), TOGETHER):
                self.offer(node.leaf[i : i + TOGETHER], q)
            return
        far = np.sqrt(np.maximum(0, 2 - 2 * (self.asked_unit[q] @ self.unit[node.at])))
        self.offer(np.array([node.at]), q)
        near = far < node.radius
        self.visit(node.inside, q[near])
        self.visit(node.outside, q[~near])
        reach = np.where(self.score[q, -1] == -np.inf, np.inf, np.sqrt(np.maximum(0, 2 - 2 * np.maximum(self.score[q, -1], -1)))) / self.factor + ROOM
        self.visit(node.outside, q[near & (far + reach >= node.radius)])
        self.visit(node.inside, q[~near & (far - reach <= node.radius)])


def _unit(m: np.ndarray) -> np.ndarray:
    unit = m / np.abs(m).max(axis=1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, factor: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score): of rows whose vec_id is divisible by ``every``, the k nearest others by cosine.

    Best first, ties to the smaller vec_id. Vectors that are null, zero, or hold null or non-finite components take
    no part, nor do rows without an id; vectors of another length are never near. Of equal vectors the k + 1 with
    the smallest ids stay as candidates: no result can hold another. factor: pruning as if all distances to the k-th
    nearest were divided by it; at 1 the search is exact, ties included: rounding is allowed for, and exact scores decide. Candidates are dealt to shards and queries to blocks, of
    bounded size both; each pair of a shard and a block is a group, whose tree is built where it is searched.
    """
    v = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)).withColumn("size", F.size("v"))
    asked = v.where(F.col("vec_id") % every == 0)
    kept = v.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1).drop("n")
    count = v.count()
    shards = max(-(-count // SHARD), min(2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-count // SMALL)), 1)
    blocks = max(-(-count // every // BLOCK), 1)
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    c = kept.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), numbers(blocks).alias("block"), "size", F.lit(0).alias("kind"), "vec_id", "v")
    q = asked.select(numbers(shards).alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).alias("block"), "size", F.lit(1).alias("kind"), "vec_id", "v")
    rows = c.union(q).select((F.col("size").cast("long") * shards * blocks + F.col("shard") * blocks + F.col("block")).alias("key"), "kind", "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "key"):
            keys = rows["key"].to_numpy()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(keys)], strict=True):
                group = rows.slice(s, e - s)
                kind, ids, m = group["kind"].to_numpy(), group["vec_id"].to_numpy(), _matrix(group["v"])
                if not (kind == 1).any() or not (kind == 0).any():
                    continue
                own, other = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
                got = Search(m[own], ids[own], m[other], ids[other], k, factor)
                qi, at = np.nonzero(got.found >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[other[qi]]), pa.array(ids[own[got.found[qi, at]]]), pa.array(got.score[qi, at])], ["query_id", "vec_id", "score"])

    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
