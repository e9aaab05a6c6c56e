"""Connected components of an edge table: forests of bounded chunks, then alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scratch

#: Edges of a chunk (on average) that one task takes into its forest.
CHUNK = 200_000


class Forest:
    """Spanning forest of the links seen so far, by union-find."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.pairs: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        top = np.array([self.find(x) for x in ids.tolist()], np.int64)[at]
        x, y = top[: len(a)], top[len(a) :]
        if (new := x != y).any():
            tops, first = np.unique(np.stack([x[new], y[new]]), axis=1, return_index=True)
            for (p, q), i in zip(tops.T.tolist(), np.flatnonzero(new)[first].tolist(), strict=True):
                p, q = self.find(p), self.find(q)
                if p != q:
                    low, high = min(p, q), max(p, q)
                    self.up[high] = low
                    self.up.setdefault(low, low)
                    self.pairs.append((int(a[i]), int(b[i])))

    def edges(self) -> tuple[list[int], list[int]]:
        u = [x for x, y in self.up.items() if x != y]
        return u, [self.find(x) for x in u]


def _pair_batch(u, v) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a chunk's edges but the smallest of a group, tied to that one."""
    forest = Forest()
    for batch in batches:
        forest.add(batch.column("u").to_numpy(), batch.column("v").to_numpy())
    yield _pair_batch(*forest.edges())


def _large(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. Edges point from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    turned = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return turned.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Of edges (u, v), longs: (node, root) for every node that has an edge; root is the smallest node it can reach.

    Loops, repeated and turned edges and nulls are harmless; no edges give no rows. Edges are first dealt by their
    larger node in chunks of CHUNK, and a task gives back a row a node of its chunk; one chunk is all there is to do.
    Several are followed by rounds of joins. Each round's edges are written to the shared folder, so a lost executor
    costs one round at most; rounds grow with the logarithm of the longest chain. Groups are pre-aggregated (min),
    joins are plain joins whose skew AQE splits.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    every = scratch.table(edges, "edges")
    chunks = -(-every.count() // CHUNK)
    dealt = every.repartition(chunks, "u") if chunks > 1 else every.repartition(1)
    now = scratch.table(dealt.mapInArrow(_forest, "u long, v long"), "edges")
    scratch.drop(every)
    mark = None
    while chunks > 1:
        after = scratch.table(_small(_large(now)), "edges")
        was, mark = mark, after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if mark == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
