"""Connected components of link tables too large for one machine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b: long), component being the smallest node reachable.

    Alternating large-star and small-star rounds: each round hangs neighbours on the smallest node around, by
    aggregations (summed before the shuffle) and equi-joins. Each round's edges are written to the shared folder, and those
    before them deleted; rounds go on until nothing changes, which takes about the logarithm of the longest path. Loops and repeated edges are allowed.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(now, "edges")
    seen = _state(now)
    while True:
        last, now = now, materialize(_small_star(_large_star(now)), "edges")
        discard(last)
        state = _state(now)
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Rows and two order-free sums: equal for equal edge tables."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest of the node and its neighbours."""
    low = edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), "low")
    # A node's larger neighbours are the rows that have it as b; where it has no smaller neighbour it is its own smallest.
    joined = edges.join(low, F.col("b") == F.col("node"), "left")
    return joined.select("a", F.coalesce("low", "b").alias("b")).unionByName(low.select(F.col("node").alias("a"), F.col("low").alias("b"))).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), "low")
    moved = edges.join(low, F.col("a") == F.col("node")).filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select(F.col("node").alias("a"), F.col("low").alias("b"))).distinct()


def lowest_linked(hit: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a link matrix the smallest label in its connected component."""
    low_l, low_r = left.copy(), (left if same else right).copy()
    top = np.iinfo(np.int64).max
    rows, columns = np.nonzero(hit)
    while True:
        before = low_l.copy(), low_r.copy()
        new = np.full(len(low_r), top)
        np.minimum.at(new, columns, low_l[rows])
        low_r = np.minimum(low_r, new)
        new = np.full(len(low_l), top)
        np.minimum.at(new, rows, low_r[columns])
        low_l = np.minimum(low_l, new)
        if same:
            low_l = low_r = np.minimum(low_l, low_r)
        if (low_l == before[0]).all() and (low_r == before[1]).all():
            return low_l, low_r


class Merging:
    """Labels 0 to n-1 that become equal bit by bit."""

    def __init__(self, n: int):
        self.label, self.parent = np.arange(n), list(range(n))

    def _root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def link(self, hit: np.ndarray, rows: slice, columns: slice) -> None:
        """Rows and columns of a link matrix that are connected get one label."""
        same = rows == columns
        old = self.label[rows], self.label[columns]
        new = lowest_linked(hit, *old, same)
        for part, was, now in zip((rows, columns), old, new, strict=True):
            changed = was != now
            for pair in np.unique(np.stack([was[changed], now[changed]]), axis=1).T.tolist():
                x, y = sorted(map(self._root, pair))
                self.parent[y] = x
            self.label[part] = now

    def roots(self) -> np.ndarray:
        return np.asarray([self._root(x) for x in range(len(self.parent))], np.int64)[self.label]
