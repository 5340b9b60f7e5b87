"""Connected components of a link table by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, component (the least node reachable, itself included) for every node of links (a long, b long).

    Every round replaces links by links to smaller nodes: at most two for each link, one join and pre-aggregated sums, written to
    the checkpoint folder. A hot node's links are joined row by row, so Spark can split them. Null ends and self-links are
    ignored; an empty table gives no rows.
    """
    link = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        state = tuple(link.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        # large star: every larger neighbour of u links to the least of u and its neighbours
        near = link.unionByName(link.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        # small star: u and its smaller neighbours link to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        link = cut(small)
    else:
        raise RuntimeError("components did not settle")
    own = link.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.unionByName(link.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class Forest:
    """Links that join rows of one comparison task into trees: fewer links than rows, whatever the number of pairs.

    Union-find over arrays. Between calls every row's entry in `root` is the least row of its tree.
    """

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Joins the trees of i[k] and j[k] for every k. A call that joins nothing costs its pairs alone."""
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, low, high = i[apart], j[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            # a root hangs under one smaller root at a time, so there are no cycles
            high, at = np.unique(high, return_index=True)
            self.root[high] = low[at]
            self.links.append((high, low[at]))
            while not np.array_equal(above := self.root[self.root], self.root):
                self.root = above

    def pairs(self) -> np.ndarray:
        """The links, a row each."""
        return np.stack([np.concatenate(side) for side in zip(*self.links, strict=True)], axis=1) if self.links else np.zeros((0, 2), dtype=np.int64)


def forest_links(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Tree links, a row each, among n rows with the same components as the pairs (i, j)."""
    forest = Forest(n)
    if len(i):
        forest.add(i, j)
    return forest.pairs()
