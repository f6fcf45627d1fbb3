"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep


class Forest:
    """Union-find over integers; the least member of a tree is its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (above := self.up.get(root, root)) != root:
            root = above
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _locally(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of each partition in exchange for a forest of the same components."""

    def run(batches):
        forest = Forest()
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                forest.join(x, y)
        seen = list(forest.up)
        for i in range(0, len(seen), 100_000):
            part = seen[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(part, np.int64)), pa.array(np.array([forest.find(x) for x in part], np.int64))], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long").where("a <> b")


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One round: neighbours of a vertex are tied to the least of them; larger ones only (both), or smaller ones with the vertex itself."""
    ties = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))  # v < u
    if both:
        ties = ties.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = ties.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = ties.join(least, "u")
    if both:
        out = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge, the root being the least node of its component.

    edges: a and b, both long; direction, loops and repetitions don't matter.
    Each round is written to the shared folder.  An empty table gives an empty
    result.  A graph that needs more than most_rounds raises; rounds grow with
    the logarithm of the longest path.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    now = keep(_locally(now), "forest")
    mark = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    before = mark(now)
    for _ in range(most_rounds):
        if not before["n"]:
            break
        now = keep(_star(_star(now, True), False), "stars")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
