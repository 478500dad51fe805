"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.store import checkpoint


#: Edges up to which each node's smallest neighbour is broadcast (two nodes an edge at most).
FEW = 1 << 17


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, label): each node that has an edge to another, with the smallest node it can reach.

    Every round is a constant number of joins and partial aggregates keyed by node; a node's neighbours are never
    gathered, and a node with many of them is not dealt to one task: the table of smallest neighbours is broadcast, its
    size checked, or else written, so that the join is of two plain shuffles, which the skew-join rule splits. Rounds
    grow with the logarithm of the size. Only one count and one checksum a round reach the driver. Edges with a null
    end and loops are left out; repeated ones count once; without edges the result is empty."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e = checkpoint(e)
    n, before = e.count(), None

    def lows(rows: DataFrame) -> DataFrame:
        low = rows.groupBy("u").agg(F.min("v").alias("m"))
        return F.broadcast(low) if n <= FEW else checkpoint(low)

    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = lows(both)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = lows(large)
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def local_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable index of 0..n-1 over the pairs (i, j), within one task."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
