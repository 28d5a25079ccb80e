"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.scratch import Scratch


def stars(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index of each node's component, of ``n`` nodes with links ``left[i]``-``right[i]``."""
    label = np.arange(n)
    while True:
        a, b = label[left], label[right]
        open_ = a != b
        if not open_.any():
            return label
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; ``root`` is the component's smallest node.

    Each step is a partial aggregate and a join on 16-byte rows; no
    neighbourhood is ever collected, and the graph stays on the executors.
    Steps repeat until none changes an edge: O(log^2) of the longest path.
    """
    now = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        then = scratch.cut(small)
        # both are sets of edges: they are equal if neither has one that the other hasn't
        changed = then.withColumn("k", F.lit(1)).unionByName(now.withColumn("k", F.lit(-1))).groupBy("a", "b").agg(F.sum("k").alias("k")).where("k <> 0").limit(1).count()
        scratch.drop(now)
        now = then
        if not changed:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
