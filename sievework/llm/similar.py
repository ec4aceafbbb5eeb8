"""What the similarity joins share: exact verification of candidate pairs, and connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import written


def verified(pairs: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """Of the pairs (x, y), those whose sets reach the Jaccard similarity: 100 * intersection >= percent * union.

    ``sets`` has each set once (set, items: array of distinct numbers).
    """
    x, y = (sets.select(F.col("set").alias(c), F.col("items").alias(f"{c}_items")) for c in "xy")
    both = pairs.select("x", "y").join(y, "y").join(x, "x")
    n = F.size(F.array_intersect("x_items", "y_items"))
    return both.where(n * 100 >= (F.size("x_items") + F.size("y_items") - n) * percent).select("x", "y")


def components(edges: DataFrame) -> DataFrame:
    """The smallest vertex reachable from each vertex of ``edges`` (x, y: bigint), as (vertex, label).

    Each round takes the smallest label among neighbours (a minimum, which combines before the shuffle, so a hub is not
    gathered), then jumps to the label of the label. Rounds are written to the shared folder; they end when no label
    changes, after about the logarithm of the longest path.
    """
    e = edges.where("x <> y").select("x", "y")
    e = written(e.union(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = written(e.groupBy(F.col("x").alias("vertex")).agg(F.least(F.min("y"), F.first("x")).alias("label")), "labels")
    while True:
        near = e.join(labels.withColumnRenamed("vertex", "y"), "y").groupBy(F.col("x").alias("vertex")).agg(F.min("label").alias("near"))
        low = labels.join(near, "vertex", "left").select("vertex", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = labels.select(F.col("vertex").alias("label"), F.col("label").alias("jump"))
        new = written(low.join(up, "label", "left").select("vertex", "was", F.least("label", F.coalesce("jump", "label")).alias("label")), "labels")
        labels = new.select("vertex", "label")
        if new.where("label <> was").isEmpty():
            return labels


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)
