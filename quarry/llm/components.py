"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import forget, materialize


def _unfinished(edges: DataFrame) -> bool:
    """Whether the edges (u, v), v < u, are anything but stars around each v."""
    roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("ends"), F.lit(0).alias("centre")) \
        .union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = roles.groupBy("node").agg(F.sum("ends").alias("ends"), F.max("centre").alias("centre"))
    return bool(nodes.agg(F.max((F.col("ends") > 1) | ((F.col("ends") == 1) & (F.col("centre") == 1)))).first()[0])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node
    of an edge table; nodes may be of any type that Spark can order.

    Each round replaces the edges by stars around least neighbours, first among
    larger neighbours, then among smaller ones; a group of any size needs a
    number of rounds that grows as a logarithm. Edges live in the shared
    checkpoint folder; the driver sees whether a round is the last. Loops,
    repeated edges and edges with NULL are dropped; no edges give no rows.
    """
    x, y = F.col(a), F.col(b)
    now = materialize(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    while _unfinished(now):
        # least neighbours are written before they are joined, so that Spark can split the join where a node has very many
        both = now.union(now.select("v", "u")).toDF("u", "v")
        near = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "near")
        large = materialize(both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        close = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "near")
        small = large.join(close, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(close).distinct()
        before, now = now, materialize(small, "edges")
        forget(before, near, large, close)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def least_of_group(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that it is connected to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
