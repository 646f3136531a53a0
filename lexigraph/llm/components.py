"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """node, component (its smallest reachable node) for every node of links (a, b).

    Every round is written to the shared folder.  Long chains take a number of
    rounds that grows with the logarithm of their length; `rounds` only stops a
    run that doesn't end, by raising.
    """
    edges = cut(_down(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "links")
    for _ in range(rounds):
        state = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.count_distinct("u")).first()
        if state[0] == state[2]:  # every node points at one smaller node; a star if no target points on
            if edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
                return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _down(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = cut(_down(small), "links")
    raise RuntimeError(f"components are not stable after {rounds} rounds")


def _down(edges: DataFrame) -> DataFrame:
    """Distinct edges from larger to smaller node."""
    return edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one task as (node, smallest node of its component there), for nodes that aren't the smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new, new[new])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    apart = label != np.arange(len(nodes))
    return nodes[apart], nodes[label[apart]]
