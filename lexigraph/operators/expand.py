"""Concepts: a word with its singulars and plurals, theirs, and so on.

Each hop goes on from what the last one has added alone, and a round that adds nothing ends the loop, so
a hop costs what is new.  A concept's nodes weigh as many texts as they stand in.

Cases: a word without a node has no concept; null words take no part; words asked for twice are asked for once; circles end
as nothing is added twice; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.tables import cut

# Fixed value: how many hops a concept reaches.
HOPS = 6


def reached(words: DataFrame, edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """word, id: what edges (i, j) lead to from each word (word) in at most `hops` steps, itself included."""
    new = cut(words.where("word IS NOT NULL").select("word", F.col("word").alias("id")).distinct(), "concepts")
    all_, links = new, edges.select(F.col("i").alias("id"), "j").distinct()
    for _ in range(hops):
        step = new.join(links, "id").select("word", F.col("j").alias("id")).distinct()
        new = cut(step.join(all_, ["word", "id"], "left_anti"), "concepts")
        if new.isEmpty():
            break
        all_ = all_.unionByName(new)
    return all_


def concepts(words: DataFrame, pairs: DataFrame, nodes: DataFrame, hops: int = HOPS) -> DataFrame:
    """word, id, weight (texts of the node), prob (its share in the concept) and cumul, from pairs (plural, singular) and nodes (text, text_cnt)."""
    both = pairs.select(F.col("plural").alias("i"), F.col("singular").alias("j"))
    both = both.unionByName(both.select(F.col("j").alias("i"), F.col("i").alias("j")))
    counts = cut(nodes.groupBy(F.col("text").alias("id")).agg(F.sum("text_cnt").alias("weight")), "concept-nodes")
    known = words.join(counts.select(F.col("id").alias("word")), "word", "left_semi")
    rows = reached(known, both, hops).join(counts, "id")
    concept = Window.partitionBy("word")
    prob = F.col("weight") / (F.sum("weight").over(concept) + F.lit(1e-6))
    order = concept.orderBy(F.desc("weight"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("prob", prob).withColumn("cumul", F.sum("prob").over(order)).select("word", "id", "weight", "prob", "cumul")
