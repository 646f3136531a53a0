"""The query operators over weighted node sets (id, count, weight, prob).

A set is normalised after every operator: prob = weight / sum, entries under 1e-6 go,
prob is normalised again.  Each operator writes its set once into the shared folder,
so its sums are taken from a small table and a flow's plan grows with its steps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.functions import hashing
from lexigraph.tables import cut

LEAST = 1e-6


def normalise(rows: DataFrame) -> DataFrame:
    """One look at the set gives its sum; only where an entry is too small a second one is needed."""
    rows = cut(rows.select("id", "count", "weight"), "nodeset")
    total, least = rows.agg(F.sum("weight"), F.min("weight")).first()
    first = rows.withColumn("prob", F.col("weight") / F.lit(float(total or 1)))
    if not total or least / total >= LEAST * (1 + 1e-9):
        return first.where(F.col("prob") >= LEAST)
    first = first.where(F.col("prob") >= LEAST)
    kept = first.agg(F.sum("prob")).first()[0]
    return first.withColumn("prob", F.col("prob") / F.lit(float(kept or 1)))


def select_nodes(nodes: DataFrame, words: list[str], any_spacing: bool = True) -> DataFrame:
    """The nodes of the given words, alike whether or not white space stands before them."""
    names = sorted({x for w in words for x in ((w, "▁" + w) if any_spacing else (w,))})
    return normalise(nodes.where(F.col("text").isin(names)).select(F.col("text").alias("id"), F.lit(1).cast("long").alias("count"), F.lit(1.0).alias("weight")))


def select_paths(nodes: DataFrame, paths: list[list[str]]) -> DataFrame:
    """Paths of tokens: one token hits every node of that text, several the node of the whole phrase."""
    names = sorted({x for p in paths for x in ((p[0], "▁" + p[0]) if len(p) == 1 else (" ".join(p),))})
    found = nodes.where(F.col("text").isin(names)).select(F.col("text").alias("id")).distinct()
    return normalise(found.select("id", F.lit(1).cast("long").alias("count"), F.lit(1.0).alias("weight")))


def node_hash(nodes: DataFrame) -> DataFrame:
    """nodes with the identity hash of flavour and text; nodes that have a hash keep it."""
    if "hash" in nodes.columns:
        return nodes
    return nodes.withColumn("hash", hashing.text_hash(F.concat(F.lit("__"), "name", F.lit("_"), "text", F.lit("__"))))


def select_hashes(nodes: DataFrame, weights: list[tuple[int, float]]) -> DataFrame:
    """Nodes (with a column hash) by their hashes, with weights; of a hash given twice the last weight holds."""
    last = {h - (1 << 64) if h >= 1 << 63 else h: float(w) for h, w in weights}
    wanted = nodes.sparkSession.createDataFrame(list(last.items()), "hash long, weight double")
    return normalise(nodes.join(wanted, "hash").select(F.col("text").alias("id"), F.lit(1).cast("long").alias("count"), "weight"))


def select_weighted(spark, weights: dict[str, float]) -> DataFrame:
    return normalise(spark.createDataFrame([(k, 1, float(v)) for k, v in weights.items()], "id string, count long, weight double"))


def traverse(source: DataFrame, edges: DataFrame) -> DataFrame:
    """Step along edges (i, j, count, and prob, which is made for the source's edges if it isn't kept): weights are prob times the edge's prob, summed."""
    met = source.select(F.col("id").alias("i"), F.col("prob").alias("p")).join(edges, "i")
    if "prob" not in edges.columns:
        total = met.groupBy("i").agg(F.sum("count").alias("total"))
        met = met.join(total, "i").withColumn("prob", F.col("count") / (F.col("total") + F.lit(1e-6)))
    return normalise(met.groupBy(F.col("j").alias("id")).agg(F.sum("count").alias("count"), F.sum(F.col("p") * F.col("prob")).alias("weight")))


def filter_flavours(source: DataFrame, nodes: DataFrame, names: list[str]) -> DataFrame:
    kept = source.join(nodes.where(F.col("name").isin(names)).select(F.col("text").alias("id")), "id", "left_semi")
    return normalise(kept.withColumn("weight", F.col("prob")))


def filter_regex(source: DataFrame, patterns: list[str]) -> DataFrame:
    """Nodes whose text, marks aside, holds any of the patterns."""
    text = F.regexp_replace("id", "▁", " ")
    hit = reduce(lambda a, b: a | b, [F.trim(text).rlike(p) for p in patterns])
    return normalise(source.where(hit).withColumn("weight", F.col("prob")))


def filter_contains(source: DataFrame, other: DataFrame, parts: DataFrame) -> DataFrame:
    """Nodes that are in `other`, or one of whose parts (id, part) is."""
    inside = parts.join(other.select(F.col("id").alias("part")), "part", "left_semi").select("id").unionByName(other.select("id")).distinct()
    return normalise(source.join(inside, "id", "left_semi").withColumn("weight", F.col("prob")))


def without(source: DataFrame, other: DataFrame) -> DataFrame:
    return normalise(source.join(other.select("id"), "id", "left_anti").withColumn("weight", F.col("prob")))


def _numbered(sets: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [s.select("id", "count", "prob", F.lit(k).alias("k")) for k, s in enumerate(sets)])


def join(sets: list[DataFrame], mode: str = "last") -> DataFrame:
    """Union; count is the largest, weight that of the last set ("last") or the largest ("max")."""
    weight = F.max_by("prob", "k") if mode == "last" else F.max("prob")
    return normalise(_numbered(sets).groupBy("id").agg(F.max("count").alias("count"), weight.alias("weight")))


def intersect(sets: list[DataFrame]) -> DataFrame:
    """What all sets hold; count and weight are the least."""
    met = _numbered(sets).groupBy("id").agg(F.min("count").alias("count"), F.min("prob").alias("weight"), F.count("*").alias("n"))
    return normalise(met.where((F.col("n") == len(sets)) & (F.col("weight") >= LEAST)).drop("n"))


def uniform(source: DataFrame) -> DataFrame:
    return normalise(source.select("id", F.lit(1).cast("long").alias("count"), F.lit(1.0).alias("weight")))


def accumulate(sets: list[DataFrame]) -> DataFrame:
    """Union that adds counts and weights."""
    return normalise(_numbered(sets).groupBy("id").agg(F.sum("count").alias("count"), F.sum("prob").alias("weight")))


def intersect_adding(sets: list[DataFrame]) -> DataFrame:
    """What all sets hold, with counts and weights added."""
    met = _numbered(sets).groupBy("id").agg(F.sum("count").alias("count"), F.sum("prob").alias("weight"), F.count("*").alias("n"))
    return normalise(met.where(F.col("n") == len(sets)))


def resolved(source: DataFrame, nodes: DataFrame) -> DataFrame:
    """The set's rows with their nodes' flavour name and counts, by prob: the rows of a result."""
    return source.join(nodes.select(F.col("text").alias("id"), "name", "word_cnt"), "id").select("id", "name", "word_cnt", "count", "weight", "prob")


def subgraph(sets: list[DataFrame], edges: DataFrame, hops: int = 1) -> tuple[DataFrame, DataFrame]:
    """The sets' union with what its edges lead to in `hops` steps, and these edges (i, j, prob)."""
    own = _numbered(sets).groupBy("id").agg(F.max("count").alias("count"), F.sum("prob").alias("weight"))
    own, met = cut(own, "subgraph"), None
    new = own.select(F.col("id").alias("i"))
    for hop in range(hops):
        out = cut(edges.join(new, "i", "left_semi").select("i", "j", "prob"), "subgraph-edges")
        met = out if met is None else met.unionByName(out)
        ends = out.groupBy(F.col("j").alias("id")).agg(F.lit(1).cast("long").alias("count"), F.max("prob").alias("weight"))
        ends = cut(ends.join(own.select("id"), "id", "left_anti"), "subgraph-ends")
        own, new = own.unionByName(ends), ends.select(F.col("id").alias("i"))
    return normalise(own), met


def overview(steps: list[tuple[int, str, DataFrame]]) -> DataFrame:
    """flid, flop, n, avg, std and ent of each step of a flow."""
    each = [statistics(rows).select(F.lit(k).alias("flid"), F.lit(name).alias("flop"), "n", "avg", "std", "ent") for k, name, rows in steps]
    return reduce(DataFrame.unionByName, each)


def statistics(source: DataFrame) -> DataFrame:
    """n, avg, std, ent of prob; std and ent are 0 for one node."""
    n = F.count("*")
    one = source.agg(n.alias("n"), F.sum(F.col("prob") * F.col("prob")).alias("s2"), F.sum(-F.col("prob") * F.log("prob")).alias("e"))
    many = F.col("n") > 1
    avg = F.lit(1.0) / F.col("n")
    spread = F.sqrt(F.greatest(F.col("s2") - avg, F.lit(0.0))) / (F.col("n") - 1)
    return one.where("n > 0").select("n", avg.alias("avg"), F.when(many, spread).otherwise(0.0).alias("std"), F.when(many, F.col("e")).otherwise(0.0).alias("ent"))


def page(source: DataFrame, size: int, start: int = 0) -> DataFrame:
    """A page by prob with the running sum; only its rows and those before it are sorted together."""
    order = Window.orderBy(F.desc("prob"), "id")
    top = source.orderBy(F.desc("prob"), "id").limit(start + size)
    top = top.withColumn("cumul", F.sum("prob").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("rank", F.row_number().over(order))
    return top.where(F.col("rank") > start)
