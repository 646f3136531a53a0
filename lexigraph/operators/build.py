"""Graph building and upkeep: counted nodes (id, name, text, word_cnt, text_cnt) and edges (name, i, j, count, prob).

A text's tokens stay in one array, so neighbours are paired inside a row; the
only shuffle is the grouped sum, which Spark combines before it moves anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.functions import text as T

# Flavours of nodes and edges, and the reserved ends of a text.
NODE_FLAVOURS = {"subw_token": 0, "word_token": 1, "syntax": 2, "label": 4, "sublabel": 5, "cont": 8, "conn": 9, "term": 10, "verb": 11, "inst": 12, "sentence": 16, "text": 32, "table": 48, "section": 64, "chapter": 65, "document": 96, "book": 97}
EDGE_FLAVOURS = {"prev": 65535, "next": 1, "tax-dn": 32, "tax-up": 33, "to-singular": 66, "to-plural": 67, "to-token": 96, "from-token": 97, "to-pos": 98, "from-pos": 99, "to-label": 100, "from-label": 101, "to-root": 102, "from-root": 103, "to-sent": 128, "from-sent": 129, "to-text": 130, "from-text": 131, "to-table": 132, "from-table": 133, "to-doc": 134, "from-doc": 135}
BEGIN, END = "__beg_text__", "__end_text__"


def tokens(documents: DataFrame) -> DataFrame:
    """doc_id, pos (from 1), word, plain."""
    rows = documents.select("doc_id", F.posexplode(T.words()).alias("at", "word"))
    return rows.select("doc_id", (F.col("at") + 1).alias("pos"), "word", T.unmarked(F.col("word")).alias("plain"))


def word_nodes(documents: DataFrame) -> DataFrame:
    """name, text, word_cnt, text_cnt of word nodes.

    A text gives its words and, apart, its distinct words, so that both counts are
    plain sums by word and no pair of word and text is shuffled.
    """
    w = documents.select(T.words().alias("w"))
    both = F.array(F.struct(F.lit(1).alias("n"), F.lit(0).alias("texts"), F.col("w").alias("w")), F.struct(F.lit(0).alias("n"), F.lit(1).alias("texts"), F.array_distinct("w").alias("w")))
    rows = w.select(F.inline(both)).select("n", "texts", F.explode("w").alias("text"))
    return rows.groupBy("text").agg(F.sum("n").alias("word_cnt"), F.sum("texts").alias("text_cnt")).select(F.lit("word_token").alias("name"), "text", "word_cnt", "text_cnt")


def neighbour_edges(documents: DataFrame, distance: int = 1, ends: bool = True) -> DataFrame:
    """i, j, count: words `distance` apart, and the ends of each text."""
    w = documents.select(T.words().alias("w"))
    ahead = F.slice("w", distance + 1, F.greatest(F.size("w") - distance, F.lit(0)))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - distance, F.lit(0))), ahead, lambda a, b: F.struct(a.alias("i"), b.alias("j")))
    if ends and distance == 1:
        pairs = F.concat(F.array(F.struct(F.lit(BEGIN).alias("i"), F.get("w", F.lit(0)).alias("j"))), pairs, F.array(F.struct(F.get("w", F.size("w") - 1).alias("i"), F.lit(END).alias("j"))))
    # no filter on the size: it would be pushed below and find the words twice
    return w.select(F.inline(F.when(F.size("w") > 0, pairs))).groupBy("i", "j").agg(F.count("*").alias("count"))


def document_edges(documents: DataFrame) -> DataFrame:
    """i (word), j (doc_id as text), count; null texts and ids give none."""
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("string").alias("j"), F.explode(T.words()).alias("i"))
    return rows.groupBy("i", "j").agg(F.count("*").alias("count")).select("i", "j", "count")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "count")


def with_prob(edges: DataFrame) -> DataFrame:
    """count over all counts of the same start (plus 1e-6)."""
    total = edges.groupBy("i").agg(F.sum("count").alias("total"))
    return edges.join(total, "i").select("i", "j", "count", (F.col("count") / (F.col("total") + F.lit(1e-6))).alias("prob"))


def merge_nodes(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.unionByName(two).groupBy("name", "text").agg(F.sum("word_cnt").alias("word_cnt"), F.sum("text_cnt").alias("text_cnt"))


def merge_edges(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.unionByName(two).groupBy("i", "j").agg(F.sum("count").alias("count"))


def distill(nodes: DataFrame, edges: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Edges counted at least `least` times, and the nodes that they touch."""
    kept = edges.where(F.col("count") >= least)
    touched = kept.select(F.col("i").alias("text")).unionByName(kept.select(F.col("j").alias("text"))).distinct()
    return nodes.join(touched, "text", "left_semi"), with_prob(kept.select("i", "j", "count"))


def bucket(column: str):
    """The least power of two that isn't below the count, 2 ** 20 at most; 0 stays 0."""
    c = F.col(column)
    return F.when(c <= 0, F.lit(0)).otherwise(F.least(F.lit(1 << 20), F.pow(F.lit(2.0), F.ceil(F.log2(c.cast("double")))))).cast("long")


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """bucket, n."""
    return rows.groupBy(bucket(column).alias("bucket")).agg(F.count("*").alias("n"))


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("i").alias("id")).agg(F.count("*").alias("degree"), F.sum("count").alias("weight"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ends of edges without a node."""
    ends = edges.select(F.col("i").alias("text")).unionByName(edges.select(F.col("j").alias("text"))).distinct()
    return ends.join(nodes.select("text"), "text", "left_anti").select(F.col("text").alias("id"))


def plural_pairs(nodes: DataFrame) -> DataFrame:
    """plural, singular: words whose first matching suffix rule gives another word."""
    # The rules in their order.
    rules = (("ies", "y"), ("s", ""), ("sses", "ss"), ("us", "i"))
    w = nodes.select(F.col("text").alias("plural")).where(F.length("plural") > 3)
    made = F.array(*(F.when(F.endswith("plural", F.lit(s)), F.struct(F.lit(k).alias("rule"), F.concat(F.expr(f"left(plural, length(plural) - {len(s)})"), F.lit(t)).alias("singular"))) for k, (s, t) in enumerate(rules)))
    made = w.select("plural", F.inline(F.filter(made, lambda x: x.isNotNull())))
    hit = made.join(nodes.select(F.col("text").alias("singular")), "singular")
    first = hit.groupBy("plural").agg(F.min_by("singular", "rule").alias("singular"))
    return first.where("plural != singular")


def ranked_pages(rows: DataFrame, order: str, size: int, start: int = 0) -> DataFrame:
    top = rows.orderBy(F.desc(order), "id").limit(start + size)
    number = F.row_number().over(Window.orderBy(F.desc(order), "id"))
    return top.withColumn("rank", number).where(F.col("rank") > start)
