"""Reading texts, and saving and loading graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "name string, text string, word_cnt long, text_cnt long"
EDGES = "i string, j string, count long, prob double"


def read_texts(spark: SparkSession, path: str, kind: str = "jsonl", key: str = "text", most: int | None = None) -> DataFrame:
    """A text column from lines, JSON lines or Parquet."""
    if kind == "txt":
        rows = spark.read.text(path).select(F.col("value").alias("text"))
    elif kind == "jsonl":
        rows = spark.read.schema(f"`{key}` string").json(path).select(F.col(key).alias("text"))
    else:
        rows = spark.read.parquet(path).select(F.col(key).alias("text"))
    return rows if most is None else rows.limit(most)


def save(nodes: DataFrame, edges: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """kind: parquet, json or csv; edges lie in one folder for each name, so a traversal reads only its own."""
    getattr(nodes.select("name", "text", "word_cnt", "text_cnt").write.option("header", True), kind)(f"{path}/nodes")
    for name, rows in edges.items():
        getattr(rows.select("i", "j", "count", "prob").write.option("header", True), kind)(f"{path}/edges/name={name}")


def load(spark: SparkSession, path: str, names: list[str], kind: str = "parquet") -> tuple[DataFrame, dict[str, DataFrame]]:
    read = lambda schema, p: getattr(spark.read.schema(schema).option("header", True), kind)(p)
    return read(NODES, f"{path}/nodes"), {n: read(EDGES, f"{path}/edges/name={n}") for n in names}
