"""Continuous ingest: counts of each micro-batch of texts are appended by batch, and summed when read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexigraph.operators import build


def ingest(texts: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write edge counts of a stream (doc_id, text).  A batch that is run again overwrites its own folder."""

    def add(batch: DataFrame, number: int) -> None:
        build.neighbour_edges(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = texts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("i", "j").agg(F.sum("count").alias("count"))
