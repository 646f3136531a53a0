"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and the ASCII controls 9 to 13.
#: bytes.split() and bytes.lower() follow exactly this set and only A-Z.
WORD = r"[^\x20\x09-\x0D]+"


#: Folder names of open scratch() blocks, innermost last.
_SCRATCH: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir; where it is unset, a folder of our own if the session has one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = os.path.join(tempfile.gettempdir(), "lexigraph-checkpoints")
    return f"{folder.rstrip('/')}/lexigraph/{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut inside are deleted at the end; write what is built from them before."""
    _SCRATCH.append(uuid.uuid4().hex)
    try:
        yield
    finally:
        remove(spark, f"{shared_folder(spark)}/{_SCRATCH.pop()}")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    It stays until the scratch() block around it ends, or forget() is called, as lazy results still read it.
    """
    spark = df.sparkSession
    path = "/".join([shared_folder(spark), *_SCRATCH[-1:], f"{name}-{uuid.uuid4().hex}"])
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete all tables that this application has cut."""
    remove(spark, shared_folder(spark))


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def blocks(batches: Iterable[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches whose UTF-8 texts hold about `limit` bytes (one longer text stands alone); null is empty."""
    for batch in batches:
        texts = [t.encode() if t else b"" for t in batch.column("text").to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Runs of equal keys in sorted batches, as lists of rows; a run may cross batches."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[key] != now:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


def whole_runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[list[pa.RecordBatch]]:
    """Lists of sorted batches, cut so that each run of equal keys lies in one list; runs that cross batches are kept back till they end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(key).to_numpy()
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if not last and held and held[-1].column(key)[-1].as_py() == keys[0]:
            held.append(batch)
            continue
        if held or last:
            yield [*held, batch.slice(0, last)] if last else held
        held = [batch.slice(last)]
    if held:
        yield held


def wide(df: DataFrame) -> int:
    """Partitions for a shuffle that must stay balanced, as the session says."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
