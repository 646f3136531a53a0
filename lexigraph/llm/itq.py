"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learned so that the signs of the rotated,
centred vectors lose least (iterative quantisation), which gives balanced codes.
Codes are cut into runs of bits; each run is the key of a hash table, and two
vectors that agree on a whole run in any table are candidates if their whole codes
differ in few bits.  Vectors within the angle of the threshold agree on a bit with
probability 1 - angle / pi at least for random planes; the number of tables follows
from that, the run length and the wanted `recall`, and so does the number of bits
that may differ, eight deviations above the mean; several rotations give bits enough.
The run length is the logarithm of the number of vectors, so buckets keep their size
as tables grow; larger buckets are compared in pairs of blocks, all of them.

Only packed codes go to the tables.  They say which representatives have a candidate
in a bucket, and only there do their vectors follow, to be compared by their original
components in double precision.  A pair counts in the first table that brings it
together, so links are summed where they are found, and only sums and spanning links
leave a task.  Equal vectors of one label are one representative with a number of
copies.

The rotation is fitted on at most `sample` distinct vectors, by hash; all are indexed.

Cases: vectors that are null, empty, zero or hold null or non-finite components,
and those with null labels, link with nothing; vectors of different length do
not link; repeated rows with one vec_id count as rows each in n_links, and give
rows each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components, stars


def learn_rotations(x: np.ndarray, number: int, rounds: int = 40, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and `number` maps from centred vectors to real codes whose signs are the bits."""
    mean = x.mean(0)
    centred = x - mean
    axes = np.linalg.eigh(centred.T @ centred / max(len(x), 1))[1]
    v = centred @ axes
    out = []
    for i in range(number):
        r = np.linalg.qr(np.random.default_rng(seed + i).normal(size=(x.shape[1], x.shape[1])))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return mean, np.concatenate(out, 1)


def plan(n: int, threshold: float, recall: float) -> tuple[int, int, int]:
    """Bits of a run, number of tables, and bits of the whole code in which near vectors may differ."""
    bits = max(6, min(30, math.ceil(math.log2(max(n, 2))) - 2))
    differ = math.acos(threshold) / math.pi
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** bits)))
    total = bits * tables
    return bits, tables, math.ceil(total * differ + 8 * math.sqrt(total * differ * (1 - differ)))


def runs_of(words: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The runs, as numbers, of packed codes [n, 64-bit words]."""
    flat = np.unpackbits(words.view(np.uint8), axis=1)[:, : bits * tables]
    return (flat.reshape(len(words), tables, bits) * (1 << np.arange(bits))).sum(2)


def bucket_pairs(rows: pa.Table, bits: int, tables: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of two rows of one bucket whose codes differ in `most` bits at most, and for which no earlier table has one run; in portions."""
    key, rep, part, inner, table = (rows.column(c).to_numpy() for c in ("bucket", "rep", "part", "inner", "table"))
    words = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint64).reshape(len(rows), -1)
    step, first = 1, np.arange(len(rows))
    while True:
        first = first[first + step < len(rows)]
        first = first[key[first] == key[first + step]]
        if not len(first):
            return
        for lo in range(0, len(first), 50_000):
            a = first[lo : lo + 50_000]
            b = a + step
            near = (np.bitwise_count(words[a] ^ words[b]).sum(1) <= most) & (rep[a] != rep[b]) & (table[a] == table[b]) & (inner[a] | (part[a] != part[b]))
            a, b = a[near], b[near]
            if len(a):
                same = runs_of(words[a], bits, tables) == runs_of(words[b], bits, tables)
                ok = same.argmax(1) == table[a]
                yield a[ok], b[ok]
        step += 1


def whole_buckets(batches: Iterator[pa.RecordBatch], least: int = 20_000) -> Iterator[pa.Table]:
    """Sorted batches as tables that hold whole buckets and, but for the last, `least` rows or more."""
    rest: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        rest = part if rest is None else pa.concat_tables([rest, part])
        if len(rest) < least:
            continue
        keys = rest.column("bucket").to_numpy()
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if last:
            yield rest.slice(0, last)
            rest = rest.slice(last).combine_chunks()
    if rest is not None and len(rest):
        yield rest


def near_vectors(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.9995, sample: int = 4096, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", "label")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    keyed = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    one, two = F.xxhash64("label", "embedding"), F.xxhash64(F.lit(1), "embedding", "label")
    good = keyed.where("sound").select("vec_id", "label", "embedding", one.alias("k1"), two.alias("k2"))
    reps = cut(good.groupBy("k1", "k2").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    n = reps.count()
    chosen = reps.orderBy("k1", "k2").limit(sample).select("embedding").collect() if n else []
    lengths = sorted({len(r[0]) for r in chosen})
    if not lengths:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    bits, tables, most = plan(n, threshold, recall)
    models = {}
    for d in lengths:
        x = np.array([r[0] for r in chosen if len(r[0]) == d], float)
        models[d] = learn_rotations(x / np.sqrt((x * x).sum(1, keepdims=True)), -(-bits * tables // d))
    shared = spark.sparkContext.broadcast(models)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                vec = batch.column("embedding").to_pylist()
                signs = np.zeros((len(vec), -(-bits * tables // 64) * 64), bool)
                for d in {len(v) for v in vec}:
                    if d not in shared.value:  # a length the sample lacks: any fixed planes do
                        shared.value[d] = learn_rotations(np.eye(d), -(-bits * tables // d), 1)
                    pick = np.array([i for i, v in enumerate(vec) if len(v) == d])
                    x = np.array([vec[i] for i in pick], float)
                    mean, turn = shared.value[d]
                    signs[pick, : bits * tables] = ((x / np.sqrt((x * x).sum(1, keepdims=True)) - mean) @ turn >= 0)[:, : bits * tables]
                words = np.packbits(signs, axis=1).view(np.uint64)
                table, row = np.tile(np.arange(tables, dtype=np.int32), len(vec)), pa.array(np.repeat(np.arange(len(vec)), tables))
                packed = pa.array([w.tobytes() for w in words], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("rep").take(row), batch.column("label").take(row), pa.array(table), pa.array(runs_of(words, bits, tables).ravel()), packed.take(row)], ["rep", "label", "table", "run", "code"])

    coded = reps.select("rep", F.col("label").cast("long").alias("label"), "embedding").mapInArrow(index, "rep long, label long, table int, run long, code binary")
    dealt = coded.select("rep", "table", "code", F.xxhash64("label", "table", "run").alias("bucket"))
    # buckets above a block's size are compared in all pairs of their blocks
    large = dealt.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > block).select("bucket", F.ceil(F.col("size") / block).cast("int").alias("parts"))
    dealt = dealt.join(large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("bucket", F.when(F.col("parts") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))))
    dealt = dealt.select("bucket", "rep", "table", "code", "part", (F.col("part") == F.col("other")).alias("inner"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each bucket that have a candidate there."""
        for rows in whole_buckets(batches):
            some = np.zeros(len(rows), bool)
            for a, b in bucket_pairs(rows, bits, tables, most):
                some[a] = some[b] = True
            yield from rows.filter(pa.array(some)).to_batches()

    met = dealt.repartition("bucket").sortWithinPartitions("bucket", "rep").mapInArrow(candidates, dealt.schema)
    vector = reps.select("rep", "copies", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    met = cut(met, "candidates").join(vector, "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_buckets(batches, 5000):
            rep, copies, label = (rows.column(c).to_numpy() for c in ("rep", "copies", "label"))
            vec = rows.column("vector").combine_chunks()
            size = np.diff(vec.offsets.to_numpy())
            flat, start = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()[:-1]
            got: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in bucket_pairs(rows, bits, tables, most):
                fit = (label[a] == label[b]) & (size[a] == size[b])
                a, b = a[fit], b[fit]
                for d in np.unique(size[a]):
                    of = np.flatnonzero(size[a] == d)
                    x, y = (flat[start[k[of]][:, None] + np.arange(d)] for k in (a, b))
                    cosine = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
                    got.append((a[of[cosine >= threshold]], b[of[cosine >= threshold]]))
            if got and sum(len(a) for a, _ in got):
                a, b = (np.concatenate(c) for c in zip(*got, strict=True))
                nodes, at = np.unique(np.concatenate([rep[a], rep[b]]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([copies[b], copies[a]])).astype(np.int64)
                node, root = stars(rep[a], rep[b])
                to = dict(zip(node.tolist(), root.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(sums), pa.array([to.get(i, i) for i in nodes.tolist()], pa.int64())], ["rep", "links", "root"])

    found = cut(met.repartition("bucket").sortWithinPartitions("bucket", "rep").mapInArrow(compare, "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    of_rep = reps.select("k1", "k2", "rep", "least_id", "copies").join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    of_rep = cut(of_rep.select("k1", "k2", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("group")), "classes")
    names = of_rep.groupBy("group").agg(F.min("least_id").alias("component_id"))
    of_rep = of_rep.join(names, "group").select("k1", "k2", "n_links", "component_id")
    lone = keyed.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good.select("vec_id", "k1", "k2").join(of_rep, ["k1", "k2"]).select("vec_id", "n_links", "component_id").unionByName(lone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
