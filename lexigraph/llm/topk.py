"""Exact top-k search by inner product: a ball tree for each shard, searched by branch and bound.

Vectors become integers floor(scale * x).  Rows are dealt to shards of vectors that
lie on the same sides of the first principal axes (of a sample of at most `sample`
vectors, by hash); a cell above `shard_rows` rows is split by hash.  A task builds a
ball tree over its shard and searches it best node first: a node with centre c and
radius r holds no inner product above q.c + |q| r, and a node below the current kth
score is left out.  A query first searches the shard it lies in; the kth score found
there is shared with its searches of other shards, which start from it.  Each shard's
own centre and radius give a bound too, and a query goes only to shards whose bound
reaches its kth score.

Queries are dealt in blocks of `query_block`, shards' centres in blocks of
`centre_block`, and a task has one of each, so no task or broadcast grows with their
number.  A shard's tree is built once for each block of queries.

Cases: vectors that are null or hold null or non-finite components take no
part; vectors of another length than the query's are no candidates; a query's own row
is no candidate of its own, but other rows with its id are, and each row of
a repeated id is a query and a candidate of its own; fewer than k candidates give fewer rows; ties go to the
smaller vec_id; null vec_id takes no part; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LEAF = 64


class BallTree:
    def __init__(self, points: np.ndarray, ids: np.ndarray, keys: np.ndarray):
        self.order = np.arange(len(points))
        self.points = points
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []  # centre, radius, from, to, children
        self._build(0, len(points))
        self.points, self.ids, self.keys = points[self.order], ids[self.order], keys[self.order]

    def _build(self, lo: int, hi: int) -> int:
        own = self.points[self.order[lo:hi]].astype(float)
        centre = own.mean(0)
        away = ((own - centre) ** 2).sum(1)
        me = len(self.nodes)
        radius = float(np.sqrt(away.max()))
        self.nodes.append((centre, radius, lo, hi, -1, -1))
        if hi - lo > LEAF and radius > 0:
            one = own[away.argmax()]
            two = own[((own - one) ** 2).sum(1).argmax()]
            side = np.argsort(own @ (two - one), kind="stable")
            self.order[lo:hi] = self.order[lo:hi][side]
            mid = (lo + hi) // 2
            left, right = self._build(lo, mid), self._build(mid, hi)
            self.nodes[me] = (centre, radius, lo, hi, left, right)
        return me

    def search(self, query: np.ndarray, own: int, k: int, kth: int | None) -> list[tuple[int, int, int]]:
        """(score, id, key), best first: all but the row `own` that could be among the k best given a kth score found elsewhere."""
        length = float(np.sqrt((query.astype(float) ** 2).sum()))
        qf = query.astype(float)

        def bound(node: int) -> float:
            centre, radius, *_ = self.nodes[node]
            b = float(centre @ qf) + length * radius
            return b + abs(b) * 1e-9 + 1e-6

        best: list[tuple[int, int, int]] = []  # (score, -id, -key), least first
        heap = [(-bound(0), 0)]
        while heap:
            b, node = heapq.heappop(heap)
            least = best[0][0] if len(best) == k else None
            floor = max((x for x in (least, kth) if x is not None), default=None)
            if floor is not None and -b < floor:
                break
            _, _, lo, hi, left, right = self.nodes[node]
            if left >= 0:
                heapq.heappush(heap, (-bound(left), left))
                heapq.heappush(heap, (-bound(right), right))
                continue
            scores = self.points[lo:hi] @ query
            for i in np.flatnonzero(scores >= floor) if floor is not None else range(hi - lo):
                item = int(scores[i]), -int(self.ids[lo + i]), -int(self.keys[lo + i])
                if -item[2] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(s, -i, -key) for s, i, key in sorted(best, reverse=True)]


def search_shards(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, query_key, vec_id, key, score: the k best of each (shard, block) group."""

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int, int]] = []
        if len(rows) and len(queries):
            lengths = rows["v"].map(len)
            for n in sorted(set(queries["q"].map(len))):
                own = rows[lengths == n]
                if not len(own):
                    continue
                tree = BallTree(np.stack(own["v"].to_list()).astype(np.int64).reshape(len(own), n), own["vec_id"].to_numpy(np.int64), own["key"].to_numpy(np.int64))
                mine = queries[queries["q"].map(len) == n]
                for q, own_key, v, kth in zip(mine["query_id"], mine["query_key"], mine["q"], mine["kth"], strict=True):
                    out += [(q, own_key, i, key, s) for s, i, key in tree.search(np.asarray(v, np.int64), own_key, k, None if pd.isna(kth) else int(kth))]
        return pd.DataFrame(out, columns=["query_id", "query_key", "vec_id", "key", "score"]).astype("int64")

    return rows.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(run, "query_id long, query_key long, vec_id long, key long, score long")


def cells(rows: DataFrame, bits: int, sample: int) -> DataFrame:
    """Rows with their cell: their length and their sides of the first `bits` principal axes of their length."""
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect() if bits else []
    axes = {}
    for d in {len(r[0]) for r in chosen}:
        x = np.array([r[0] for r in chosen if len(r[0]) == d], float)
        mean = x.mean(0)
        axes[d] = mean, np.linalg.eigh((x - mean).T @ (x - mean))[1][:, ::-1][:, :bits]
    shared = rows.sparkSession.sparkContext.broadcast(axes)

    @F.pandas_udf("long")
    def cell(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors), np.int64)
        lengths = vectors.map(len).to_numpy()
        for d in np.unique(lengths):
            own = np.flatnonzero(lengths == d)
            code = np.zeros(len(own), np.int64)
            if d in shared.value:
                mean, turn = shared.value[d]
                code = ((np.stack(vectors.iloc[own].to_list()) - mean) @ turn >= 0) @ (1 << np.arange(turn.shape[1]))
            out[own] = code * 65536 + d
        return pd.Series(out)

    return rows.withColumn("cell", cell("v"))


def centres(rows: DataFrame) -> DataFrame:
    """shard, centre, radius."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(own["v"].to_list()).astype(float)
        centre = x.mean(0)
        return pd.DataFrame({"shard": own["shard"].iloc[:1], "centre": [centre.tolist()], "radius": [float(np.sqrt(((x - centre) ** 2).sum(1).max()))]})

    return rows.groupBy("shard").applyInPandas(run, "shard long, centre array<double>, radius double")


def reached(queries: DataFrame, balls: DataFrame) -> DataFrame:
    """query_id, query_key, q, kth, block, shard: the shards, but for its own, whose bound reaches a query's kth score.  Both sides: centre_block; queries: block."""

    def run(queries: pd.DataFrame, balls: pd.DataFrame) -> pd.DataFrame:
        parts = []
        lengths, wide = queries["q"].map(len).to_numpy(), balls["centre"].map(len).to_numpy()
        for d in np.unique(lengths):
            some = balls[wide == d]
            if not len(some):
                continue
            c, r, shard = np.stack(some["centre"].to_list()), some["radius"].to_numpy(), some["shard"].to_numpy()
            own = queries[lengths == d]
            for lo in range(0, len(own), 256):
                part = own.iloc[lo : lo + 256]
                q = np.stack(part["q"].to_list()).astype(float)
                bound = q @ c.T + np.sqrt((q * q).sum(1))[:, None] * r
                least = part["kth"].to_numpy(float)[:, None]
                i, j = np.nonzero((np.isnan(least) | (bound + np.abs(bound) * 1e-9 + 1e-6 >= least)) & (part["home"].to_numpy()[:, None] != shard))
                parts.append(part.iloc[i][["query_id", "query_key", "q", "kth", "block"]].assign(shard=shard[j]))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["query_id", "query_key", "q", "kth", "block", "shard"])

    return queries.groupBy("centre_block", "block").cogroup(balls.groupBy("centre_block", "block")).applyInPandas(run, "query_id long, query_key long, q array<long>, kth long, block int, shard long")


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, shard_rows: int = 8192, query_block: int = 4096, centre_block: int = 8192, sample: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score for the queries, rows whose vec_id is divisible by `every`."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(wide, lambda x: F.floor(x * scale))
    rows = vectors.where(sound).select("vec_id", v.alias("v"), F.monotonically_increasing_id().alias("key"))
    rows = cut(rows, "vectors")
    n = rows.count()
    placed = cut(cells(rows, max(0, (-(-n // shard_rows) - 1).bit_length()), sample), "cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))
    rows = cut(placed.join(sizes, "cell").select("vec_id", "key", "v", F.xxhash64("cell", F.pmod(F.xxhash64("key"), F.col("parts"))).alias("shard")), "shards")

    query_blocks, spread = max(1, -(-n // (every * query_block))), lambda to: F.explode(F.sequence(F.lit(0), F.lit(to - 1)))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("key").alias("query_key"), F.col("v").alias("q"), F.col("shard").alias("home"), F.pmod(F.xxhash64("key", F.lit("block")), F.lit(query_blocks)).cast("int").alias("block"))
    every_block = rows.withColumn("block", spread(query_blocks))
    home = cut(search_shards(every_block, queries.withColumn("shard", F.col("home")).withColumn("kth", F.lit(None).cast("long")), k), "home")
    kth = home.groupBy("query_key").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))

    centre_blocks = max(1, -(-n // (shard_rows * centre_block)))
    balls = centres(rows).withColumn("centre_block", F.pmod(F.xxhash64("shard"), F.lit(centre_blocks)).cast("int")).withColumn("block", spread(query_blocks))
    away = reached(queries.join(kth, "query_key", "left").withColumn("centre_block", spread(centre_blocks)), balls)
    found = home.unionByName(search_shards(every_block, away, k))
    rank = F.row_number().over(Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id", "key"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
