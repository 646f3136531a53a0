"""Merkle manifest of a dataset: a tree of SHA-256 hashes whose parents keep their hash states.

Leaves.  A row's leaf is the hash of its columns, each `-` if null, else the
number of its UTF-8 bytes, a colon and the value.  Hashes are made in the JVM,
texts go nowhere.

Trees.  Each source has a tree over its leaves in the order of doc_id, and one
tree stands over the sources' roots; in both, `FAN` consecutive nodes become
the hash of their hex digests while more than one remains.  A row's place in
its tree comes from one range sort of (source, doc_id, leaf) and prefix sums
over the sorted partitions, so a hot source is spread over all tasks.

States.  A parent is hashed child by child and retains a copy of the hash state
before each child's slot.  Replacing a child resumes the copy before its slot
with the replacement and the siblings to the right of it; what stands to the
left is never hashed again.  States can't leave a process, so the task that
folds a chunk of `CHUNK` rows builds the parents in the chunk, and for each
parent above it the one state before the chunk's slot, once for all its rows.

Two passes: upward a chunk of nodes becomes one node, until each tree is one
node; downward each chunk gets the path above it (a slot and the children of
each parent, at most `FAN` digests a level), so no task sees a whole level.

Cases: a null doc_id counts as `-` in its leaf, comes first in its source and is
not among the rows to tamper with; a null source is a source of its own and
the first; empty texts are values of 0 bytes; repeated rows are leaves each
(equal ones are in no particular order, which changes nothing); a source of one row
has its leaf as its root; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, wide

FAN = 16
#: Nodes that one group holds: two levels of the tree.
CHUNK = FAN * FAN
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<slot:int,nodes:string>>"


def leaf_hash(**other: Column) -> Column:
    """The leaf of a row; columns may be replaced by name."""
    values = [other.get(c, F.col(c)).cast("string") for c in COLUMNS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def tampered(documents: DataFrame, modulus: int = 5) -> DataFrame:
    """doc_id, source, leaf, changed: the leaf after lower-casing A-Z in the texts of rows whose crc32 of doc_id the modulus divides, else null."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0
    return documents.select("doc_id", "source", leaf_hash().alias("leaf"), F.when(hit, leaf_hash(text=F.translate("text", UPPER, LOWER))).alias("changed"))


def ranked(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with `at` (place in their key, from 0) and `n` (rows of the key)."""
    by = [key, *order, "__tie"]
    once = cut(rows, "merkle-rows").withColumn("__tie", F.monotonically_increasing_id())
    placed = once.repartitionByRange(wide(rows), *by).sortWithinPartitions(*by).drop("__tie").withColumn("__row", F.monotonically_increasing_id())
    placed = cut(placed, "merkle-sorted").withColumn("__part", F.shiftright("__row", 33))
    runs = placed.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__p")).agg(F.min("__row").alias("first"), F.count("*").alias("rows"))
    own = Window.partitionBy("__key")
    before = F.coalesce(F.sum("rows").over(own.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each partition and key in it; written, so that Spark knows its size
    runs = cut(runs.select("__key", "__p", (before - F.col("first")).alias("shift"), F.sum("rows").over(own).alias("n")), "merkle-runs")
    met = placed.join(runs, (F.col(key) == F.col("__key")) & (F.col("__part") == F.col("__p")))
    return met.select(*rows.columns, (F.col("__row") + F.col("shift")).alias("at"), "n")


class Parent:
    """A hashed node: its children's digests in a row, and a copy of the hash state before each of their slots."""

    def __init__(self, children: list[str]):
        self.nodes, self.states, state = "".join(children), [], hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def step(self, slot: int) -> Step:
        return Step(self.nodes, slot, self.states[slot])


class Step:
    """The way from a child to its parent: the state before its slot, and its siblings."""

    def __init__(self, nodes: str, slot: int, state=None):
        raw = nodes.encode()
        left, self.right = raw[: 64 * slot], raw[64 * (slot + 1) :]
        self.siblings, self.state = left + self.right, state or hashlib.sha256(left)

    def fold(self, child: str) -> str:
        state = self.state.copy()
        state.update(child.encode() + self.right)
        return state.hexdigest()


def levels(nodes: list[str], n: int) -> list[list[Parent]]:
    """The levels of parents over a chunk of a tree that has n nodes on the chunk's level."""
    out: list[list[Parent]] = []
    for _ in range(0 if n <= 1 else 1 if n <= FAN else 2):
        out.append([Parent(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)])
        nodes = [p.digest for p in out[-1]]
    return out


def _chunk() -> Column:
    return F.floor(F.col("at") / CHUNK).cast("long").alias("chunk")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Nodes (key, at, n, digest), chunks of them as nodes, and so on, up to one node a key."""

    def top(own: pa.Table) -> pa.Table:
        own = own.sort_by("at")
        n, digests = own["n"][0].as_py(), own["digest"].to_pylist()
        parents = levels(digests, n)
        digest = parents[-1][0].digest if parents else digests[0]
        return pa.table({"key": own["key"][:1], "at": own["chunk"][:1], "n": pa.array([-(-n // CHUNK)], pa.int64()), "digest": pa.array([digest], pa.string())})

    out, small = [nodes], ("key", "at", "n", "digest")
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        made = out[-1].select(*small, _chunk()).groupBy("key", "chunk").applyInArrow(top, "key string, at long, n long, digest string")
        out.append(cut(made, "merkle-nodes"))
        most = -(-most // CHUNK)
    return out


def descend(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """key, at, path of nodes, from the paths (key, at, path) of their chunks."""

    def extend(key: tuple, own: pa.Table, upper: pa.Table) -> pa.Table:
        own = own.sort_by("at")
        at, path = own["at"].to_pylist(), upper["path"][0].as_py()
        parents = levels(own["digest"].to_pylist(), own["n"][0].as_py())
        paths = []
        for k in range(len(at)):
            steps = [{"slot": k // FAN**i % FAN, "nodes": level[k // FAN ** (i + 1)].nodes} for i, level in enumerate(parents)]
            paths.append(steps + path)
        kind = pa.list_(pa.struct([("slot", pa.int32()), ("nodes", pa.string())]))
        return pa.table({"key": own["key"], "at": own["at"], "path": pa.array(paths, kind)})

    own = nodes.select("key", "at", "n", "digest", _chunk()).groupBy("key", "chunk")
    upper = above.select("key", F.col("at").alias("chunk"), "path").groupBy("key", "chunk")
    return cut(own.cogroup(upper).applyInArrow(extend, f"key string, at long, path {PATH}"), "merkle-paths")


def fold(leaves: DataFrame, above: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root of leaves, from their chunks' paths (key, at, path, subroot, root)."""

    def run(key: tuple, own: pa.Table, upper: pa.Table) -> pa.Table:
        own = own.sort_by("at")
        digests, changed = own["digest"].to_pylist(), own["changed"].to_pylist()
        steps_above = [Step(x["nodes"], x["slot"]) for x in upper["path"][0].as_py()]
        parents = levels(digests, own["n"][0].as_py())
        proofs, folded = [], []
        for k, leaf in enumerate(digests):
            steps = [level[k // FAN ** (i + 1)].step(k // FAN**i % FAN) for i, level in enumerate(parents)] + steps_above
            proofs.append(hashlib.sha256(b"".join([s.siblings for s in steps])).hexdigest())
            value = changed[k] or leaf
            for s in steps:
                value = s.fold(value)
            folded.append(value)
        same = lambda name: pa.array([upper[name][0].as_py()] * len(digests), pa.string())
        return pa.table({"doc_id": own["doc_id"], "leaf": own["digest"], "subroot": same("subroot"), "root": same("root"), "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string())})

    own = leaves.select("key", "at", "n", "digest", "doc_id", "changed", _chunk()).groupBy("key", "chunk")
    upper = above.select("key", F.col("at").alias("chunk"), "path", "subroot", "root").groupBy("key", "chunk")
    return own.cogroup(upper).applyInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def manifest(leaves: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of leaves (doc_id, source, leaf, changed).

    folded_root is recomputed from `changed` where that isn't null, else from the leaf, with the original siblings.
    """
    # a key that is never null and orders as the sources do, null first
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), "source"))
    rows = leaves.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("leaf").alias("digest"), "changed")
    trees = climb(ranked(rows, "key", "doc_id", "digest"))
    # one tree over the roots of all sources
    roots = ranked(trees[-1].select(F.lit("").alias("key"), F.col("key").alias("of"), "digest"), "key", "of")
    over = climb(roots)
    paths = over[-1].select("key", "at", F.array().cast(PATH).alias("path"))
    for nodes in over[-2::-1]:
        paths = descend(nodes, paths)
    root = over[-1].select(F.col("digest").alias("root"), F.col("key").alias("k"))
    top = roots.join(paths.withColumnRenamed("key", "k"), "at").join(root, "k").select(F.col("of").alias("key"), F.lit(0).cast("long").alias("at"), "path", F.col("digest").alias("subroot"), "root")
    paths, ends = top.select("key", "at", "path"), top.select("key", "subroot", "root")
    for nodes in trees[-2:0:-1]:
        paths = descend(nodes, paths)
    out = fold(trees[0], cut(paths.join(ends, "key"), "merkle-upper"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
