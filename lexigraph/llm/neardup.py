"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set holds its distinct word shingles.  Documents branch on selected
minwise tokens: a node is a path of (coordinate, minimum) choices, `trees`
independent trees choose `branch` coordinates at the root and two at each inner
node, and a node of at most `leaf` documents is compared exhaustively, on full
sets.  A pair of similarity s misses all root nodes with probability
(1 - s) ** (trees * branch), far below one in a billion at 0.8.

A large root node holds documents that agree in something.  At first each
document goes to two of its large nodes alone (its largest and its smallest),
which are dealt to blocks of about `leaf` documents, and the node's `leaders` (the
first documents by hash, and those with the most frequent minima) are compared
with every block.  That links most of what is alike, but not all, so all large
root nodes whose members then are in several components are gone through.  Near
members share most of their nodes: what isn't in the largest component of its
nodes is compared with that component, whole and once, where this moves no
more rows than the nodes have.  The other nodes branch on while that makes
fewer pairs, and what stays is compared in all pairs of blocks but those inside
the node's largest component; nodes with the same largest component are joined
into one where that moves fewer rows.  So every two members of a large root node
are compared there, are linked already, or branch on; a pair of similarity 0.8 is
in none of a root's branches (or not in that root) with probability 0.25 at most.

Documents with one set are one representative; leaves with the same members,
as other trees find them, are compared once; a leaf's links leave it as a star.

Texts go only to comparisons that can link them.  A linked pair's sizes lie
within its similarity (exactly so), and it has 8 of the 32 minima in common, but
for one pair of similarity 0.8 in 1e11.  A group falls into the parts that such
pairs connect; parts that several groups have are compared once, on full sets.

Cases: null and empty texts, and blank ones, have empty sets and link with
nothing; fewer words than a shingle make one shingle of all; rows with one
doc_id and different sets are linked each by its own text, and groups are named
by their smallest doc_id; a null doc_id links with nothing and is kept, with
component null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, cut, groups, whole_runs
from .components import components, stars

COORDINATES = 32
_RNG = np.random.default_rng(20)
MULTIPLIERS = _RNG.integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RNG.integers(1, 1 << 63, COORDINATES, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    if len(h) < words:
        acc = np.full(1, len(h), np.uint64)
        for x in h:
            acc = _mixed(acc * np.uint64(0x100000001B3) + x)
        return acc
    n = len(h) - words + 1
    acc = np.full(n, words, np.uint64)
    for k in range(words):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    return np.unique(_mixed(acc))


def _sum_of(shingles: np.ndarray) -> int:
    """h1 of one set."""
    return int(np.add.reduce(_mixed(shingles)).view(np.int64))


def sketches(documents: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, h1 and h2 (the set), mins (its minimum on each coordinate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            sets = [shingle_set(t, words) for t in texts]
            sizes = np.array([len(s) for s in sets])
            some = np.flatnonzero(sizes)
            h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            mins = np.zeros((len(sets), COORDINATES), np.uint64)
            if len(some):
                every = np.concatenate([sets[i] for i in some])
                starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                h1[some] = np.add.reduceat(_mixed(every), starts)
                h2[some] = np.bitwise_xor.reduceat(_mixed(every * np.uint64(0xC2B2AE3D27D4EB4F)), starts)
                for k in range(COORDINATES):
                    mins[some, k] = np.minimum.reduceat(every * MULTIPLIERS[k] + OFFSETS[k], starts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(sizes.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(list(mins.view(np.int64)), pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_shingles", "h1", "h2", "mins"])

    return documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, mins array<long>")


def roots_of(trees: int, branch: int) -> Column:
    """The root nodes of a row's mins."""
    return F.transform(F.sequence(F.lit(0), F.lit(trees * branch - 1)), lambda i: F.xxhash64(i, F.element_at("mins", i + 1)))


def branches(nodes: str) -> Column:
    """parent, node: the nodes below each of a row's nodes that its minima choose."""
    pick = lambda node, k: F.pmod(F.xxhash64(node, F.lit(k)), F.lit(COORDINATES)).cast("int") + 1
    below = lambda node: F.array(*(F.struct(node.alias("parent"), F.xxhash64(node, pick(node, k), F.element_at("mins", pick(node, k))).alias("node")) for k in (1, 2)))
    return F.array_distinct(F.flatten(F.transform(nodes, below)))


def members_of(rows: DataFrame) -> DataFrame:
    """leaf, members: the distinct groups of two representatives or more.  rows: node, rep."""
    members = rows.groupBy("node").agg(F.sort_array(F.collect_set("rep")).alias("members")).where(F.size("members") > 1)
    return members.select("members").distinct().select(F.xxhash64("members").alias("leaf"), "members")


def agreeing(percent: int) -> int:
    """How many minima a linked pair has in common; one in 1e11 of those just similar enough has fewer."""
    below, least = 0.0, 0
    while least < COORDINATES:
        below += comb(COORDINATES, least) * (percent / 100) ** least * (1 - percent / 100) ** (COORDINATES - least)
        if below > 1e-11:
            break
        least += 1
    return least


def likely_parts(sizes: np.ndarray, signatures: np.ndarray, percent: int) -> list[np.ndarray]:
    """Places in a group, by part: those that pairs of fitting sizes and enough equal minima connect."""
    fit = 100 * np.minimum(sizes[:, None], sizes) >= percent * np.maximum(sizes[:, None], sizes)
    i, j = np.nonzero(np.triu(fit, 1))
    equal = np.zeros(len(i), np.int64)
    for k in range(COORDINATES):
        equal += signatures[i, k] == signatures[j, k]
    near = equal >= agreeing(percent)
    if not near.any():
        return []
    low = np.arange(len(sizes))
    node, least = stars(i[near], j[near])
    low[node] = least
    order = np.argsort(low, kind="stable")
    return [part for part in np.split(order, np.flatnonzero(np.diff(low[order])) + 1) if len(part) > 1]


def likely(groups_to_compare: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """leaf, members: the distinct parts of the groups that can hold links.  sets: rep, n_shingles, mins."""
    # seven bits of a minimum tell most apart, and equal ones never
    signature = F.transform("mins", lambda x: x.bitwiseAND(F.lit(127)).cast("tinyint")).alias("signature")
    rows = groups_to_compare.select("leaf", F.explode("members").alias("rep")).join(sets.select("rep", "n_shingles", signature), "rep")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in whole_runs(batches, "leaf"):
            leaf, rep, sizes = (np.concatenate([b.column(c).to_numpy() for b in runs]) for c in ("leaf", "rep", "n_shingles"))
            signatures = np.concatenate([b.column("signature").flatten().to_numpy() for b in runs]).reshape(-1, COORDINATES)
            bounds = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
            found = [np.sort(rep[lo + part]) for lo, hi in zip(bounds, bounds[1:], strict=False) for part in likely_parts(sizes[lo:hi], signatures[lo:hi], percent)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], ["members"])

    parts = rows.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(split, "members array<long>").distinct()
    return parts.select(F.xxhash64("members").alias("leaf"), "members")


def leaves(sets: DataFrame, roots: Column, leaf: int, leaders: int) -> DataFrame:
    """The groups of representatives to compare first.  sets: rep, mins."""
    level = cut(sets.select("rep", F.explode(roots).alias("node")), "nodes")
    met = cut(level.join(level.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "node"), "nodes")
    # of its large nodes a representative goes to its largest and its smallest one; rest() sees to the others
    at = F.struct("size", "node")
    each = met.groupBy("rep").agg(F.sum(F.floor(4 * F.log2("size"))).alias("heat"), F.max(F.when(F.col("size") > leaf, at)).alias("most"), F.min(F.when(F.col("size") > leaf, at)).alias("least"))
    chosen = each.where("most is not null").select("rep", "heat", F.explode(F.array_distinct(F.array("most.node", "least.node"))).alias("node"))
    chosen = cut(chosen, "chosen")
    parts = chosen.groupBy("node").agg(F.ceil(F.count("*") / leaf).cast("int").alias("parts"))
    place = F.xxhash64("node", "rep")
    first = lambda *order: chosen.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(*order))).where(F.col("r") <= leaders).select("node", "rep")
    heads = first(place, "rep").unionByName(first(F.desc("heat"), place, "rep")).distinct().join(parts, "node")
    block = lambda part: F.xxhash64("node", part, F.lit("block"))
    rows = met.where(F.col("size") <= leaf).select("node", "rep")
    rows = rows.unionByName(chosen.join(parts, "node").select(block(F.pmod(F.xxhash64("rep", "node"), "parts").cast("int")).alias("node"), "rep"))
    rows = rows.unionByName(heads.select("node", "rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(block(F.col("part")).alias("node"), "rep"))
    return members_of(rows)


def rest(parts: DataFrame, sets: DataFrame, roots: Column, leaf: int, block: int, further: int = 7) -> DataFrame | None:
    """Groups where any two members of a large node meet that are in different components, or below it; None without such nodes.

    parts: node, component of representatives linked so far; sets: rep, mins.
    """
    label = parts.select(F.col("node").alias("rep"), "component")
    # one row of each representative is joined with its component, and only counts leave the rows of a node
    named = sets.join(label, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"), roots.alias("nodes"))
    named = cut(named, "named")
    rows = named.select("rep", "component", F.explode("nodes").alias("node"))

    def mixed(rows: DataFrame) -> DataFrame:
        """node, main (its largest component), main_n, size of the nodes with several components."""
        each = rows.groupBy("node", "component").agg(F.count("*").alias("n"))
        top = each.groupBy("node").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size")).where("top.n < size")
        return top.select("node", F.col("top.component").alias("main"), F.col("top.n").alias("main_n"), "size")

    def apart(rows: DataFrame) -> DataFrame:
        """Rows of the nodes with several components, with these columns."""
        return cut(rows.join(mixed(rows), "node"), "apart")

    def count(n: Column) -> Column:
        return F.ceil(n / block).cast("int")

    def moved(size: Column, main: Column) -> Column:
        """Rows that the pairs of blocks of a node move."""
        return main * count(size - main) + (size - main) * (count(main) + count(size - main) - 1)

    columns = ("node", "rep", "component", "main", "main_n", "size")

    def merged(rows: DataFrame) -> DataFrame:
        """Nodes with one largest component are one node where that moves fewer rows."""
        rows = rows.withColumn("all", F.xxhash64("main"))
        whole = apart(rows.select(F.col("all").alias("node"), "rep", "component").distinct())
        cost = lambda rows, key: rows.select(key, "node", "size", "main_n").distinct().groupBy(F.col(key).alias("all")).agg(F.sum(moved(F.col("size"), F.col("main_n"))).alias("cost"))
        fewer = cut(cost(whole, "node").join(cost(rows, "all").withColumnRenamed("cost", "before"), "all").where("cost < before").select("all"), "fewer")
        return rows.join(fewer, "all", "left_anti").select(*columns).unionByName(whole.join(fewer, F.col("node") == F.col("all"), "left_semi").select(*columns))

    nodes = cut(mixed(rows).where(F.col("size") > leaf), "mixed")
    if nodes.isEmpty():
        return None
    # all that isn't in the largest component of its nodes meets that whole component, where this moves no more rows than the nodes have
    others = cut(rows.join(nodes.select("node", "main"), "node").where("component != main").select("main", "rep", "component").distinct(), "others")
    mains = named.groupBy(F.col("component").alias("main")).agg(F.count("*").alias("main_n"))
    whole = nodes.groupBy("main").agg(F.sum("size").alias("rows")).join(others.groupBy("main").agg(F.count("*").alias("others")), "main").join(mains, "main")
    whole = whole.withColumn("size", F.col("main_n") + F.col("others")).where(moved(F.col("size"), F.col("main_n")) <= F.col("rows"))
    whole = cut(whole.select(F.xxhash64("main", F.lit("whole")).alias("node"), "main", "main_n", "size"), "whole")
    inner = named.select("rep", "component", F.col("component").alias("main")).join(whole, "main").select(*columns)
    met = inner.unionByName(others.join(whole, "main").select(*columns))
    level = cut(rows.join(nodes.join(whole, "main", "left_anti"), "node"), "apart")
    ready = []
    for _ in range(further):
        ready.append(level.where(F.col("size") <= block))
        wide = level.where(F.col("size") > block)
        if wide.isEmpty():
            level = wide
            break
        held = wide.groupBy("rep", "component").agg(F.collect_list("node").alias("nodes")).join(sets, "rep")
        below = apart(held.select("rep", "component", F.explode(branches("nodes")).alias("b")).select("rep", "component", "b.parent", "b.node"))
        # rows times those outside the main component: what the pairs of blocks of a node cost, in its branches and in itself
        after = below.groupBy("parent").agg(F.sum(F.col("size") - F.col("main_n")).alias("after"))
        stay = wide.select("node", "size", "main_n").distinct().join(after.withColumnRenamed("parent", "node"), "node", "left").where(2 * F.coalesce("after", F.lit(0)) >= F.col("size") * (F.col("size") - F.col("main_n"))).select("node")
        stay = cut(stay, "stay")
        ready.append(wide.join(stay, "node", "left_semi"))
        level = below.join(stay.withColumnRenamed("node", "parent"), "parent", "left_anti")
    rows = level.select(*columns)
    for more in ready:
        rows = rows.unionByName(more.select(*columns))
    rows = merged(cut(rows, "large")).unionByName(met)
    rows = rows.withColumn("inner", F.col("component") == F.col("main")).withColumn("mains", count(F.col("main_n"))).withColumn("parts", F.col("mains") + count(F.col("size") - F.col("main_n")))
    own = F.when(F.col("inner"), F.pmod(F.xxhash64("rep", "node"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("rep", "node"), F.col("parts") - F.col("mains"))).cast("int")
    # a block meets all others but that two of the main component don't meet; its own members meet on the way
    others = F.sequence(F.when(F.col("inner"), F.col("mains")).otherwise(F.lit(0)), F.col("parts") - 1)
    rows = rows.withColumn("own", own).select("node", "rep", "own", F.explode(others).alias("other")).where("own != other")
    return members_of(rows.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "rep"))


def linked_pairs(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j) with 100 * intersection >= percent * union, by exact counts."""
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.append(True, every[1:] != every[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    common = np.zeros((len(sets), len(sets)))
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 1 << 14):
        part = (column >= lo) & (column < lo + (1 << 14))
        table = np.zeros((len(sets), 1 << 14), np.float32)
        table[owner[part], column[part] - lo] = 1
        common += table @ table.T
    common = np.rint(common).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    return np.nonzero(np.triu((100 * common >= percent * union) & (union > 0), 1))


def links_of(documents: DataFrame, sets: DataFrame, groups_to_compare: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b: the links inside each group, as stars.  groups_to_compare: leaf, members."""
    wanted = groups_to_compare.select("leaf", F.explode("members").alias("rep")).join(sets.select("rep", "doc_id", "h1"), "rep")
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "rep", "leaf")).alias("wanted"))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A representative's text for each of its leaves; of rows with one doc_id, one that has the representative's set."""
        done: set[int] = set()
        names = ["leaf", "rep", "text"]
        for whole in batches:
            for at in range(0, len(whole), 200):
                batch = whole.slice(at, 200)
                leaf, rep, texts = [], [], []
                for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                    open_at = [w for w in wanted if w["rep"] not in done]
                    if not open_at:
                        continue
                    h1 = _sum_of(shingle_set((text or "").encode(), words))
                    own = [w for w in open_at if w["h1"] == h1]
                    done.update(w["rep"] for w in own)
                    leaf += [w["leaf"] for w in own]
                    rep += [w["rep"] for w in own]
                    texts += [text] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(rep, pa.int64()), pa.array(texts, pa.string())], names)

    texts = documents.select("doc_id", "text").join(wanted, "doc_id").select("text", "wanted").mapInArrow(ship, "leaf long, rep long, text string")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, rows in groups(batches, "leaf"):
            own = list({r["rep"]: shingle_set((r["text"] or "").encode(), words) for r in rows}.items())
            if len(own) < 2:
                continue
            ids = np.array([r for r, _ in own])
            i, j = linked_pairs([x for _, x in own], percent)
            x, y = stars(ids[i], ids[j]) if len(i) else ([], [])
            a.extend(x)
            b.extend(y)
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return texts.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(compare, "a long, b long")


def near_texts(documents: DataFrame, words: int = 5, percent: int = 80, trees: int = 8, branch: int = 2, leaf: int = 48, leaders: int = 6, block: int = 192) -> DataFrame:
    """doc_id, text_hash, n_shingles, group, component_id: a row for every document.  Rows of one group are linked; null: linked with nothing."""
    marks = cut(sketches(documents, words), "sketches")
    some = marks.where("n_shingles > 0 and doc_id is not null")
    sets = cut(some.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "n_shingles", "mins")).alias("m")).select("h1", "h2", F.monotonically_increasing_id().alias("rep"), "m.*"), "sets")
    roots = roots_of(trees, branch)
    first = leaves(sets.select("rep", "mins"), roots, leaf, leaders)
    parts = components(links_of(documents, sets, cut(likely(first, sets, percent), "leaves"), words, percent))
    more = rest(parts, sets.select("rep", "mins"), roots, leaf, block)
    if more is not None:
        links = links_of(documents, sets, cut(likely(more, sets, percent), "leaves"), words, percent)
        parts = components(links.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    of_set = cut(sets.select("h1", "h2", "rep", "doc_id").join(parts, F.col("rep") == F.col("node"), "left").select("h1", "h2", "doc_id", F.coalesce("component", "rep").alias("group")), "groups")
    names = of_set.groupBy("group").agg(F.min("doc_id").alias("set_component"))
    of_set = cut(of_set.drop("doc_id").join(names, "group"), "classes")
    out = marks.select("doc_id", "text_hash", "n_shingles", "h1", "h2").join(of_set, ["h1", "h2"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", "text_hash", "n_shingles", F.when(linked, F.col("group")).alias("group"), F.when(linked, F.col("set_component")).otherwise(F.col("doc_id")).alias("component_id"))


def near_documents(documents: DataFrame, words: int = 5, **options: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for every document.  options: as of near_texts."""
    return near_texts(documents, words, **options).select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
