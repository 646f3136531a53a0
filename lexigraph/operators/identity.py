"""Nodes by identity: hashes as ids, paths over child hashes, and texts resolved from them.

Tokens hash their flavour and text; terms, sentences and texts hash the path of their children's hashes and their
flavour, so equal words of different flavours are different nodes.  The modifiers of a term (all but its
last word) are in no order.  Nodes with one hash are one node: their counts are added, and the first text (or the path
that reads first) stands for all.  The hash of a word mixes its last letters weakly, so that some pairs of short words are such
nodes (`▁eash` and `▁eauê`); golden values fix the function.

Texts are resolved level by level: paths whose children all have texts get theirs by a join, until no path is
left or nothing changes (children that are nowhere read `__unknown__`).  Where all nodes come from the same texts, `shown_terms` and
`shown_texts` give the same inside a text's row: only words whose hash another word has read otherwise than they stand there, and these are few
(if they are more than `ALIKE`, the texts are resolved level by level).  Of different paths with one hash, which chance makes
once in 2 ** 64 pairs but for modifiers in another order, the first text stands for all there.

Nodes: hash, name, text (of tokens), path (of others), word_cnt, text_cnt.

Cases: null and empty texts have no nodes; a null doc_id is a text of its own; repeated rows are counted each, as
texts too; a path to itself stays unresolved and ends the loop; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from lexigraph.functions import hashing
from lexigraph.functions import rows as W
from lexigraph.functions import text as T
from lexigraph.operators import build as B
from lexigraph.tables import cut

ENDS = (".", "?", "!")
UNKNOWN = "__unknown__"


def path_hashes(paths: list[list[int]], name: str) -> np.ndarray:
    """Hashes of path nodes of a flavour: the path in normal order, and the flavour behind it."""
    rows = []
    for p in paths:
        row = np.array(p, np.int64).view(np.uint64)
        if name == "cont":
            row = np.sort(row)
        elif name == "term":
            row = np.r_[np.sort(row[:-1]), row[-1:]]
        rows.append(np.r_[row, np.uint64(B.NODE_FLAVOURS[name])])
    return hashing.fold(rows)


@F.pandas_udf(ArrayType(LongType()))
def word_hashes(words: pd.Series) -> pd.Series:
    """Hashes of the word tokens of each row; a batch's distinct words are hashed once."""
    distinct = sorted({w for ws in words for w in ws})
    known = dict(zip(distinct, hashing.hash_texts([f"__word_token_{w}__" for w in distinct]).view(np.int64).tolist(), strict=True)) if distinct else {}
    return words.map(lambda ws: [known[w] for w in ws])


@F.pandas_udf(LongType())
def path_hash(paths: pd.Series, names: pd.Series) -> pd.Series:
    out = np.zeros(len(paths), np.uint64)
    for name in names.unique():
        own = np.flatnonzero((names == name).to_numpy())
        out[own] = path_hashes([list(paths.iloc[k]) for k in own], name)
    return pd.Series(out.view(np.int64))


@F.pandas_udf(ArrayType(StructType([StructField("lo", IntegerType()), StructField("hi", IntegerType())])))
def _runs(letters: pd.Series) -> pd.Series:
    """Places (from 1) of the terms in a text's tags: adjectives and nouns up to the last noun of their run."""
    return letters.map(lambda t: [{"lo": m.start() + 1, "hi": m.end()} for m in re.finditer("[JN]*N", t)])


def token_nodes(documents: DataFrame) -> DataFrame:
    found = B.word_nodes(documents).withColumn("hash", word_hashes(F.array("text"))[0])
    found = found.groupBy("hash", "name").agg(F.min("text").alias("text"), F.sum("word_cnt").alias("word_cnt"), F.sum("text_cnt").alias("text_cnt"))
    return found.select("hash", "name", "text", F.lit(None).cast("array<long>").alias("path"), "word_cnt", "text_cnt")


def _counted(rows: DataFrame) -> DataFrame:
    """Path nodes from rows (name, path, shown, row): how often, and in how many rows."""
    once = rows.withColumn("hash", path_hash("path", "name")).groupBy("hash", "name", "row").agg(F.count("*").alias("n"), F.min(F.struct("shown", "path")).alias("best"))
    nodes = once.groupBy("hash", "name").agg(F.sum("n").alias("word_cnt"), F.count("*").alias("text_cnt"), F.min("best").alias("best"))
    return nodes.select("hash", "name", F.lit(None).cast("string").alias("text"), F.col("best.path").alias("path"), "word_cnt", "text_cnt")


def _slices(first, last):
    """The words, and their hashes, of places (from 1) that two arrays give."""
    return F.zip_with(first, last, lambda a, b: F.struct(F.slice("w", a, b - a + 1).alias("w"), F.slice("h", a, b - a + 1).alias("h")))


def _hashed(documents: DataFrame) -> DataFrame:
    """row, w (words), h (their hashes) of texts with tokens."""
    rows = documents.select(F.monotonically_increasing_id().alias("row"), T.words().alias("w")).where(F.size("w") > 0)
    return rows.withColumn("h", word_hashes("w"))


def term_nodes(documents: DataFrame) -> DataFrame:
    rows = _hashed(documents)
    tags = F.expr(f"transform(transform(w, x -> {T.part_of_speech_sql('ltrim(\'▁\', x)')}), tag -> {T.LETTER})")
    rows = rows.withColumn("runs", _runs(F.array_join(tags, "")))
    runs = F.col("runs")
    each = rows.select("row", F.inline(_slices(F.transform(runs, lambda r: r["lo"]), F.transform(runs, lambda r: r["hi"]))))
    return _counted(each.select(F.lit("term").alias("name"), F.col("h").alias("path"), F.array_join("w", "").alias("shown"), "row"))


def sentence_nodes(documents: DataFrame) -> DataFrame:
    """Nodes of sentences over tokens, and of texts over sentences."""
    rows = _hashed(documents)
    size = F.size("w")
    stops = F.array_distinct(F.concat(F.filter(F.sequence(F.lit(1), size), lambda k: T.unmarked(F.element_at("w", k)).isin(*ENDS)), F.array(size)))
    rows = rows.withColumn("stop", stops)
    starts = F.concat(F.array(F.lit(1)), F.transform(F.slice("stop", 1, F.size("stop") - 1), lambda k: k + 1))
    each = rows.select("row", F.posexplode(_slices(starts, F.col("stop"))).alias("k", "s"))
    each = cut(each.select("row", "k", F.lit("sentence").alias("name"), F.col("s.h").alias("path"), F.array_join("s.w", "").alias("shown")), "sentences")
    whole = each.withColumn("hash", path_hash("path", "name")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "hash"))).alias("s"))
    texts = whole.select(F.lit("text").alias("name"), F.transform("s", lambda x: x["hash"]).alias("path"), F.lit("").alias("shown"), "row")
    return _counted(each.drop("k")).unionByName(_counted(texts))


def resolved(nodes: DataFrame, raw: bool = False, deepest: int = 16) -> DataFrame:
    """nodes with their texts; `raw` keeps the marks of white space."""
    known, rest = nodes.where("path is null").select("hash", "text"), nodes.where("path is not null")
    for _ in range(deepest):
        step = rest.select("hash", "name", F.posexplode("path").alias("k", "child")).join(known.select(F.col("hash").alias("child"), F.col("text").alias("part")), "child", "left")
        open_ = rest.select(F.col("hash").alias("child"), F.lit(True).alias("open"))
        step = step.join(open_, "child", "left")
        made = step.groupBy("hash", "name").agg(F.max(F.coalesce("open", F.lit(False))).alias("open"), F.array_sort(F.collect_list(F.struct("k", F.coalesce("part", F.lit(UNKNOWN)).alias("part")))).alias("p"))
        parts = F.transform("p", lambda x: x["part"])
        made = cut(made.where("not open").select("hash", F.when(F.col("name") == "cont", F.array_join(parts, "-")).otherwise(F.array_join(parts, "")).alias("text")), "resolved")
        if made.isEmpty():
            break
        known, rest = known.unionByName(made), cut(rest.join(made.select("hash"), "hash", "left_anti"), "unresolved")
    shown = F.col("r") if raw else F.trim(F.replace("r", F.lit("▁"), F.lit(" ")))
    return nodes.join(known.select("hash", F.col("text").alias("r")), "hash", "left").withColumn("text", shown).drop("r")


def token_paths(nodes: DataFrame, deepest: int = 16) -> DataFrame:
    """hash and tokens (hashes of word tokens) of path nodes whose tokens are all known."""
    known = nodes.where("path is null").select("hash", F.array("hash").alias("tokens"))
    rest, found = nodes.where("path is not null").select("hash", "path"), []
    for _ in range(deepest):
        step = rest.select("hash", F.size("path").alias("size"), F.posexplode("path").alias("k", "child")).join(known.withColumnRenamed("hash", "child"), "child")
        made = step.groupBy("hash", "size").agg(F.array_sort(F.collect_list(F.struct("k", "tokens"))).alias("t")).where(F.size("t") == F.col("size"))
        made = cut(made.select("hash", F.flatten(F.transform("t", lambda x: x["tokens"])).alias("tokens")), "token-paths")
        if made.isEmpty():
            break
        found.append(made)
        known, rest = known.unionByName(made), cut(rest.join(made.select("hash"), "hash", "left_anti"), "unresolved")
    return reduce(DataFrame.unionByName, found) if found else known.limit(0)


def keyed(nodes: DataFrame) -> DataFrame:
    """Nodes for flows, whose ids are hashes: text is the hash as text, label the text; homonyms stay apart."""
    return nodes.select(F.col("hash").cast("string").alias("text"), "name", F.col("text").alias("label"), "word_cnt", "text_cnt", "hash")


def token_edges(nodes: DataFrame) -> DataFrame:
    """i, j, count: from path nodes to their children, by ids as in `keyed`."""
    each = nodes.where("path is not null").select(F.col("hash").cast("string").alias("i"), F.explode("path").alias("j"), "word_cnt")
    return each.groupBy("i", F.col("j").cast("string").alias("j")).agg(F.sum("word_cnt").alias("count"))


#: Fixed value: so many hashes of several words are sent to the tasks at most.
ALIKE = 100_000
_known: dict[str, int] = {}
_STOPS = frozenset(b + x for x in ENDS for b in ("", " "))


class _Letters(W.Letters):
    """Letters by tokens with the blank before them."""

    def __missing__(self, piece: str) -> str:
        if len(self) >= W.MOST:
            self.clear()
        out = self[piece] = self.letters.get(W.part_of_speech(piece.lstrip(" ▁")), "O")
        return out


_letters = _Letters({"JJ": "J", "NN": "N", "NNS": "N", "NNP": "N"})


def _combined(sizes: np.ndarray, starts: np.ndarray, numbers: np.ndarray, last: int) -> np.ndarray:
    """Hashes of paths that lie in one array, `last` behind each: all paths a step at a time, the longest first."""
    order = np.argsort(-sizes, kind="stable")
    sizes, starts = sizes[order], starts[order]
    h = hashing.mix((sizes + 1).astype(np.uint64))
    alive = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), side="left").tolist()
    for k, n in enumerate(alive):
        h[:n] = hashing.combine(h[:n], numbers[starts[:n] + k])
    out = np.empty(len(h), np.uint64)
    out[order] = hashing.combine(h, np.full(len(h), last, np.uint64))
    return out


def _laid(paths: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, paths), np.int64, len(paths))
    return sizes, np.cumsum(sizes) - sizes


def _paths_hashed(paths: list[list[int]], name: str) -> list[int]:
    """`path_hashes`, all in step."""
    sizes, starts = _laid(paths)
    numbers = np.fromiter(chain.from_iterable(paths), np.int64, int(sizes.sum())).view(np.uint64)
    if name == "term":
        for size in np.unique(sizes[sizes > 2]).tolist():
            at = starts[sizes == size][:, None] + np.arange(size - 1)
            numbers[at] = np.sort(numbers[at], axis=1)
    return _combined(sizes, starts, numbers, B.NODE_FLAVOURS[name]).view(np.int64).tolist()


def _words_hashed(pieces: Iterable[str]) -> dict[str, int]:
    """Hashes of the word tokens of pieces; a process keeps those that it has met."""
    new = [w for w in pieces if w not in _known]
    if len(_known) + len(new) > W.MOST:
        _known.clear()
        new = list(pieces)
    if new:
        names = [f"__word_token_{W.marked(w)}_" for w in new]
        whole = "".join(names).encode("utf-16-le")
        sizes, starts = _laid(names)
        if len(whole) != 2 * int(sizes.sum()):  # signs of two units
            hashes = hashing.hash_texts([f"{x}_" for x in names])
        else:
            hashes = _combined(sizes, starts, np.frombuffer(whole, np.uint16).astype(np.uint64), ord("_"))
        _known.update(zip(new, hashes.view(np.int64).tolist(), strict=True))
    return _known


def _found(documents: DataFrame, of: Callable[[list[list[str]]], Iterator[list]], schema: str) -> DataFrame:
    """Columns that `of` finds in the tokens, each with the blank before it, of some texts that have any."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64() if c.endswith(" long") else pa.string() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.parts(batches, 200):
            texts = [p for p in map(W.pieces, part.column("text").to_pylist()) if p]
            if texts:
                for columns in of(texts):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return documents.select("text").mapInArrow(run, schema)


def alike(documents: DataFrame) -> DataFrame:
    """hash, text: hashes that several words have, and the first of these."""

    def of(texts: list[list[str]]) -> Iterator[list]:
        words = set().union(*texts)
        known = _words_hashed(words)
        yield [[known[w] for w in words], [*map(W.marked, words)]]

    found = _found(documents, of, "hash long, text string").groupBy("hash").agg(F.min("text").alias("text"), F.max("text").alias("last"))
    return found.where("text != last").select("hash", "text")


def _stands(documents: DataFrame) -> dict[int, str] | None:
    """The first word of hashes that several words have, if they are few."""
    found = alike(documents).limit(ALIKE + 1).collect()
    return {r["hash"]: r["text"] for r in found} if len(found) <= ALIKE else None


def _reads(text: str) -> str:
    return text.replace("▁", " ").strip(" ")


def shown_terms(documents: DataFrame) -> DataFrame:
    """text, word_cnt, text_cnt of the nodes of terms, as `resolved` has them."""
    first = _stands(documents)
    if first is None:
        return resolved(cut(token_nodes(documents), "identity-tokens").unionByName(cut(term_nodes(documents), "identity-terms"))).where("name = 'term'").select("text", "word_cnt", "text_cnt")
    sent, pattern = documents.sparkSession.sparkContext.broadcast(first), re.compile("[JN]*N")

    def of(texts: list[list[str]]) -> Iterator[list]:
        # no token of a term stands right behind another, so a term's blanks part its tokens
        own = [["".join(ws[m.start() : m.end()]) for m in pattern.finditer(_letters.of(ws))] for ws in texts]
        terms = [*set().union(*own)]
        words = [[x for x in t.replace(" ", "\n ").split("\n") if x] for t in terms]
        known, first = _words_hashed({w for ws in words for w in ws}), sent.value
        paths = [[known[w] for w in ws] for ws in words]
        hashes = dict(zip(terms, _paths_hashed(paths, "term"), strict=True))
        n: Counter = Counter()
        texts_: Counter = Counter()
        for ts in own:
            hs = [hashes[t] for t in ts]
            n.update(hs)
            texts_.update(set(hs))
        best: dict[int, tuple[str, str | None]] = {}
        for t, ws, p in zip(terms, words, paths, strict=True):
            shown = t.replace(" ", "▁")
            if (h := hashes[t]) not in best or shown < best[h][0]:
                best[h] = shown, "".join([first.get(x, W.marked(w)) for x, w in zip(p, ws, strict=True)]) if first and not first.keys().isdisjoint(p) else None
        if best:
            yield [[*best], [n[h] for h in best], [texts_[h] for h in best], [x for x, _ in best.values()], [x for _, x in best.values()]]

    rows = _found(documents, of, "hash long, n long, texts long, shown string, text string")
    nodes = rows.groupBy("hash").agg(F.sum("n").alias("word_cnt"), F.sum("texts").alias("text_cnt"), F.min(F.struct("shown", "text")).alias("best"))
    return nodes.select(F.trim(F.replace(F.coalesce("best.text", "best.shown"), F.lit("▁"), F.lit(" "))).alias("text"), "word_cnt", "text_cnt")


def shown_texts(documents: DataFrame) -> DataFrame:
    """name, text, word_cnt, text_cnt of the nodes of sentences and texts, as `resolved` has them."""
    first = _stands(documents)
    if first is None:
        return resolved(cut(token_nodes(documents), "identity-tokens").unionByName(cut(sentence_nodes(documents), "identity-sentences"))).where("path is not null").select("name", "text", "word_cnt", "text_cnt")
    sent = documents.sparkSession.sparkContext.broadcast(first)

    def of(texts: list[list[str]]) -> Iterator[list]:
        known, first = _words_hashed(set().union(*texts)), sent.value
        paths, spans, shown = [], [], []
        for ws in texts:
            hs, at, begun = [known[w] for w in ws], 0, len(paths)
            read = ws if not first or first.keys().isdisjoint(hs) else [first.get(h, w) for h, w in zip(hs, ws, strict=True)]
            stops = [k for k, w in enumerate(ws, 1) if w in _STOPS]
            for k in stops if stops and stops[-1] == len(ws) else [*stops, len(ws)]:
                paths.append(hs[at:k])
                shown.append("".join(read[at:k]).replace(" ", "▁"))
                at = k
            spans.append((begun, len(paths)))
        hashes = _paths_hashed(paths, "sentence")
        n: Counter = Counter(hashes)
        texts_: Counter = Counter()
        for a, b in spans:
            texts_.update(set(hashes[a:b]))
        best: dict[int, str] = {}
        for h, x in zip(hashes, shown, strict=True):
            best[h] = min(best.get(h, x), x)
        yield [["sentence"] * len(best), [*best], [n[h] for h in best], [texts_[h] for h in best], [_reads(x) for x in best.values()]]
        wholes = _paths_hashed([hashes[a:b] for a, b in spans], "text")
        count = Counter(wholes)
        text = {h: _reads("".join(shown[a:b])) for h, (a, b) in zip(wholes, spans, strict=True)}
        yield [["text"] * len(text), [*text], [count[h] for h in text], [count[h] for h in text], [*text.values()]]

    rows = _found(documents, of, "name string, hash long, n long, texts long, text string")
    return rows.groupBy("hash", "name").agg(F.sum("n").alias("word_cnt"), F.sum("texts").alias("text_cnt"), F.min("text").alias("text")).select("name", "text", "word_cnt", "text_cnt")
