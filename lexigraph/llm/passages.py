"""Passages of over 50 words that another document has too, however few bytes they are.

A passage is `words` (51) words in a row, `[^\\x20\\x09-\\x0D]+` each; it's shared if a
document with another id or text has the same words in a row, whatever white space
stands between them.  This tells where documents repeat each other; it removes nothing.

1. Where to look.  Words become 64-bit codes, and windows of `words` codes have
   anchors as windows of bytes have in `repeats`.  Equal windows have equal anchors
   at equal places, so only anchors that occur twice go on; this loses nothing.
2. An anchor's context is the words of the windows that have it.  A context of
   several documents is shared whole.  Where an anchor has other contexts too, one
   copy of each gives its windows, with the least and largest document that has the
   context; a window is shared if these differ over all contexts that hold it.
3. All windows of a context share its anchor, so what is shared of it is one
   stretch; a document's stretches are united.

Cases: null and empty texts and those of fewer words share nothing; a repetition
inside one document isn't shared, nor are rows that repeat both id and text; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .repeats import BYTE_CODES, PIECE, anchors, powers, rolling, with_keys

SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_codes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a text, in order."""
    data = np.frombuffer(text, np.uint8)
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(PIECE + 4096)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + PIECE, side="right"))
        if j == i:  # a word longer than a piece
            import xxhash

            out[i] = xxhash.xxh3_64_intdigest(text[lo : ends[i]])
            i += 1
            continue
        part = data[lo : ends[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_CODES[part] * up[: len(part)], out=sums[1:])
        h = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * down[starts[i:j] - lo]
        out[i:j] = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        i = j
    return out ^ (out >> np.uint64(29))


def shared_passages(documents: DataFrame, words: int = 51) -> DataFrame:
    """k1, k2 (the row, see repeats.with_keys), n_passages (maximal runs of shared words), passage_words (words in them): documents that share some."""
    width = max(1, words // 3)  # fewer anchors than of half a window, as a chance repetition of so many words is rare
    long = with_keys(documents).where(F.octet_length("text") >= 2 * words - 1).select("k1", "k2", "text")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(word_codes(text.encode()), words, width)[1] for text in batch.column("text").to_pylist()]
            if found:
                anchor, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], ["anchor", "n"])

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, len(whole), 400):
                batch = whole.slice(at, 400)
                row, found, contexts = [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    codes = word_codes(text.encode())
                    own = anchors(codes, words, width)
                    row += [i] * len(own[0])
                    found.append(own)
                    data = codes.tobytes()
                    contexts += [xxhash.xxh3_64_intdigest(data[8 * a : 8 * (b + words)], p - a) for p, a, b in zip(own[0].tolist(), own[2].tolist(), own[3].tolist(), strict=True)]
                if row:
                    rows = pa.array(row)
                    place, anchor, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
                    small = [pa.array(c.astype(np.int32)) for c in (first, last - first + words, place - first)]
                    yield pa.RecordBatch.from_arrays([batch.column("k1").take(rows), batch.column("k2").take(rows), pa.array(anchor), pa.array(np.array(contexts, np.uint64).view(np.int64)), *small], ["k1", "k2", "anchor", "context", "start", "span", "left"])

    several = cut(long.select("text").mapInArrow(counts, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "passage-anchors")
    seen = cut(long.mapInArrow(occurrences, "k1 long, k2 long, anchor long, context long, start int, span int, left int").join(several, "anchor", "left_semi"), "passage-places")
    contexts = cut(seen.groupBy("anchor", "context").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"), F.max("span").alias("span"), F.min(F.struct("k1", "k2", "start", "left")).alias("one")), "passage-contexts")
    whole = contexts.where("lo < hi").select("anchor", "context", F.lit(0).alias("lo"), F.col("span").alias("hi"))
    open_ones = contexts.groupBy("anchor").agg(F.count("*").alias("n"), F.min(F.expr("lo < hi")).alias("all")).where("n > 1 and not all").select("anchor")
    wanted = contexts.join(open_ones, "anchor", "left_semi").select("one.*", "anchor", "context", "span", "lo", "hi")
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "context", "start", "span", "left", "lo", "hi")).alias("wanted"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 200):
                batch = whole.slice(at, 200)
                rows, sizes, strings = [], [], []
                for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                    codes = word_codes(text.encode())
                    for w in wanted:
                        rows.append((w["anchor"], w["context"], w["left"], w["lo"], w["hi"]))
                        sizes.append(w["span"] - words + 1)
                        strings.append(rolling(codes[w["start"] : w["start"] + w["span"]], words).view(np.int64))
                if rows:
                    anchor, context, left, lo, hi = (np.repeat(c, sizes) for c in np.array(rows, np.int64).T)
                    step = np.concatenate([np.arange(s) for s in sizes])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (anchor, context, step.astype(np.int32), (left - step).astype(np.int32), np.concatenate(strings), lo, hi)], ["anchor", "context", "step", "place", "string", "lo", "hi"])

    given = long.join(wanted, ["k1", "k2"]).select("text", "wanted").mapInArrow(windows, "anchor long, context long, step int, place int, string long, lo long, hi long")
    same = Window.partitionBy("anchor", "place", "string")
    near = given.select("anchor", "context", "step", F.min("lo").over(same).alias("low"), F.max("hi").over(same).alias("high")).where("low < high").select("anchor", "context", F.col("step").alias("lo"), (F.col("step") + words).alias("hi"))
    stretch = whole.unionByName(near).groupBy("anchor", "context").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spans = seen.join(stretch, ["anchor", "context"]).groupBy("k1", "k2", (F.col("start") + F.col("lo")).cast("long").alias("a")).agg(F.max(F.col("start") + F.col("hi")).cast("long").alias("b"))
    spans = spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("words"), F.lit(-1).cast("long").alias("end"))

    def unite(now, span):
        fresh, end = span["a"] > now["end"], F.greatest(now["end"], span["b"])
        return F.struct((now["n"] + fresh.cast("long")).alias("n"), (now["words"] + end - F.when(fresh, span["a"]).otherwise(now["end"])).alias("words"), end.alias("end"))

    counted = spans.withColumn("u", F.aggregate("spans", none, unite)).select("k1", "k2", F.col("u.n").alias("n_passages"), F.col("u.words").alias("passage_words"))
    return cut(counted, "passages")  # so that its shuffles needn't lie on disk beside the caller's
