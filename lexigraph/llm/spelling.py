"""Spelling variants: words of a corpus's vocabulary that differ by one code point, by search schemes over FM-indices.

Vocabulary.  Runs of letters are counted where they stand, combined before they
are shuffled.

Search.  One error lies in one half of a word, so the other half matches
exactly.  A scheme matches that half and extends across the other, allowing one
insertion, deletion or replacement, as intervals of suffix ranks.  There
are two, one for each direction: the second half is matched and extended to the
left, and the first half is matched and extended to the right, which is the same on
words written backwards.  The text of an index is its words in order with a
delimiter around each; the ranks of the suffixes that start with a delimiter are
the words' numbers, so a match ends in a word without a suffix array being kept.

Shards.  In either direction words are range-sorted so that those that share the
half matched exactly are neighbours, and cut into shards of about `shard`
words, each with an index.  A word asks only the shards whose range its half
meets; a shard that many words ask is copied for blocks of at most `block`
of them.  The borders of shards (two words for each `shard` words) go to the tasks.
All states of a block step together in numpy.

Each pair is found from either of its words.  A pair found to the right that
also matches the second half was found to the left too, and is left out.

Cases: null and empty texts have no words; a null doc_id counts as the empty text;
repeated rows count each; of near words that are equally frequent the first in
code-point order is the form; forms are at least `ratio` times as frequent, so chains end and
have no circles; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, wide

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(documents: DataFrame, least: int = 7, twice: int = 2, slips: int = 31) -> DataFrame:
    """word, n of words of at least `least` code points that occur at least `twice` times; where `slips` divides the crc32 of `<doc_id>:<run>`, the run loses a code point."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    runs = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= least)
    runs = runs.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(F.col("h") % slips == 0, slipped).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= twice)


class WordIndex:
    """FM-index of sorted distinct words with a delimiter around each; patterns grow to the left."""

    def __init__(self, words: list[str]):
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.alphabet, codes = np.unique(points, return_inverse=True)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.zeros(len(points) + len(words) + 1, np.int64)
        ends = np.cumsum(sizes + 1)
        inside = np.ones(len(text), bool)
        inside[np.r_[0, ends]] = False
        text[inside] = codes + 1
        self.n, self.words, self.symbols = len(text), len(words), len(self.alphabet) + 1
        order = self._suffixes(text)
        self.bwt = text[order - 1]
        #: Places of each symbol in the transform, by symbol and place: how many lie below (symbol, place) is the rank of the suffix one symbol longer.
        self.places = np.sort(self.bwt * (self.n + 1) + np.arange(self.n))

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix array by doubling the compared length."""
        n, width, rank = len(text), 1, text.copy()
        while True:
            behind = np.zeros(n, np.int64)
            behind[: max(0, n - width)] = rank[width:] + 1
            key = rank * (n + 2) + behind
            order = np.argsort(key, kind="stable")
            same = np.r_[False, key[order][1:] == key[order][:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(~same) - 1
            if not same.any():
                return order
            width *= 2

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of words in one line, where each word begins, and lengths; code points that no word of the index has are -1."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, -1), np.cumsum(sizes) - sizes, sizes

    def longer(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with a symbol before them; empty for unknown symbols."""
        base = symbol * (self.n + 1)
        a, b = np.searchsorted(self.places, base + lo), np.searchsorted(self.places, base + hi)
        return a, np.where(symbol < 0, a, b)

    def before(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval's number, symbol) for the symbols before an interval's pattern, delimiters aside: read off where narrow, all where wide."""
        width = hi - lo
        narrow = np.flatnonzero(width <= self.symbols)
        own = np.repeat(narrow, width[narrow])
        step = np.arange(len(own)) - np.repeat(np.cumsum(width[narrow]) - width[narrow], width[narrow])
        pairs = np.unique(own * self.symbols + self.bwt[lo[own] + step])
        broad = np.flatnonzero(width > self.symbols)
        pairs = np.r_[pairs, np.repeat(broad * self.symbols, self.symbols - 1) + np.tile(np.arange(1, self.symbols), len(broad))]
        which, symbol = pairs // self.symbols, pairs % self.symbols
        return which[symbol > 0], symbol[symbol > 0]

    def near(self, queries: list[str], free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query's number, word's number) of words with exactly one error in a query's first `free` code points, the rest alike.

        Of the places in a run of one symbol where that symbol may be inserted or deleted, the leftmost stands for all.
        """
        line, first, sizes = self.codes(queries)
        q = np.arange(len(queries))
        lo, hi, left = np.zeros(len(q), np.int64), np.full(len(q), self.words + 1), sizes.copy()
        while len(q) and (todo := left > free[q]).any():
            at = np.flatnonzero(todo)
            lo[at], hi[at] = self.longer(lo[at], hi[at], line[first[q[at]] + left[at] - 1])
            left[at] -= 1
            q, lo, hi, left = (x[hi > lo] for x in (q, lo, hi, left))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(q):
            which, symbol = self.before(lo, hi)
            a, b = self.longer(lo[which], hi[which], symbol)
            own = np.where(left[which] > 0, line[first[q[which]] + np.maximum(left[which], 1) - 1], -2)
            put = own != symbol
            swap = put & (left[which] > 0)
            some = np.flatnonzero(left > 0)
            at = first[q[some]] + left[some] - 1
            gone = some[(left[some] == 1) | (line[at] != line[np.maximum(at, 1) - 1])]
            # inserted, replaced, deleted
            states = [np.r_[x, y, z] for x, y, z in ((q[which][put], q[which][swap], q[gone]), (a[put], a[swap], lo[gone]), (b[put], b[swap], hi[gone]), (left[which][put], left[which][swap] - 1, left[gone] - 1))]
            found.append(self._rest(line, first, *states))
            q, lo, hi, left = (x[some] for x in (q, lo, hi, left))
            lo, hi = self.longer(lo, hi, line[at])
            left = left - 1
            q, lo, hi, left = (x[hi > lo] for x in (q, lo, hi, left))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate([x for x, _ in found]) * (self.words + 1) + np.concatenate([w for _, w in found]))
        return pairs // (self.words + 1), pairs % (self.words + 1)

    def _rest(self, line: np.ndarray, first: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What remains to the left of an error is matched exactly, then the delimiter: its rank is the word's number, from 1."""
        keep = hi > lo
        q, lo, hi, left = q[keep], lo[keep], hi[keep], left[keep]
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        while len(q):
            symbol = np.where(left > 0, line[first[q] + np.maximum(left, 1) - 1], 0)
            lo, hi = self.longer(lo, hi, symbol)
            done = (left == 0) & (hi > lo)
            ends.append((q[done], lo[done] - 1))
            go = (left > 0) & (hi > lo)
            q, lo, hi, left = q[go], lo[go], hi[go], left[go] - 1
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in ends]), np.concatenate([w for _, w in ends])


def _searched(words: DataFrame, backwards: bool, shard: int, block: int) -> DataFrame:
    """word, near, near_n by one scheme: the second half matched and extended to the left, or the first half and to the right."""
    turned = F.col("word") if backwards else F.reverse("word")
    # the shards' own order is that of the half matched exactly: from the word's end for the left scheme, from its start for the right one
    once = words.select(turned.alias("side"), "word", "n")
    count = max(1, -(-words.count() // shard))
    sorted_words = cut(once.repartitionByRange(count, "side").withColumn("shard", F.spark_partition_id()), "spelling-shards")
    borders = sorted(tuple(r) for r in sorted_words.groupBy("shard").agg(F.min("side").alias("a"), F.max("side").alias("b")).select("a", "b", "shard").collect())
    firsts, lasts, numbers = [list(x) for x in zip(*borders, strict=True)] if borders else ([], [], [])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for side, word in zip(batch.column("side").to_pylist(), batch.column("word").to_pylist(), strict=True):
                half = side[: len(word) // 2 if backwards else len(word) - len(word) // 2]
                rows += [(numbers[k], word) for k in range(bisect_left(lasts, half), bisect_right(firsts, half + chr(0x10FFFF)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], ["shard", "word"])

    asked = cut(sorted_words.select("side", "word").mapInArrow(ask, "shard int, word string"), "spelling-asked")
    blocks = cut(asked.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "spelling-blocks")
    asked = asked.join(blocks, "shard").select("shard", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("asks"), "word", F.lit(0).cast("long").alias("n"))
    held = sorted_words.join(blocks, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("asks"), "word", "n")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facing = (lambda w: w[::-1]) if backwards else (lambda w: w)
        now, own, index = None, [], None
        for batch in batches:
            shards, places, asks, texts, ns = (batch.column(c).to_pylist() for c in ("shard", "block", "asks", "word", "n"))
            queries: list[str] = []

            def answer() -> Iterator[pa.RecordBatch]:
                for k in range(0, len(queries), 10_000):
                    part = queries[k : k + 10_000]
                    free = np.fromiter((len(w) - len(w) // 2 if backwards else len(w) // 2 for w in part), np.int64, len(part))
                    one, two = index.near([facing(w) for w in part], free)
                    pairs = [(part[a], *own[b]) for a, b in zip(one.tolist(), two.tolist(), strict=True)]
                    pairs = [(w, facing(v), n) for w, v, n in pairs]
                    if backwards:
                        pairs = [(w, v, n) for w, v, n in pairs if not v.endswith(w[len(w) // 2 :])]
                    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()), pa.array([p[2] for p in pairs], pa.int64())], ["word", "near", "near_n"])
                queries.clear()

            for shard_, place, ask_, word, n in zip(shards, places, asks, texts, ns, strict=True):
                if (shard_, place) != now:
                    yield from answer()
                    now, own, index = (shard_, place), [], None
                if not ask_:
                    own.append((facing(word), n))
                    continue
                if index is None:
                    own.sort()
                    index = WordIndex([w for w, _ in own])
                queries.append(word)
            yield from answer()

    dealt = held.unionByName(asked).repartition(wide(words), "shard", "block").sortWithinPartitions("shard", "block", "asks")
    return dealt.mapInArrow(search, "word string, near string, near_n long")


def near_words(words: DataFrame, shard: int = 20_000, block: int = 50_000) -> DataFrame:
    """word, near, near_n: all pairs of words (word, n) that differ by one inserted, deleted or replaced code point, both ways."""
    return _searched(words, False, shard, block).unionByName(_searched(words, True, shard, block))


def variants(words: DataFrame, ratio: int = 10, shard: int = 20_000, block: int = 50_000) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n)."""
    words = cut(words.select("word", "n"), "spelling-words")
    best = near_words(words, shard, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    much = -F.col("best.m") >= ratio * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(much, F.col("best.near")).alias("form"), F.when(much, -F.col("best.m")).alias("form_n"))
    rows = cut(rows, "spelling-forms")
    # a form is `ratio` times as frequent, so a chain has at most log(n) steps; each round doubles how far the roots of the words with a form reach
    most, steps, reach = rows.agg(F.max("n")).first()[0] or 1, 0, 1
    while ratio**steps < most:
        steps += 1
    led = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while reach < steps:
        on = led.select(F.col("word").alias("root"), F.col("root").alias("next"))
        led = cut(led.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        reach *= 2
    return rows.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
