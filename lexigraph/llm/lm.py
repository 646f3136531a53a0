"""Language-model scoring by deleted interpolation over the whole vocabulary.

Tokens are the lower-cased words of a text and one end.  A token w after the token
h before it (an end before the first) mixes three estimates,

    P(w | h) = a * c(h w) / c(h) + b * c(w) / N + (1 - a - b) / (V + 1)

where a and b belong to the bucket of h, the power of two of its count; an unknown
h has no first part and the others share its weight.  Unknown words share the even
part.  The weights are learned by expectation-maximisation on held-out counts:
those of a third of the training rows, with the estimates taken from the other two
thirds, grouped by bucket and by estimates within a quarter of an octave.

Texts are taken in chunks of about `chunk` tokens, written once as codes.  A chunk
sends its distinct words and pairs with their counts to shards of the hash space,
as sorted hashes in few bytes; a shard adds up what all chunks have sent and answers
each with the totals.  So a word or pair crosses once a chunk, however frequent, and
counts of all words and pairs, which grow with the text, are never in one place.
Only bucket weights and totals are sent to tasks.

Words are told apart by 64-bit hashes, pairs by hashes of 24 bits more than the
number of tokens has, 64 at most.

Cases: null text is empty and has the end alone; null doc_id is hashed as the
empty text; repeated rows count and are scored each; without training rows every
word is unknown; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, fold, groups

#: Hash of the end token; words hash to their XXH64 digest.
END = 0x656E64
#: What a row's counts are for.
SCORED, HELD, FIT = 0, 1, 2


def _hash(words) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64)


def pair_keys(before: np.ndarray, after: np.ndarray, bits: int) -> np.ndarray:
    """The upper `bits` of a hash of two words' hashes."""
    x = (before ^ (before >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + after
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(64 - bits)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers as their lowest bytes, then their next ones, as far as the largest needs, compressed."""
    numbers = np.ascontiguousarray(numbers, np.uint64)
    wide = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([wide]) + zlib.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view(np.uint64).ravel()


def chunked(documents: DataFrame, chunk: int) -> DataFrame:
    """A row for each chunk: docs, sizes (tokens by text), flags (SCORED, HELD or FIT by text), codes (of all tokens) and hashes (by code; the end is code 0)."""
    names = ["chunk", "docs", "sizes", "flags", "codes", "hashes", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: dict[bytes, int] = {}
        hashes, waiting, first = [np.array([END], np.uint64)], [], None

        def out() -> pa.RecordBatch:
            nonlocal hashes
            docs, sizes, flags, codes = (np.concatenate(c) if k else list(chain.from_iterable(c)) for k, c in enumerate(zip(*waiting, strict=True)))
            row = [[first], [docs], [sizes], [flags.astype(np.uint8).tobytes()], [pack(codes)], [np.concatenate(hashes).tobytes()], [len(codes)]]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            waiting.clear()
            code.clear()
            hashes = [np.array([END], np.uint64)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names)

        n = 0
        for batch, texts in blocks(batches):
            if not waiting:
                first = batch.column("row_id")[0].as_py()
            words = [t.lower().split() for t in texts]
            flat = list(chain.from_iterable(words))
            new = list(set(flat).difference(code))
            code.update(zip(new, range(len(code) + 1, len(code) + 1 + len(new)), strict=True))
            hashes.append(_hash(new))
            sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
            codes = np.zeros(int(sizes.sum()), np.uint32)
            is_word = np.ones(len(codes), bool)
            is_word[np.cumsum(sizes) - 1] = False
            codes[is_word] = np.fromiter(map(code.__getitem__, flat), np.uint32, len(flat))
            waiting.append((batch.column("doc_id").to_pylist(), sizes, batch.column("flag").to_numpy(), codes))
            n += len(codes)
            if n > chunk:
                yield out()
                n = 0
        if waiting:
            yield out()

    flag = F.when(fold("doc_id", 7) == 2, SCORED).when(fold("doc_id", 3) == 0, HELD).otherwise(FIT)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", flag.cast("int").alias("flag"), F.monotonically_increasing_id().alias("row_id"))
    return rows.mapInArrow(run, "chunk long, docs array<long>, sizes array<long>, flags binary, codes binary, hashes binary, tokens long")


class Chunk:
    """A chunk's distinct pairs of tokens (first and second, as codes), and each token's pair (place)."""

    def __init__(self, row: dict):
        self.docs, self.sizes = row["docs"], np.array(row["sizes"], np.int64)
        self.flags = np.frombuffer(row["flags"], np.uint8)
        pairs = unpack(row["codes"])
        # a text's last token is the end, which also stands before the next text's first
        pairs[1:] |= (pairs[:-1] << np.uint64(32))
        order = np.argsort(pairs)
        pairs = pairs[order]
        new = np.append(True, pairs[1:] != pairs[:-1])
        self.place = np.empty(len(pairs), np.int32)
        self.place[order] = np.cumsum(new, dtype=np.int32) - 1
        pairs = pairs[new]
        self.first, self.second = (pairs >> np.uint64(32)).astype(np.int32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int32)

    def counts(self, flag: int) -> tuple[np.ndarray, np.ndarray]:
        """Of words by code, and of pairs, in the texts whose flag is this or more."""
        own = np.repeat(self.flags >= flag, self.sizes)
        pairs = np.bincount(self.place[own], minlength=len(self.first))
        return np.bincount(self.second, pairs, int(self.second.max()) + 1).astype(np.int64), pairs

    def keys(self, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return hashes, pair_keys(hashes[self.first], hashes[self.second], bits)


def sent(rows: DataFrame, shards: int, bits: int) -> DataFrame:
    """For each chunk and shard: sorted hashes (as steps) of its words and of its pairs, and their counts in training texts and in those that fit."""
    names = ["shard", "chunk", "words", "words_n", "words_fit", "pairs", "pairs_n", "pairs_fit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Chunk(row)
                hashes = np.frombuffer(row["hashes"], np.uint64)
                every, fit = own.counts(HELD), own.counts(FIT)
                columns: list[list[bytes]] = []
                for kind, wide in ((0, 64), (1, bits)):
                    keys, at = np.unique(own.keys(hashes, bits)[kind], return_inverse=True)
                    edges = shard_edges(keys, shards, wide)
                    sums = [np.bincount(at, x[kind], len(keys)) for x in (every, fit)]
                    part = lambda x: [x[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]  # noqa: E731, B023
                    columns.append([pack(np.diff(k, prepend=np.uint64(0))) for k in part(keys)])
                    columns += [[pack(s) for s in part(x)] for x in sums]
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, row["chunk"])), *(pa.array(c, pa.binary()) for c in columns)], names)

    return rows.select("chunk", "docs", "sizes", "flags", "codes", "hashes").mapInArrow(run, "shard long, chunk long, words binary, words_n binary, words_fit binary, pairs binary, pairs_n binary, pairs_fit binary")


def shard_edges(keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Where the shards, even ranges of the hash space, begin and end among sorted keys."""
    starts = [-(-(s << bits) // shards) for s in range(1, shards)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(starts, np.uint64)), [len(keys)]])


def answers(requests: DataFrame) -> DataFrame:
    """The totals of what each chunk has asked, in its order, and (as chunk null) the shard's sums over words: n, fit and the number with n > 0."""
    names = ["chunk", "shard", "words_n", "words_fit", "pairs_n", "pairs_fit", "sums"]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in groups(batches, "shard"):
            found: list[list] = []
            for kind in ("words", "pairs"):
                keys = [np.cumsum(unpack(r[kind])) for r in rows]
                ends = np.cumsum([len(k) for k in keys])[:-1]
                every, at = np.unique(np.concatenate(keys), return_inverse=True)
                del keys
                for what in ("n", "fit"):
                    total = np.bincount(at, np.concatenate([unpack(r[f"{kind}_{what}"]) for r in rows]).astype(float), len(every)).astype(np.uint64)
                    found.append([pack(x) for x in np.split(total[at], ends)])
                    if kind == "words":
                        sums = [int(total.sum())] if what == "n" else [*sums, int(total.sum())]
                        known = int((total > 0).sum()) if what == "n" else known
            for r, *own in zip(rows, *found, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([r["chunk"], shard, *own, None], kinds, strict=True)], names)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([None, shard, *[None] * 4, [*sums, known]], kinds, strict=True)], names)

    return requests.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "chunk long, shard long, words_n binary, words_fit binary, pairs_n binary, pairs_fit binary, sums array<long>")


def joined(rows: DataFrame, replies: DataFrame, bits: int) -> DataFrame:
    """Each chunk with the totals of its words, by code, and of its pairs."""
    names = ["docs", "sizes", "flags", "codes", "words_n", "words_fit", "pairs_n", "pairs_fit"]
    binary = "words_n binary, words_fit binary, pairs_n binary, pairs_fit binary"

    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        own = Chunk(row)
        replies = replies.sort_by("shard")
        out = []
        for name, keys in zip(("words", "pairs"), own.keys(np.frombuffer(row["hashes"], np.uint64), bits), strict=True):
            at = np.unique(keys, return_inverse=True)[1]
            out += [pack(np.concatenate([unpack(x) for x in replies.column(f"{name}_{what}").to_pylist()])[at]) for what in ("n", "fit")]
        columns = [chunk.column(c) for c in names[:4]] + [pa.array([x], pa.binary()) for x in out]
        return pa.Table.from_arrays(columns, names)

    asked = replies.where("chunk is not null").select(F.col("chunk").alias("id"), "shard", "words_n", "words_fit", "pairs_n", "pairs_fit")
    return rows.groupBy("chunk").cogroup(asked.groupBy("id")).applyInArrow(run, f"docs array<long>, sizes array<long>, flags binary, codes binary, {binary}")


def interpolate(estimates: np.ndarray, held: np.ndarray, bucket: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Mixture weights by bucket (65 of them) that maximise the likelihood of held-out counts, by EM.

    estimates: a row for each event, a column for each component; held: the event's held-out count.
    """
    some = held > 0
    estimates, held, bucket = estimates[some], held[some], bucket[some]
    weights = np.full((65, estimates.shape[1]), 1 / estimates.shape[1])
    for _ in range(rounds):
        part = estimates * weights[bucket]
        part *= (held / np.maximum(part.sum(1), 1e-300))[:, None]
        total = np.stack([np.bincount(bucket, part[:, k], 65) for k in range(part.shape[1])], 1) + 1e-3  # an unseen bucket stays even
        weights = total / total.sum(1, keepdims=True)
    return weights


def buckets_of(context: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(context + 1)).astype(int)


def held_events(known: DataFrame, n_fit: int) -> DataFrame:
    """bucket, two, one, held: held-out counts of pairs, grouped by the bucket of the token before and by nearly equal estimates."""
    names = ["bucket", "s2", "s1", "two", "one", "held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Chunk(row)
                held = own.counts(HELD)[1] - own.counts(FIT)[1]
                some = np.flatnonzero(held)
                if not len(some):
                    continue
                words, pairs, held = unpack(row["words_fit"]).astype(float), unpack(row["pairs_fit"]).astype(float)[some], held[some]
                context = words[own.first[some]]
                two, one = pairs / np.maximum(context, 1), words[own.second[some]] / max(n_fit, 1)
                steps = [np.where(p > 0, np.floor(4 * np.log2(np.maximum(p, 1e-300))), -1000).astype(int) for p in (two, one)]
                groups_, at = np.unique(np.stack([buckets_of(context), *steps], 1), axis=0, return_inverse=True)
                sums = [np.bincount(at.ravel(), x, len(groups_)) for x in (two * held, one * held, held.astype(float))]
                yield pa.RecordBatch.from_arrays([*(pa.array(groups_[:, k]) for k in range(3)), *map(pa.array, sums)], names)

    each = known.select("docs", "sizes", "flags", "codes", "words_fit", "pairs_fit").mapInArrow(run, "bucket long, s2 long, s1 long, two double, one double, held double")
    by = each.groupBy("bucket", "s2", "s1").agg(F.sum("two").alias("two"), F.sum("one").alias("one"), F.sum("held").alias("held"))
    return by.select("bucket", (F.col("two") / F.col("held")).alias("two"), (F.col("one") / F.col("held")).alias("one"), "held")


def counted(documents: DataFrame, chunk: int = 1_300_000, shard_tokens: int = 3_000_000) -> tuple[DataFrame, tuple[int, int, int]]:
    """The chunks with their totals, and N, N of the texts that fit, and V."""
    rows = cut(chunked(documents, chunk), "lm-chunks")
    tokens = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shards, bits = max(1, -(-tokens // shard_tokens)), min(64, max(48, tokens.bit_length() + 24))
    replies = cut(answers(sent(rows, shards, bits)), "lm-totals")
    sums = [F.coalesce(F.sum(F.get("sums", F.lit(k))), F.lit(0)) for k in range(3)]
    return cut(joined(rows, replies, bits), "lm-known"), tuple(replies.where("chunk is null").agg(*sums).first())


def score_documents(documents: DataFrame, chunk: int = 1_300_000, shard_tokens: int = 3_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    chunk: tokens that are counted together in a task; shard_tokens: tokens a shard of the hash space.  Neither changes a result.
    """
    known, (n_all, n_fit, types) = counted(documents, chunk, shard_tokens)
    events = held_events(known, n_fit).orderBy("bucket", "two", "one").toPandas()
    even = 1 / (types + 1)
    weights = interpolate(np.stack([events["two"].to_numpy(float), events["one"].to_numpy(float), np.full(len(events), even)], 1), events["held"].to_numpy(float), events["bucket"].to_numpy(int))
    weights[0, 0] = 0  # nothing is known to follow an unknown token
    weights[0] /= weights[0].sum()
    norm = n_all + types + 1
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Chunk(row)
                words, pairs = unpack(row["words_n"]).astype(float), unpack(row["pairs_n"]).astype(float)
                context, of = words[own.first], words[own.second]
                w = weights[buckets_of(context)]
                p = w[:, 0] * pairs / np.maximum(context, 1) + w[:, 1] * of / max(n_all, 1) + w[:, 2] * even
                starts = np.cumsum(own.sizes) - own.sizes
                by_text = lambda x: pa.array(np.add.reduceat(x[own.place], starts))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(own.docs, pa.int64()), pa.array(own.sizes), by_text((of > 0).astype(np.int64)), by_text(np.log10((of + 1) / norm)), by_text(np.log10(p))], names)

    scored = known.select("docs", "sizes", "flags", "codes", "words_n", "pairs_n").mapInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
