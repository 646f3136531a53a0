"""Removal of repeated byte strings: suffix arrays per shard, Kasai common prefixes, cross-shard merging.

A byte goes when a string of `length` (400) bytes that covers it also starts
anywhere else, in its own text too.

1. Where to look.  Of all `length // 2`-byte strings in a window of `length`
   bytes, the one with the smallest hash is the window's anchor.  Equal windows
   have equal anchors at equal places, so only windows whose anchor occurs twice
   can repeat; the rest of the corpus is done.  This filter loses nothing.
2. An anchor's context is the bytes of the windows that have it.  A context seen
   twice is covered whole.  One copy of each other distinct context of a repeated
   anchor goes on, if it shares the 300 bytes with another that all its windows to
   the right, or all those to the left, have in common.
3. Contexts are dealt to shards by anchor.  A shard builds the suffix array of
   its contexts by Larsson-Sadakane refinement, Kasai's common prefixes (all
   contexts stepping together), and finds the windows of `length` bytes that
   stand at the same place before the same anchor in another context.
4. An anchor with more contexts than a shard holds is spread over several; each
   of these also gives its sorted distinct windows (as 128 bits: anchor with
   place, and string), cut into ranges, and the sorted runs of a range are
   merged by binary search.

Cases: null and empty texts and those shorter than `length` lose nothing;
repeated rows cover each other whole; null doc_id stays null; text is never cut
into pieces; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, groups

_RNG = np.random.default_rng(50)
BYTE_CODES = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0xD1342543DE82EF95
PIECE = 1 << 18
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2 ** 64."""
    if n not in _POWERS:
        inverse = pow(BASE, -1, 1 << 64)
        both = []
        for x in (BASE, inverse):
            p = np.ones(n, np.uint64)
            p[1:] = x
            both.append(np.multiply.accumulate(p))
        _POWERS[n] = tuple(both)
    return _POWERS[n]


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every string of `width` bytes (or of 64-bit codes); data holds at most PIECE + 2 * width of them or so."""
    up, down = powers(PIECE + 4096)
    sums = np.zeros(len(data) + 1, np.uint64)
    codes = BYTE_CODES[data] if data.dtype == np.uint8 else data
    np.cumsum(codes * up[: len(data)], out=sums[1:])
    h = (sums[width:] - sums[: len(sums) - width]) * down[: len(sums) - width]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def anchors(text: bytes | np.ndarray, length: int, width: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows of a text (bytes, or codes of its words), and the first and last window of each; anchors are half a window wide, or `width`."""
    width = width or length // 2
    span = length - width + 1
    if len(text) < length:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    data = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    found = []
    mask = np.uint64((1 << 20) - 1)
    for lo in range(0, len(data) - length + 1, PIECE):
        h = rolling(data[lo : lo + PIECE + length - 1], width)
        m = len(h)
        # hash above, place below: the least is the leftmost of the smallest
        key = np.full(-(-m // span) * span, np.iinfo(np.uint64).max, np.uint64)
        key[:m] = (h & ~mask) | np.arange(m, dtype=np.uint64)
        table = key.reshape(-1, span)
        ahead = np.minimum.accumulate(table, 1).ravel()
        behind = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
        at = (np.minimum(behind[: m - span + 1], ahead[span - 1 : m]) & mask).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))  # places don't go back
        found.append((at[first] + lo, h[at[first]].view(np.int64), first + lo, np.append(first[1:], len(at)) - 1 + lo))
    place, hashes, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
    new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))  # an anchor may go over the end of a piece
    return place[new], hashes[new], first[new], last[np.append(new[1:], len(place)) - 1]


def anchor_counts(documents: DataFrame, length: int) -> DataFrame:
    """anchor, n: the hashes of all anchors, counted by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors((text or "").encode(), length)[1] for text in batch.column("text").to_pylist()]
            if found:
                hashes, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(n)], ["anchor", "n"])

    return documents.select("text").mapInArrow(run, "anchor long, n long")


def occurrences(documents: DataFrame, length: int) -> DataFrame:
    """k1, k2 (the row), place, anchor, start and span (of its context), context, right and left (hashes)."""
    reach = length - length // 2
    half = reach // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for lo in range(0, len(whole), 400):
                batch = whole.slice(lo, 400)
                row, found, hashes = [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    text = (text or "").encode()
                    own = anchors(text, length)
                    row += [i] * len(own[0])
                    found.append(own)
                    for p, a, b in zip(own[0].tolist(), own[2].tolist(), own[3].tolist(), strict=True):
                        right = xxhash.xxh3_64_intdigest(text[p : p + length - half]) if b >= p - half else 0
                        left = xxhash.xxh3_64_intdigest(text[p - half : p + length - reach]) if a <= p - half else 0
                        hashes.append((xxhash.xxh3_64_intdigest(text[a : b + length], p - a), right, left))
                if row:
                    rows = pa.array(row)
                    place, anchor, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
                    three = np.array(hashes, np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column("k1").take(rows), batch.column("k2").take(rows), pa.array(place), pa.array(anchor), pa.array(first), pa.array((last - first + length).astype(np.int32)), *(pa.array(np.ascontiguousarray(three[:, k])) for k in range(3))], ["k1", "k2", "place", "anchor", "start", "span", "context", "right", "left"])

    return documents.mapInArrow(run, "k1 long, k2 long, place long, anchor long, start long, span int, context long, right long, left long")


def packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first highest; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(len(data), np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + len(data)]
    return key


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks by Larsson-Sadakane refinement, starting from eight bytes; only unsorted groups are sorted again."""
    n = len(data)
    key = packed(data)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    head = np.append(True, ranked[1:] != ranked[:-1])
    starts = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = starts + 1
    depth = 8
    while True:
        lone = head & np.append(head[1:], True)
        open_at = np.flatnonzero(~lone)
        if not len(open_at):
            return order, rank[:n] - 1
        at = order[open_at]
        group = rank[at]
        key = (group << 32) | rank[np.minimum(at + depth, n)]
        sort = np.argsort(key, kind="stable")
        at, key = at[sort], key[sort]
        order[open_at] = at
        new = np.append(True, key[1:] != key[:-1])
        head[open_at] = new
        rank[at] = np.maximum.accumulate(np.where(new, open_at, 0)) + 1
        depth *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Kasai: the common prefix, `most` at most, of each suffix and the one before it in order; contexts step together, eight bytes at a time."""
    out = np.zeros(len(data), np.int32)
    n = len(data)
    key = np.append(packed(data), np.uint64(0))
    bounds = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)
    h = np.zeros(len(starts), np.int64)
    for t in range(int(sizes.max())):
        lane = np.flatnonzero(sizes > t)
        i = starts[lane] + t
        before = rank[i] - 1
        j = np.where(before >= 0, order[np.maximum(before, 0)], i)
        room = np.where(before >= 0, np.minimum(n - np.maximum(i, j), most), 0)
        now = np.minimum(np.maximum(h[lane] - 1, 0), room)
        going = np.flatnonzero(now < room)
        while len(going):
            at = now[going]
            differ = key[i[going] + at] ^ key[j[going] + at]
            same = 8 - np.searchsorted(bounds, differ, side="right")  # bytes equal from the front
            now[going] = np.minimum(at + same, room[going])
            going = going[(same == 8) & (now[going] < room[going])]
        out[rank[i]] = now
        h[lane] = now
    return out


def shard_cover(texts: list[bytes], lefts: np.ndarray, anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last covered window of each context (or -1), and a mask of the windows covered, by start."""
    sizes = np.array([len(t) for t in texts])
    # separators differ from each other and hold bytes that UTF-8 has not
    parts = [part for i, t in enumerate(texts) for part in (t, bytes([0xFF, *(0xF8 + (i >> k & 7) for k in range(30, -1, -3))]))]
    data = np.frombuffer(b"".join(parts), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 12)[:-1]])
    order, rank = suffix_array(data)
    lcp = common_prefixes(data, order, rank, starts, sizes, length)
    classes = np.cumsum(lcp < length)  # in order: suffixes that share `length` bytes
    windows = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(texts)), windows)
    begin = np.arange(windows.sum()) - np.repeat(np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    group = classes[rank[starts[owner] + begin]]
    # the same place before the same anchor: else one window of a text would meet itself in two contexts
    place = lefts[owner] - begin
    same_anchor = np.unique(anchor, return_inverse=True)[1]
    low = place.min(initial=0)
    where = (group * len(texts) + same_anchor[owner]) * (place.max(initial=0) - low + 1) + place - low
    _, back, count = np.unique(where, return_inverse=True, return_counts=True)
    hit = count[back] > 1
    first, last = np.full(len(texts), -1), np.full(len(texts), -1)
    np.maximum.at(last, owner[hit], begin[hit])
    low = np.full(len(texts), length * 2)
    np.minimum.at(low, owner[hit], begin[hit])
    first = np.where(last >= 0, low, -1)
    return first, last, hit


def window_keys(text: bytes, left: int, anchor: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for every window of a context: its string, and its anchor with its place."""
    h = rolling(np.frombuffer(text, np.uint8), length)
    place = np.uint64(anchor & ((1 << 64) - 1)) + (left - np.arange(len(h))).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h, place


def united(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs of distinct keys as one, by binary search, with a mark on each key that was met more than once."""
    (a, a_twice), (b, b_twice) = one, two
    at = np.searchsorted(b, a)
    both = at < len(b)
    both[both] = b[at[both]] == a[both]
    twice = b_twice.copy()
    twice[at[both]] = True
    return np.insert(b, at[~both], a[~both]), np.insert(twice, at[~both], a_twice[~both])


def merge_runs(runs: list[np.ndarray]) -> list[np.ndarray]:
    """For each sorted run of distinct keys, which of its keys another run has too; runs merge two by two, so work grows with the logarithm of their number."""
    level = [(r, np.zeros(len(r), bool)) for r in runs]
    while len(level) > 1:
        level = [united(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    keys, twice = level[0]
    return [twice[np.searchsorted(keys, r)] for r in runs]


def with_keys(documents: DataFrame) -> DataFrame:
    """doc_id, text, and k1 and k2, which name the row."""
    return documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"))


def remove_repeats(documents: DataFrame, length: int = 400, shard_contexts: int = 1500, with_text: bool = False, beside: DataFrame | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats (whether a byte goes), and the kept text if `with_text`.

    The text is decoded from the kept bytes; a character of which only some bytes stay is left out there.
    `beside` has a row with k1, k2 and counts for some documents; its counts follow `repeats`, 0 for the others.
    """
    keyed = with_keys(documents)
    long = keyed.where(F.octet_length("text") >= length)
    twice = cut(anchor_counts(long, length).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "anchors")
    seen = cut(occurrences(long.select("text", "k1", "k2"), length).join(twice, "anchor", "left_semi"), "occurrences")
    contexts = cut(seen.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.max("span").alias("span"), F.first("right").alias("right"), F.first("left").alias("left"), F.min(F.struct("k1", "k2", "place", "start")).alias("one")), "contexts")
    whole = contexts.where((F.col("n") > 1) & (F.col("span") >= length)).select("anchor", "context", F.lit(0).alias("lo"), F.col("span").alias("hi"))

    apart = contexts.select("anchor", "context", "span", "one", "right", "left")
    for side in ("right", "left"):  # 0: no window on this side
        shared = contexts.where(F.col(side) != 0).groupBy("anchor", side).agg(F.count("*").alias(f"{side}_n")).where(f"{side}_n > 1")
        apart = apart.join(shared, ["anchor", side], "left")
    apart = cut(apart.where("right_n is not null or left_n is not null").select("anchor", "context", "span", "one"), "apart")
    shards = max(1, -(-apart.count() // shard_contexts))
    hot = apart.groupBy("anchor").agg(F.count("*").alias("size")).where(F.col("size") > shard_contexts).select("anchor", F.ceil(F.col("size") / shard_contexts).cast("int").alias("parts"))
    spread = apart.select("anchor", "context", "span", "one.*").join(hot, "anchor", "left")
    shard = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(F.xxhash64("anchor", F.pmod("context", F.col("parts"))))
    wanted = spread.withColumn("shard", shard).groupBy("k1", "k2").agg(F.collect_list(F.struct("shard", "anchor", "context", "place", "start", "span", F.coalesce("parts", F.lit(0)).alias("parts"))).alias("wanted"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "anchor", "context", "parts", "left", "bytes"]
        done: set[tuple[int, int]] = set()
        for whole in batches:
            for lo in range(0, len(whole), 200):
                batch = whole.slice(lo, 200)
                # repeated rows lie in one task or few, and one of them is enough
                keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True))
                new = [i for i, k in enumerate(keys) if k not in done and not done.add(k)]
                batch = batch.take(pa.array(new, pa.int64()))
                if not new:
                    continue
                texts = [t.encode() for t in batch.column("text").to_pylist()]
                rows = [(w["shard"], w["anchor"], w["context"], w["parts"], w["place"] - w["start"], text[w["start"] : w["start"] + w["span"]]) for text, wanted in zip(texts, batch.column("wanted").to_pylist(), strict=True) for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names)

    sliced = keyed.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "wanted").mapInArrow(slices, "shard long, anchor long, context long, parts int, left int, bytes binary")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, "shard"):
            rows = list({(r["anchor"], r["context"]): r for r in rows}.values())
            lefts, anchor = np.array([r["left"] for r in rows]), np.array([r["anchor"] for r in rows], np.int64)
            first, last, hit = shard_cover([r["bytes"] for r in rows], lefts, anchor, length)
            ctx = np.array([r["context"] for r in rows], np.int64)
            some = np.flatnonzero(last >= 0)
            runs: list[tuple] = []
            if rows[0]["parts"]:
                runs = sorted_runs(rows, hit)
            n = len(some) + len(runs)
            fill = [None] * len(runs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*anchor[some].tolist(), *fill], pa.int64()), pa.array([*ctx[some].tolist(), *fill], pa.int64()), pa.array([*first[some].tolist(), *fill], pa.int32()), pa.array([*(last[some] + length).tolist(), *fill], pa.int32())]
                + [pa.array([None] * (n - len(runs)) + [r[k] for r in runs], kind) for k, kind in ((0, pa.int64()), (1, pa.binary()), (2, pa.binary()))],
                ["anchor", "context", "lo", "hi", "range", "keys", "owners"],
            )

    def sorted_runs(rows: list[dict], hit: np.ndarray) -> list[tuple]:
        """A shard's distinct windows in order, cut into ranges; owners: anchor, context and window, or nothing where it's covered already."""
        keys = [window_keys(r["bytes"], r["left"], r["anchor"], length) for r in rows]
        sizes = [len(k[0]) for k in keys]
        table = np.empty(sum(sizes), [("string", np.uint64), ("place", np.uint64)])
        table["string"], table["place"] = (np.concatenate([k[i] for k in keys]) for i in (0, 1))
        owner = np.empty(len(table), [("anchor", np.int64), ("context", np.int64), ("window", np.int32)])
        owner["anchor"], owner["context"] = np.repeat([r["anchor"] for r in rows], sizes), np.repeat([r["context"] for r in rows], sizes)
        owner["window"] = np.where(hit, -1, np.concatenate([np.arange(s) for s in sizes]))
        table, one = np.unique(table, return_index=True)
        owner = owner[one]
        bits = max(6, (rows[0]["parts"] - 1).bit_length())  # a range then holds about as many windows as a shard, over all shards
        edges = np.searchsorted(table["string"], np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        cuts = zip([0, *edges], [*edges, len(table)], strict=True)
        spread_by = rows[0]["anchor"]
        return [(((spread_by << bits) + k) & ((1 << 63) - 1), table[a:b].tobytes(), owner[a:b].tobytes()) for k, (a, b) in enumerate(cuts) if b > a]

    covered = cut(sliced.repartition("shard").sortWithinPartitions("shard").mapInArrow(cover, "anchor long, context long, lo int, hi int, range long, keys binary, owners binary"), "covered")
    near = covered.where("anchor is not null").select("anchor", "context", "lo", "hi")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, "range"):
            hits = merge_runs([np.frombuffer(r["keys"], [("string", np.uint64), ("place", np.uint64)]) for r in rows])
            for r, hit in zip(rows, hits, strict=True):
                own = np.frombuffer(r["owners"], [("anchor", np.int64), ("context", np.int64), ("window", np.int32)])[hit]
                own = own[own["window"] >= 0]
                yield pa.RecordBatch.from_arrays([pa.array(own["anchor"]), pa.array(own["context"]), pa.array(own["window"]), pa.array(own["window"] + np.int32(length))], ["anchor", "context", "lo", "hi"])

    across = covered.where("range is not null").select("range", "keys", "owners").repartition("range").sortWithinPartitions("range").mapInArrow(merge, "anchor long, context long, lo int, hi int")
    # all windows of a context share its middle, so their union is one stretch
    stretch = cut(whole.unionByName(near).unionByName(across).groupBy("anchor", "context").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "stretches")
    hits = seen.join(stretch, ["anchor", "context"]).select("k1", "k2", (F.col("start") + F.col("lo")).cast("int").alias("lo"), (F.col("start") + F.col("hi")).cast("int").alias("hi"))
    # repeated rows give one span many times: first one a start, so that a list holds a text's own spans alone
    hits = hits.groupBy("k1", "k2", "lo").agg(F.max("hi").alias("hi"))
    spans = hits.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 400):
                batch = whole.slice(at, 400)
                out = []
                for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                    data, kept, end, removed, runs = (text or "").encode(), [], 0, 0, 0
                    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                        if lo > end or not runs:
                            kept.append(data[end:lo])
                            runs += 1
                            removed += hi - lo
                            end = hi
                        elif hi > end:
                            removed += hi - end
                            end = hi
                    kept = b"".join([*kept, data[end:]])
                    out.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
                cols = [pa.array([x[i] for x in out], k) for i, k in ((0, pa.int64()), (1, pa.int64()), (2, pa.int64()), (3, pa.string()))] + [pa.array([x[2] > 0 for x in out])]
                cols += [batch.column(c) for c in more]
                cols += [pa.array([x[4].decode(errors="ignore") for x in out], pa.string())] * with_text
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *cols], names)

    more = [c for c in beside.columns if c not in ("k1", "k2")] if beside is not None else []
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats", *more] + ["text"] * with_text
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeats boolean" + "".join(f", {c} long" for c in more) + ", text string" * with_text
    rows = keyed.join(spans, ["k1", "k2"], "left")
    if more:
        rows = rows.join(beside, ["k1", "k2"], "left")
    return rows.select("doc_id", "text", "spans", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in more)).mapInArrow(final, schema)
