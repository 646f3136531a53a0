"""Quality classifier: a byte-level convolutional network in numpy.

Input symbols are the bytes of a text, each with one bit that says whether the
bytes before it repeat at a short distance.  Learned filters `taps` symbols wide
run over the whole text; the text is covered by chunks of 512 bytes that overlap
by half, the filters' outputs are max-pooled over each chunk, a chunk gets a
logit, and the mean of the logits of all chunks gives one probability.

The network is fitted on a bounded sample of labelled rows (`sample` documents,
chosen by hash); scoring reads every byte of every document.

Cases: null and empty texts are scored as a few zero bytes; a label that is null
isn't learned from; without usable labels every score is 0.5; several labels of
a document all count; repeated rows are scored each; very long texts are scored
in blocks and pooled; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, fold

HALF = 256
REPEAT_RUN, REPEAT_LAGS = 8, range(2, 33)
#: Zero bytes between texts: no filter or repeat reaches over them, so a score doesn't depend on a text's neighbours.
PAD = 40


def symbols(data: np.ndarray) -> np.ndarray:
    """Bytes plus 256 where the last REPEAT_RUN bytes also stand at one of the lags before."""
    again = np.zeros(len(data), bool)
    for lag in REPEAT_LAGS:
        same = data[lag:] == data[:-lag] if len(data) > lag else np.zeros(0, bool)
        step = 1
        while step < REPEAT_RUN:
            same = same[step:] & same[:-step] if len(same) > step else same[:0]
            step *= 2
        if len(same):
            again[lag + REPEAT_RUN - 1 :] |= same
    return data.astype(np.int16) + again.astype(np.int16) * 256


class ByteNet:
    """Embedding of 512 symbols, `filters` convolutions of `taps` symbols, chunk max-pooling, mean logit."""

    def __init__(self, filters: int = 16, taps: int = 6, size: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.taps = taps
        self.w = {
            "embed": rng.normal(0, 0.5, (512, size)),
            "conv": rng.normal(0, 1 / np.sqrt(taps * size), (taps, size, filters)),
            "bias": np.zeros(filters),
            "out": rng.normal(0, 0.3, filters),
            "out_bias": np.zeros(1),
        }

    def tables(self) -> np.ndarray:
        """Embedding and filters as one table a tap: symbol -> filter outputs."""
        return np.einsum("se,tef->tsf", self.w["embed"], self.w["conv"]).astype(np.float32)

    def pooled(self, texts: list[bytes], tables: np.ndarray, where: bool = False):
        """Max-pooled outputs of every half chunk, the halves' document, and their argmax position if `where`."""
        pad = b"\0" * PAD
        starts, parts, owner, at = [], [pad], [], PAD
        for i, t in enumerate(texts):
            n = len(t) + 1
            own = np.arange(at, at + n, HALF)
            own[0] -= self.taps - 1  # so that the text before ends where its padding does
            starts.append(own)
            owner.append(np.full(len(own), i))
            parts.append(t + pad)
            at += len(t) + PAD
        data = np.frombuffer(b"".join(parts), np.uint8)
        sym = symbols(data)
        n = len(sym) - self.taps + 1
        starts, owner = np.concatenate(starts), np.concatenate(owner)
        if not where:
            out = np.empty((len(starts), tables.shape[2]), np.float32)
            # about 64 halves at a time, so that the working set stays in the cache
            for a in range(0, len(starts), 64):
                lo, hi = starts[a], min(n, starts[a + 64] if a + 64 < len(starts) else n)
                acc = np.take(tables[0], sym[lo:hi], axis=0)
                for k in range(1, self.taps):
                    acc += np.take(tables[k], sym[lo + k : hi + k], axis=0)
                out[a : a + 64] = np.maximum.reduceat(acc, starts[a : a + 64] - lo, axis=0)
            return np.maximum(out + self.w["bias"].astype(np.float32), 0), owner
        acc = sum(np.take(tables[k], sym[k : n + k], axis=0) for k in range(self.taps))
        stops = np.append(starts[1:], n)
        best = np.stack([lo + acc[lo:hi].argmax(0) for lo, hi in zip(starts, stops, strict=True)])
        return np.maximum(np.take_along_axis(acc, best, 0) + self.w["bias"], 0), owner, best, sym

    @staticmethod
    def chunked(half: np.ndarray, owner: np.ndarray):
        """Halves -> overlapping chunks (each half with the next of its document; a lone half alone): left and right half, document."""
        follows = np.append(owner[1:] == owner[:-1], False)
        first = np.append(True, owner[1:] != owner[:-1])
        left = np.flatnonzero(follows | (first & ~follows))
        right = np.where(follows[left], left + 1, left)
        return left, right, owner[left]

    def logits(self, texts: list[bytes], tables: np.ndarray | None = None) -> np.ndarray:
        half, owner = self.pooled(texts, self.tables() if tables is None else tables)
        left, right, doc = self.chunked(half, owner)
        chunk = np.maximum(half[left], half[right]) @ self.w["out"] + self.w["out_bias"]
        return np.bincount(doc, chunk, len(texts)) / np.bincount(doc, minlength=len(texts))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 48, rate: float = 0.01, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                grads = self.gradient([texts[i] for i in pick], labels[pick])
                step += 1
                now = rate * (1 if epoch < epochs // 2 else 0.3)
                for k, g in grads.items():
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.w[k] -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def gradient(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        half, owner, best, sym = self.pooled(texts, self.tables(), where=True)
        left, right, doc = self.chunked(half, owner)
        take_right = half[right] > half[left]
        pooled = np.where(take_right, half[right], half[left])
        count = np.bincount(doc, minlength=len(texts))
        logit = np.bincount(doc, pooled @ self.w["out"] + self.w["out_bias"], len(texts)) / count
        d_chunk = ((1 / (1 + np.exp(-logit)) - labels) / count / len(texts))[doc]
        d_pool = d_chunk[:, None] * self.w["out"] * (pooled > 0)
        d_half = np.zeros_like(half)
        np.add.at(d_half, left, np.where(take_right, 0, d_pool))
        np.add.at(d_half, right, np.where(take_right, d_pool, 0))
        d_table = np.zeros((self.taps, 512, half.shape[1]))
        f = np.broadcast_to(np.arange(half.shape[1]), best.shape)
        for k in range(self.taps):
            np.add.at(d_table[k], (sym[best + k], f), d_half)
        return {
            "embed": np.einsum("tsf,tef->se", d_table, self.w["conv"]),
            "conv": np.einsum("se,tsf->tef", self.w["embed"], d_table),
            "bias": d_half.sum(0),
            "out": pooled.T @ d_chunk,
            "out_bias": d_chunk.sum(keepdims=True),
        }


def train(documents: DataFrame, labels: DataFrame, sample: int = 3000) -> ByteNet:
    """Fit on at most `sample` labelled rows outside the held-out fold (crc32 of the id, modulo 5, is 0)."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0)).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").toArrow()
    net = ByteNet()
    if not len(rows):
        net.w["out"][:] = 0
        return net
    rows = sorted(zip(rows["doc_id"].to_pylist(), [(t or "").encode() for t in rows["text"].to_pylist()], rows["quality"].to_pylist(), strict=True))
    net.fit([r[1] for r in rows], np.array([float(r[2] > 0) for r in rows]))
    return net


def score_quality(documents: DataFrame, net: ByteNet, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables()
        for batch, texts in blocks(batches):
            score = 1 / (1 + np.exp(-net.logits(texts, tables)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = documents.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, net: ByteNet, threshold: float = 0.3) -> DataFrame:
    """The rows whose score reaches the threshold, unchanged."""
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables()
        for batch, texts in blocks(batches):
            score = 1 / (1 + np.exp(-net.logits(texts, tables)))
            yield batch.filter(pa.array(score >= threshold))

    return documents.mapInArrow(run, documents.schema)
