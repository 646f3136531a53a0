"""Packing by concatenating and cutting: all documents are one line of tokens, cut into windows of equal length.

First pass: each task turns its texts into ids, keeps the number of ids before
each document in its own partition, and writes both; texts are read once and
never shuffled.  The partitions' totals (a row each) are summed up in order,
which gives every partition its global offset.  Second pass: a document starts
at that offset plus its own, and is cut where windows end; every piece is a
boundary record that says which ids of which document stand where.  Only the
last window isn't full, so a corpus has less than one window of padding.

The line follows the order in which Spark reads the files.  A document may be
cut anywhere; each of its ids lies in exactly one piece.

Ids are those of the tokenizers library.  Where the same vocabulary is given as
ranks too, texts of plain characters (`PLAIN`, on whose classes both libraries
agree) without special tokens are encoded from the ranks by the tiktoken library,
which gives the same ids in a third of the time; all other texts go to the
tokenizers library.

Cases: null and empty texts have the end id alone; a null doc_id stays null; very
long texts are many pieces; repeated rows are documents each; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LENGTH = 2048
END = 1


#: Texts of these characters fall into the same words in both libraries.
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa0-\\u024f\\u2010-\\u201f\\u2026]*")


class Encoder:
    """Ids of texts as bytes, little-endian, `kind` each."""

    def __init__(self, tokenizer: str, ranks: tuple[str, str] | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(tokenizer), None
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if ranks:
            import tiktoken

            path, pattern = ranks
            with open(path, "rb") as file:
                known = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})

    def ids(self, texts: list[str | None], end: int) -> list[bytes]:
        """The ids of each text, with the end id."""
        plain = [self.fast is not None and PLAIN.fullmatch(t or "") is not None and not any(s in (t or "") for s in self.special) for t in texts]
        other = iter(self.tokenizer.encode_batch_fast([t or "" for t, ok in zip(texts, plain, strict=True) if not ok], add_special_tokens=False))
        last = np.array([end], self.kind)
        found = [self.fast.encode_to_numpy(t or "", disallowed_special=()) if ok else np.array(next(other).ids) for t, ok in zip(texts, plain, strict=True)]
        return [np.append(x.astype(self.kind), last).tobytes() for x in found]


def token_lines(documents: DataFrame, tokenizer: str, end: int = END, ranks: tuple[str, str] | None = None) -> DataFrame:
    """part, before (ids before it in its partition), doc_id, doc_tokens, width (bytes of an id), ids: written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, before = Encoder(tokenizer, ranks), TaskContext.get().partitionId(), 0
        width = np.dtype(encoder.kind).itemsize
        for whole in batches:
            for start in range(0, len(whole), 200):
                batch = whole.slice(start, 200)
                ids = encoder.ids(batch.column("text").to_pylist(), end)
                sizes = [len(x) // width for x in ids]
                firsts = [before, *(before + np.cumsum(sizes)).tolist()]
                before = firsts.pop()
                cols = [pa.array([part] * len(ids), pa.int64()), pa.array(firsts, pa.int64()), batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "before", "doc_id", "doc_tokens", "width", "ids"])

    return cut(documents.select("doc_id", "text").mapInArrow(run, "part long, before long, doc_id long, doc_tokens long, width int, ids binary"), "token-lines")


def pack(documents: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, with_ids: bool = False, ranks: tuple[str, str] | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded_length, and ids if `with_ids`.

    tokenizer: the file of the tokenizers library; ranks: the file of the same vocabulary as ranks, and the pattern of its words.
    A window is padded to `length`, except where its own number of tokens is a power of two.
    """
    lines = token_lines(documents, tokenizer, end, ranks)
    sums = lines.groupBy(F.col("part").alias("p")).agg(F.sum("doc_tokens").alias("n"))
    # a row a partition; written, so that Spark knows its size and needn't move ids to join it
    every = Window.orderBy("p")
    sums = sums.select("p", F.coalesce(F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    sums = cut(sums, "token-sums")
    placed = lines.join(sums, F.col("part") == F.col("p")).select("doc_id", "doc_tokens", "width", "ids", (F.col("base") + F.col("before")).alias("at"), "total")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_length"]
    schema = ", ".join(f"{n} long" for n in names) + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 500):
                rows, own = [], []
                for r in whole.slice(first, 500).to_pylist():
                    n, at, total = r["doc_tokens"], r["at"], r["total"]
                    ids, start = memoryview(np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4").tobytes()), 0
                    while start < n:
                        sequence, offset = divmod(at + start, length)
                        size = min(n - start, length - offset)
                        piece = ids[4 * start : 4 * (start + size)]
                        full = min(length, total - sequence * length)
                        rows.append((r["doc_id"], start, size, zlib.crc32(piece), n, sequence, offset, full, full if full & (full - 1) == 0 else length))
                        if with_ids:
                            own.append(bytes(piece))
                        start += size
                cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(own, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return placed.mapInArrow(run, schema)


def sequences(pieces: DataFrame, pad: int = END) -> DataFrame:
    """sequence_id, ids (array, padded), n_tokens, boundaries (offset, doc_id, start of each piece, by offset) from pieces with ids; a window has at most its length of pieces."""
    piece = F.struct("offset", "doc_id", "start", F.hex("ids").alias("hex"))
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.first("sequence_tokens").alias("n_tokens"), F.first("padded_length").alias("padded"))
    line = F.array_join(F.transform("p", lambda x: x["hex"]), "")
    byte = lambda k, b: F.substr(line, (k * 8 + 1 + 2 * b).cast("int"), F.lit(2))
    value = lambda k: F.conv(F.concat(byte(k, 3), byte(k, 2), byte(k, 1), byte(k, 0)), 16, 10).cast("int")
    ids = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1), value)
    filled = F.concat(ids, F.array_repeat(F.lit(pad), (F.col("padded") - F.col("n_tokens")).cast("int")))
    return rows.select("sequence_id", filled.alias("ids"), "n_tokens", F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["doc_id"].alias("doc_id"), x["start"].alias("start"))).alias("boundaries"))
