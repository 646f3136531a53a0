"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its
context and only that reply is trained on.  Turns after the last reply give one
example more, with nothing to train on, so that every turn is in one.

`prefix_targets` gives each turn its piece of the transcript and offsets;
`expanded` makes the examples, whole texts, as the turns stream by in order: a task
holds the transcript of one conversation, and examples leave it in portions.  Their
texts grow with the square of a conversation's turns, as the method has it; they
aren't shuffled.

Template: `<turn role="R">` text `</turn>` newline.  In roles and texts `&`, `<`
and `"` are written as entities, so no control string can appear inside and the
text can be read back exactly.

Cases: null text is empty, null role is the empty role, null turns come first,
equal turns are ordered by role and text, repeated rows are separate turns,
null conv_id is a conversation of its own, an empty table gives no rows and
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = '<turn role="', '">', "</turn>\n"
PIECE = re.compile(r'<turn role="([^"]*)">([^<]*)</turn>\n')


def escaped(column: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        column = F.replace(column, F.lit(plain), F.lit(entity))
    return column


def unescaped(text: str) -> str:
    return text.replace("&quot;", '"').replace("&lt;", "<").replace("&amp;", "&")


def prefix_targets(turns: DataFrame) -> DataFrame:
    """One row per turn: piece, its offset in the transcript, whether it is the last, and, for a reply, its example and loss mask."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select(
        "conv_id", "turn", role.alias("role"), F.concat(F.lit(OPEN), escaped(role), F.lit(MIDDLE)).alias("head"), escaped(text).alias("body")
    ).withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reply = F.col("role") == "assistant"
    return (
        rows.withColumn("start", F.sum(F.length("piece")).over(so_far) - F.length("piece"))
        .withColumn("example", F.when(reply, F.sum(reply.cast("long")).over(so_far)))
        .withColumn("last", F.lead("piece").over(order).isNull())
        .select(
            "conv_id", "turn", "role", "piece", "start", "example", "last",
            F.when(reply, F.col("start") + F.length("head")).alias("target_start"),
            F.when(reply, F.col("start") + F.length("head") + F.length("body")).alias("target_end"),
        )
    )


#: Characters of example texts that leave a task together.
PORTION = 4 << 20


def expanded(turns: DataFrame) -> DataFrame:
    """The examples: conv_id, example (from 1; null: no reply), text, target_start and target_end (the loss mask), last (of its conversation).

    A conversation's examples lie in one partition, in order.
    """
    names = ["conv_id", "example", "text", "target_start", "target_end", "last"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[str] = []
        out: list[tuple] = []
        size = 0
        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in ("conv_id", "piece", "example", "target_start", "target_end", "last")]
            for conv, piece, example, lo, hi, last in zip(*cols, strict=True):
                pieces.append(piece)
                if example is not None or last:
                    pieces = ["".join(pieces)]
                    out.append((conv, example, pieces[0], lo, hi, last))
                    size += len(pieces[0])
                if last:
                    pieces = []
                if size > PORTION:
                    yield batch_of(out, kinds, names)
                    out, size = [], 0
        if out:
            yield batch_of(out, kinds, names)

    rows = prefix_targets(turns).select("conv_id", "piece", "example", "target_start", "target_end", "last")
    return rows.mapInArrow(run, "conv_id long, example long, text string, target_start long, target_end long, last boolean")


def batch_of(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)


def read_back(examples: DataFrame) -> DataFrame:
    """Digests per conversation, read from the examples' texts and masks."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, n_loss, chars, n = hashlib.sha256(), 0, 0, 0
        for batch in batches:
            done: list[tuple] = []
            cols = [batch.column(n).to_pylist() for n in ("conv_id", "text", "target_start", "target_end", "last")]
            for conv, text, lo, hi, last in zip(*cols, strict=True):
                chars, n = chars + len(text), n + 1
                if lo is not None:
                    reply = unescaped(text[lo:hi])
                    n_loss += len(reply)
                    loss.update(reply.encode())
                if last:  # this example holds all turns
                    found = PIECE.findall(text)
                    every = hashlib.sha256("".join(f"{unescaped(role)}\n{unescaped(body)}\n" for role, body in found).encode())
                    done.append((conv, len(found), every.hexdigest(), n_loss, loss.hexdigest(), chars, n))
                    loss, n_loss, chars, n = hashlib.sha256(), 0, 0, 0
            if done:
                yield batch_of(done, kinds, names)

    return examples.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")
