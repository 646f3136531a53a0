"""SentencePiece encoding and decoding through a table of distinct chunks.

In this kind of model no piece continues from a letter into a white-space mark,
so a text falls into marked words (a run of marks and what follows it) that can
be segmented one by one.  Each task keeps a table of the marked words it has
met; every distinct one is segmented and decoded once by the library, and ids
are joined back by position.  The table is emptied when it reaches `table_size`
entries, which bounds memory and changes no result.  `check_model` proves for
a model that no piece crosses a mark.

Cases: null and empty texts have no ids; null doc_id stays null; very long
texts are one list of chunks; a chunk may be a whole text without spaces; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"


def check_model(model: str) -> None:
    """Raise ValueError if a piece holds a mark after another character."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for i in range(sp.get_piece_size()):
        if MARK in sp.id_to_piece(i).lstrip(MARK):
            raise ValueError(f"piece {i} crosses a white-space mark")


def chunks(text: str) -> list[str]:
    """The marked words of a text, without the first mark of each: what encode() is given, since it adds one mark itself.

    >>> chunks("a  b")
    ['a', ' b']
    """
    words, out, spaces = text.replace(MARK, " ").split(" "), [], ""
    for i, w in enumerate(words):
        if w or i == len(words) - 1:
            out.append(spaces + w)
            spaces = ""
        else:
            spaces += " "
    return out


class ChunkTable(dict):
    """Chunk -> (number of ids, ids joined by commas, decoded text)."""

    def __init__(self, processor, table_size: int):
        super().__init__()
        self.sp, self.most = processor, table_size
        mark = processor.piece_to_id(MARK)
        #: A mark with nothing behind it; encode() gives no ids for an empty text.
        self.lone = 1, str(mark), ""

    def texts(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of ids, ids joined by commas, and decoded text of each text."""
        if len(self) > self.most:
            self.clear()
        self[""] = self.lone
        split = [chunks(t) if t else [] for t in texts]
        new = list({c for cs in split for c in cs if c not in self})
        ids = self.sp.encode(new, num_threads=1)
        for chunk, own, text in zip(new, ids, self.sp.decode(ids, num_threads=1) if new else [], strict=True):
            self[chunk] = len(own), ",".join(map(str, own)), text
        out = []
        for cs in split:
            found = [self[c] for c in cs]
            out.append((sum([x[0] for x in found]), ",".join([x[1] for x in found]), " ".join([x[2] for x in found])))
        return out


def encode_documents(documents: DataFrame, model: str, table_size: int = 300_000, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and ids and decoded text if `with_ids`."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        table = ChunkTable(sentencepiece.SentencePieceProcessor(model_file=model), table_size)
        for whole in batches:
            for start in range(0, len(whole), 200):
                batch = whole.slice(start, 200)
                found = table.texts(batch.column("text").to_pylist())
                cols = [batch.column("doc_id").cast(pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.array([hashlib.sha256(x[1].encode()).hexdigest() for x in found], pa.string()), pa.array([hashlib.sha256(x[2].encode()).hexdigest() for x in found], pa.string())]
                if with_ids:
                    cols += [pa.array([[int(i) for i in x[1].split(",") if i] for x in found], pa.list_(pa.int32())), pa.array([x[2] for x in found], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(run, schema)
