"""Tokens, tags and letters of a text in Python, the same as those of the column expressions in `text`.

A word's letter is looked up, so the tagger runs once for each distinct word and process; the table of
known words is emptied when it holds `MOST` of them.  Cases: a null or empty text has no tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa

from lexigraph.functions import text as T

_SPACE = re.compile(f"[{T.SPACES}]+")
_PIECE = re.compile(f" ?(?:[0-9]+|[{T._MARKS}]|[^0-9{T._MARKS} ]+)")
_TAGS = {w: tag for tag, ws in T.LEXICON.items() for w in ws}
#: Fixed value: words that a process keeps.
MOST = 200_000


def pieces(text: str | None) -> list[str]:
    """Tokens, each with the blank before it."""
    return _PIECE.findall(_SPACE.sub(" ", text).strip(" ")) if text else []


def marked(piece: str) -> str:
    """A token as a graph word."""
    return "▁" + piece[1:] if piece[0] == " " else piece


def plain(piece: str) -> str:
    return piece[1:] if piece[0] in " ▁" else piece


def part_of_speech(word: str) -> str:
    """The tagger of `text.part_of_speech_sql`."""
    low, first = word.lower(), word[:1]
    if tag := _TAGS.get(low):
        return tag
    if first and first in "0123456789":
        return "CD"
    if len(word) == 1 and low == word.upper():
        return ":"
    for end, tag in T.SUFFIXES:
        if low.endswith(end):
            return tag
    return "NNP" if first != first.lower() else "NNS" if low.endswith("s") else "NN"


class Letters(dict):
    """The letter of each word by its tag; ends of sentences are E, tags without a letter O."""

    def __init__(self, letters: dict[str, str], ends: Iterable[str] = ()):
        super().__init__()
        self.letters, self.ends = letters, frozenset(ends)

    def __missing__(self, word: str) -> str:
        if len(self) >= MOST:
            self.clear()
        out = self[word] = "E" if word in self.ends else self.letters.get(part_of_speech(word), "O")
        return out

    def of(self, words: list[str]) -> str:
        return "".join(map(self.__getitem__, words))


def parts(batches: Iterable[pa.RecordBatch], size: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in parts of so many rows, so that what is found in a part is small."""
    for batch in batches:
        for lo in range(0, len(batch), size):
            yield batch.slice(lo, size)
