"""Characters that look alike as one character.

A table maps single code points to a normal form of one code point, so that places in code points stay;
control characters below U+0020 become blanks.  `normalised` is one JVM-side translation;
`changed` gives each changed character with its places in bytes before and after.

Cases: null texts stay null, and have no changed characters; so do empty ones; repeated rows have
rows each; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like Latin ones, and signs that look like those of ASCII.
LETTERS = {"а": "a", "е": "e", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "ѕ": "s", "у": "y", "х": "x", "ο": "o", "ν": "v"}
SIGNS = {"’": "'", "‘": "'", "‛": "'", "′": "'", "“": '"', "”": '"', "„": '"', "″": '"', "−": "-", "⁄": "/", "∶": ":", "∗": "*"}
COLUMNS = "doc_id long, original string, normal string, ci long, i long, j long, normal_i long, normal_j long"


def by_rule() -> dict[str, str]:
    """Blanks and line separators, dashes, and full-width forms of ASCII by their Unicode classes; letters and signs as listed."""
    table = {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        kind = unicodedata.category(c)
        if kind in ("Zs", "Zl", "Zp"):
            table[c] = " "
        elif kind == "Pd":
            table[c] = "-"
        elif 0xFF01 <= ord(c) <= 0xFF5E:
            table[c] = chr(ord(c) - 0xFEE0)
    return table | LETTERS | SIGNS


def parsed(lines: Iterable[str]) -> dict[str, str]:
    """The table of a file in the form of Unicode's summary of confusables.

    Groups end at comments and empty lines; each line has the code points in hexadecimal as one of its fields between tabs. The first
    single code point of a group is the normal form of its others; sequences of several are left out.
    """
    table: dict[str, str] = {}
    group: list[str] = []
    for line in [*lines, ""]:
        line = line.strip("﻿\r\n")
        codes = next((x.strip() for x in line.split("\t") if re.fullmatch(r"\s*[0-9A-Fa-f]{4,6}(?: [0-9A-Fa-f]{4,6})*\s*", x)), None)
        if not line.strip() or line.lstrip().startswith("#"):
            table |= {c: group[0] for c in group[1:]}
            group = []
        elif codes and " " not in codes:
            group.append(chr(int(codes, 16)))
    return table


def whole(table: dict[str, str] | None = None) -> dict[str, str]:
    """A table (by default the one by rule) with the control characters; names and forms that aren't one code point are an error."""
    table = by_rule() if table is None else table
    if wrong := [k for k, v in table.items() if len(k) != 1 or len(v) != 1]:
        raise ValueError(f"one code point for another, not {wrong}")
    return {chr(c): " " for c in range(32)} | table


def normalised(text: str = "text", table: dict[str, str] | None = None) -> Column:
    known = whole(table)
    return F.translate(F.col(text), "".join(known), "".join(known.values()))


def changed(texts: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """A row for each character of texts (doc_id, text) that the table changes: ci counts code points, i and j are bytes, normal_i and normal_j those of the normal text."""
    known = whole(table)
    keys = np.array(sorted(map(ord, known)), np.uint32)
    forms = np.array([ord(known[chr(k)]) for k in keys], np.uint32)
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def starts(points: np.ndarray) -> np.ndarray:
        return np.r_[0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
                k = np.minimum(np.searchsorted(keys, points), len(keys) - 1)
                hit = np.flatnonzero((keys[k] == points) & (forms[k] != points))
                if not len(hit):
                    continue
                after = points.copy()
                after[hit] = forms[k[hit]]
                own, new = starts(points), starts(after)
                letters = lambda x: pa.array([chr(c) for c in x[hit]])
                columns = [pa.array([doc] * len(hit), pa.int64()), letters(points), letters(after), *(pa.array(x.astype(np.int64)) for x in (hit, own[hit], own[hit + 1], new[hit], new[hit + 1]))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COLUMNS)
