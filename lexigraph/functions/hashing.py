"""Identity hashes: 64-bit arithmetic that wraps, which column expressions can't do, on whole Arrow batches with numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# The mixing constants of the identity hashes.
MIX_ONE = np.uint64(0xFF51AFD7ED558CCD)
MIX_TWO = np.uint64(0xC4CEB9FE1A85EC53)
COMBINE = np.uint64(0x9E3779B9)
SHIFT = np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> SHIFT)) * MIX_ONE
    h = (h ^ (h >> SHIFT)) * MIX_TWO
    return h ^ (h >> SHIFT)


def combine(h: np.ndarray, v: np.ndarray) -> np.ndarray:
    return h ^ (v + COMBINE + (h << np.uint64(6)) + (h >> np.uint64(2)))


def fold(rows: list[np.ndarray]) -> np.ndarray:
    """Hash of each row of numbers: its length mixed, then each number combined, all rows in step."""
    sizes = np.array([len(r) for r in rows], np.uint64)
    out = mix(sizes)
    order = np.argsort(-sizes.astype(np.int64), kind="stable")
    most = int(sizes.max(initial=0))
    table = np.zeros((most, len(rows)), np.uint64)
    for i, r in enumerate(rows):
        table[: len(r), i] = r
    for k in range(most):
        live = order[: np.searchsorted(-sizes[order].astype(np.int64), -k, side="left")]
        out[live] = combine(out[live], table[k, live])
    return out


def hash_texts(texts: list[str | None]) -> np.ndarray:
    """Over UTF-16 units; null is the empty text."""
    return fold([np.frombuffer((t or "").encode("utf-16-le"), np.uint16).astype(np.uint64) for t in texts])


def hash_paths(paths: list[list[int]]) -> np.ndarray:
    """Over numbers; a path of one is that number."""
    rows = [np.array(p, np.int64).view(np.uint64) for p in paths]
    out = fold(rows)
    for i, r in enumerate(rows):
        if len(r) == 1:
            out[i] = r[0]
    return out


@F.pandas_udf(LongType())
def text_hash(texts: pd.Series) -> pd.Series:
    return pd.Series(hash_texts(texts.tolist()).view(np.int64))


@F.pandas_udf(LongType())
def path_hash(paths: pd.Series) -> pd.Series:
    return pd.Series(hash_paths([list(p) for p in paths]).view(np.int64))


@F.pandas_udf(LongType())
def edge_hash(flavour: pd.Series, i: pd.Series, j: pd.Series) -> pd.Series:
    first = mix(flavour.to_numpy(np.int64).view(np.uint64))
    return pd.Series(combine(combine(first, i.to_numpy(np.int64).view(np.uint64)), j.to_numpy(np.int64).view(np.uint64)).view(np.int64))
