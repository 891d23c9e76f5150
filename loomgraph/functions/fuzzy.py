"""Similarity of strings by matching blocks, which Spark has no expression for: worked out for whole batches of pairs at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Cells of the matrices that are worked on together.
CELLS = 1 << 22


def _codes(texts: list[str], fill: int) -> np.ndarray:
    """Code points as rows, with ``fill`` behind the shorter ones."""
    sizes = np.array([len(text) for text in texts])
    out = np.full((len(texts), max(1, int(sizes.max(initial=0)))), fill, np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length and places of the longest common run of each two rows: the first in ``a`` of equal ones, then the first in ``b``."""
    n, width = b.shape
    run = np.zeros((n, width + 1), np.int32)
    best, at_a, at_b = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    rows = np.arange(n)
    for i in range(a.shape[1]):
        new = np.zeros_like(run)
        new[:, 1:] = np.where(b == a[:, i : i + 1], run[:, :-1] + 1, 0)
        j = np.argmax(new, axis=1)
        most = new[rows, j]
        better = most > best
        best[better], at_a[better], at_b[better] = most[better], i + 1 - most[better], j[better] - most[better]
        run = new
    return best, at_a, at_b


def matched_characters(pairs: list[tuple[str, str]]) -> np.ndarray:
    """How many characters matching blocks cover: the longest common run, and the same again on either side of it."""
    total = np.zeros(len(pairs), np.int64)
    open_ = [(k, a, b) for k, (a, b) in enumerate(pairs) if a and b]
    while open_:
        open_.sort(key=lambda part: (len(part[1]), len(part[2])))
        further: list[tuple[int, str, str]] = []
        at = 0
        while at < len(open_):
            end, wide = at, 0
            while end < len(open_):
                wide = max(wide, len(open_[end][1]), len(open_[end][2]))
                if end > at and (end - at + 1) * wide > CELLS:
                    break
                end += 1
            part = open_[at:end]
            size, i, j = _longest(_codes([a for _, a, _ in part], -1), _codes([b for _, _, b in part], -2))
            for (k, a, b), n, x, y in zip(part, size.tolist(), i.tolist(), j.tolist(), strict=True):
                if n:
                    total[k] += n
                    further += [(k, left, right) for left, right in ((a[:x], b[:y]), (a[x + n :], b[y + n :])) if left and right]
            at = end
        open_ = further
    return total


@F.pandas_udf(DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over the lengths together, 1 for two empty texts; null if either is null."""
    given = (a.notna() & b.notna()).to_numpy()
    pairs = list(dict.fromkeys(zip(a[given], b[given], strict=True)))
    lengths = np.array([len(x) + len(y) for x, y in pairs])
    ratios = np.where(lengths > 0, 2.0 * matched_characters(pairs) / np.maximum(lengths, 1), 1.0)
    known = dict(zip(pairs, ratios.tolist(), strict=True))
    return pd.Series([known[x, y] if ok else None for x, y, ok in zip(a, b, given, strict=True)], dtype="float64")
