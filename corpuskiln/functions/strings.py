"""String measures that Spark lacks, as Arrow-batched functions."""

from __future__ import annotations

import difflib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Cells of two strings, and the length of a match, up to which places are held as bits.
MOST_CELLS, MOST_LENGTH = 1 << 22, 64


def matching(a: str, b: str) -> int | None:
    """Characters in the matching blocks of difflib.SequenceMatcher(None, a, b), or None where these strings are too long for
    it. Where a run of characters of a stands in b is a whole number with a bit for each end; the runs of each length are
    found once, from those that are shorter by one, and looked through by every part that a match leaves."""
    if len(a) * len(b) > MOST_CELLS:
        return None
    seen = Counter(b)
    if popular := len(b) >= 200:  # then difflib begins a match at rare characters only
        seen = {c: n for c, n in seen.items() if n <= len(b) // 100 + 1}
    ends = dict.fromkeys(seen, 0)
    for c in ends:
        j = b.find(c)
        while j >= 0:
            ends[c] |= 1 << j
            j = b.find(c, j + 1)
    levels: list[tuple[list[int], list[int]]] = [([], [])]
    runs = {i: ends[c] for i, c in enumerate(a) if c in ends}
    while runs:
        if len(levels) > MOST_LENGTH:
            return None
        levels.append((list(runs), list(runs.values())))
        runs = {i + 1: m for i, x in runs.items() if i + 1 < len(a) and (m := x << 1 & ends.get(a[i + 1], 0))}
    total, left = 0, [(0, len(a), 0, len(b), len(levels) - 1)]
    while left:
        alo, ahi, blo, bhi, most = left.pop()
        i, j, size = alo, blo, 0
        for most in range(min(most, ahi - alo, bhi - blo), 0, -1):
            rows, places = levels[most]
            inside = (1 << bhi) - (1 << (blo + most - 1))
            for k in range(bisect_left(rows, alo + most - 1), bisect_left(rows, ahi)):
                if m := places[k] & inside:  # of the longest matches the first in a, then in b
                    i, j, size = rows[k] - most + 1, (m & -m).bit_length() - most, most
                    break
            if size:
                break
        if popular:
            while i > alo and j > blo and a[i - 1] == b[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
                size += 1
        if size:
            total += size
            if alo < i and blo < j:
                left.append((alo, i, blo, j, most))
            if i + size < ahi and j + size < bhi:
                left.append((i + size, ahi, j + size, bhi, most))
    return total


def ratio(a: str, b: str) -> float:
    """difflib.SequenceMatcher(None, a, b).ratio()."""
    if a == b:
        return 1.0
    n = matching(a, b)
    return difflib.SequenceMatcher(None, a, b).ratio() if n is None else 2.0 * n / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def similarity(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratio of matching blocks of two strings (0 to 1); null if one of them is. Spark itself has edit distance only."""
    for x, y in parts:
        yield pd.Series([None if p is None or q is None else ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")
