"""Periodic runs: stretches of a text that repeat with a period, found by bit-parallel comparison at each lag.

The words of a text get dense numbers; each bit of the numbers is a plane, one long integer with a bit for each word. At
lag q the planes are XORed with themselves shifted by q; the OR of these has a one wherever words q apart differ. Zero
stretches of max(least - q, q) words or more are the runs; they are isolated by ANDs of the complement with itself under
shifts that double. A text is a row, so nothing is shuffled and no two texts meet.

Comparing all lags costs the square of the words. Lags of SMALL or more are therefore compared only if they can have a
run: a zero stretch of a lag in [2k, 4k) holds a block of k words that starts at a multiple of k, and that block stands
again at the lag. Blocks are compared by hashes for each k = 16, 32, 64, ...; that costs the words times the number
of k, and hashes only choose lags, so they can't change a result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary_list, map_batches, mix64, pinned, words_of

#: All lags below are compared; k starts at half of it.
SMALL = 32
#: Multiplier of the blocks' polynomial hashes, modulo 2 ** 64; odd.
_BASE = 0x9E3779B97F4A7C15
#: Planes that are compared before a lag without any long stretch is given up.
_FIRST_PLANES = 4


def planes_of(ids: np.ndarray) -> list[int]:
    """The bits of the ids, lowest first, each as an integer whose bit i belongs to word i."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> b) & 1, bitorder="little").tobytes(), "little") for b in range(width)]


def _long_stretches(ones: int, least: int) -> int:
    """The places at which least ones or more begin."""
    have = 1
    while have < least and ones:
        step = min(have, least - have)
        ones &= ones >> step
        have += step
    return ones


def equal_stretches(planes: list[int], n: int, lag: int, least: int) -> np.ndarray:
    """(first, length) of the maximal stretches of least places or more at which words lag apart are the same."""
    every, differ = (1 << (n - lag)) - 1, 0
    for i, plane in enumerate(planes):
        differ |= plane ^ (plane >> lag)
        if i + 1 == _FIRST_PLANES < len(planes) and not _long_stretches(every & ~differ, least):
            return np.zeros((0, 2), np.int64)
    found = _long_stretches(every & ~differ, least)
    if not found:
        return np.zeros((0, 2), np.int64)
    bits = np.unpackbits(np.frombuffer(found.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")
    edge = np.flatnonzero(np.diff(np.concatenate(([0], bits, [0])).astype(np.int8))).reshape(-1, 2)
    return np.stack((edge[:, 0], edge[:, 1] - edge[:, 0] + least - 1), 1)


def _likely_lags(block_hash: np.ndarray, k: int, n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Lags in [2k, 4k) at which a block of k words stands again.

    A block that lies with its repetition in a known run of period p <= k tells nothing: two periods p and q over p + q
    words or more make their greatest common divisor a period, so q would be no smallest period.
    """
    padded = np.concatenate((block_hash, np.zeros(4 * k, np.uint64)))
    first = np.arange(0, len(block_hash), k)
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * k)[2 * k :: k][: len(first)]
    row, column = np.nonzero(windows == block_hash[first][:, None])
    at, lag = first[row], 2 * k + column
    reach = np.zeros(n, np.int64)
    for start, length, period in runs:
        if period <= k:
            reach[start] = max(reach[start], start + length)
    reach = np.maximum.accumulate(reach)
    return np.unique(lag[(lag <= n // 2) & (at + lag + k > reach[at])])


def find_in(words: list[bytes], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a word sequence, by start, then period.

    A run has its smallest period q, at least max(least, 2 * q) words, and no neighbouring word that continues it.
    """
    n = len(words)
    if n < max(least, 2):
        return []
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    planes = planes_of(ids)
    runs: list[tuple[int, int, int]] = []
    taken: set[tuple[int, int]] = set()

    def compare(lag: int) -> None:
        for start, length in equal_stretches(planes, n, lag, max(least - lag, lag)).tolist():
            # the same stretch of words at a smaller lag: that lag divides this one
            if (start, length + lag) not in taken:
                taken.add((start, length + lag))
                runs.append((start, length + lag, lag))

    for lag in range(1, min(SMALL - 1, n // 2) + 1):
        compare(lag)
    if n // 2 >= SMALL:
        h, k, power = mix64(ids.astype(np.uint64) + np.uint64(1)), 1, _BASE
        while 2 * k <= n // 2:
            if 2 * k >= SMALL:
                for lag in _likely_lags(h, k, n, runs).tolist():
                    compare(lag)
            h = h[: len(h) - k] * np.uint64(power) + h[k:]
            power, k = power * power % 2**64, 2 * k
    return sorted(runs, key=lambda r: (r[0], r[2]))


def repeated(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """For each of n words, whether a run holds it after that run's first period."""
    cover = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return np.cumsum(cover[:-1]) > 0


def find_runs(docs: DataFrame, *, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs: array of (start, length, period) by start, then period; kept: the words that are no
    repetition, joined by one space.

    Words are those of [^\\x20\\x09-\\x0D]+ in the whole text, compared byte by byte. A null text has no words and no
    runs; kept is then empty, never null. Each row stands for itself: null, equal and repeated ids are fine, an
    empty table gives no rows. Columns other than the two named are ignored, whatever their names.
    """
    if least < 2:
        raise ValueError("least must be 2 or more")
    rows = pinned(docs, id_col, text_col).toDF("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, offsets, flat, kept = [], [0], [], []
            for text in binary_list(batch.column(1)):
                words = words_of(text)
                runs = find_in(words, least)
                sizes.append(len(words))
                flat.extend(runs)
                offsets.append(len(flat))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~repeated(runs, len(words)))] if runs else words))
            parts = np.array(flat, np.int64).reshape(-1, 3)
            found = pa.StructArray.from_arrays([pa.array(parts[:, c]) for c in range(3)], ["start", "length", "period"])
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "kept"],
            )

        return one

    return map_batches(rows, make, f"doc_id {id_type}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, kept string")


def longest(runs: str = "runs"):
    """The run with the greatest length; of equal ones the first, then that of the smaller period. Null without runs."""
    keyed = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = F.array_max(keyed)
    return F.when(F.size(runs) > 0, F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))
