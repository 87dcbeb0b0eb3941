"""Substring dedup: Rabin-Karp hashes of all 50-word windows, counted in Spark, merged into removal intervals.

A row for each window would be most of the work, so windows are counted in two steps that lose none. Every window has
a minimizer: the smallest hash among the shorter word runs inside it; equal windows have equal minimizers. A stretch
of consecutive windows with one minimizer is counted as one row by the hash of all its words. Only where different
stretches share a minimizer can a window repeat without its stretch; the windows of these stretches, one copy of
each, are counted one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import binary_list, hash_words, map_batches, mix64, words_of, write_table

WINDOW = 50
#: Words in the runs that minimizers are chosen from.
RUN = 16
#: Odd base of the rolling hash and its inverse, modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Rolling:
    """Rabin-Karp hashes of word runs by prefix sums, modulo 2 ** 64, over 64-bit word hashes."""

    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    def __init__(self, words: list[bytes]):
        h = hash_words(words)
        n = len(h)
        if len(Rolling._up) <= n:
            size = 1 << (n + 1).bit_length()
            Rolling._up, Rolling._down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, b, np.uint64))), dtype=np.uint64) for b in (BASE, INVERSE))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * self._down[:n], dtype=np.uint64)))

    def runs(self, size: int) -> np.ndarray:
        """The hash of every run of size words."""
        return mix64((self.sums[size:] - self.sums[:-size]) * self._up[: len(self.sums) - size])

    def between(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The hashes of words[start:stop]; runs of different lengths differ."""
        return mix64(mix64((self.sums[stop] - self.sums[start]) * self._up[start]) ^ (stop - start).astype(np.uint64))


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    step = 1
    while step * 2 <= size:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = size - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _stretches(words: list[bytes], window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """minimizer, hash, first window, number of windows of each stretch."""
    roll = Rolling(words)
    low = _sliding_min(roll.runs(run), window - run + 1)
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    n = np.diff(np.append(first, len(low)))
    return low[first], roll.between(first, first + n + window - 1), first, n


def text_key(text: Column) -> Column:
    """Tells the texts of one id apart: 64 bits of hash; null has a key, too."""
    return F.xxhash64(text, F.octet_length(text))


def repeated_spans(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, spans: the word intervals [s, e) of each document (only those with any) that windows cover which
    also start in a document with a smaller id. Sorted, maximal and disjoint.

    key is text_key() of the text: rows that share an id but not a text have spans of their own, equal rows have the
    same. Rows of one id aren't compared with one another. Rows with null ids and texts of fewer than window words give
    none.
    """
    run = min(RUN, window)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_key(F.col(f"`{text_col}`")).alias("key"), F.col(f"`{text_col}`").alias("text")).where("doc_id is not null")

    def make_stretches():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            got, at = [], []
            for i, text in enumerate(binary_list(batch.column(2))):
                words = words_of(text)
                if len(words) >= window:
                    got.append(_stretches(words, window, run))
                    at.append(np.full(len(got[-1][0]), i))
            if not got:
                return None
            low, all_, first, n = (np.concatenate(x) for x in zip(*got, strict=True))
            rows = pa.array(np.concatenate(at))
            parts = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(low.view(np.int64)), pa.array(all_.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))]
            return pa.RecordBatch.from_arrays(parts, ["doc_id", "key", "low", "hash", "first", "n"])

        return one

    found = write_table(map_batches(texts, make_stretches, f"doc_id {kind}, key bigint, low bigint, hash bigint, first int, n int"), "repeat-stretches")
    owners = write_table(found.groupBy("low", "hash").agg(F.min("doc_id").alias("owner")), "repeat-owners")
    mixed = owners.groupBy("low").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("low", F.lit(True).alias("mixed"))
    owners = write_table(owners.join(mixed, "low", "left"), "repeat-mixed")
    judged = found.join(owners, ["low", "hash"])
    whole = judged.where("doc_id > owner").select("doc_id", "key", F.struct(F.col("first").alias("s"), (F.col("first") + F.col("n") + (window - 1)).alias("e")).alias("x"))

    # one by one: windows of the first copy of each stretch that shares its minimizer with another stretch
    open_ = judged.where("doc_id = owner and mixed").groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "n")).alias("x"))
    open_ = open_.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("x.first").alias("first"), F.col("x.n").alias("n"))

    def make_windows():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            parts = []
            for i, (text, first, n) in enumerate(zip(binary_list(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                roll = Rolling(words_of(text))
                win, low = roll.runs(window), _sliding_min(roll.runs(run), window - run + 1)
                at = np.concatenate([np.arange(a, a + k) for a, k in zip(first, n, strict=True)])
                parts.append((np.full(len(at), i), low[at], win[at], at))
            row, low, win, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts = [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(low.view(np.int64)), pa.array(win.view(np.int64)), pa.array(at.astype(np.int32))]
            return pa.RecordBatch.from_arrays(parts, ["doc_id", "key", "low", "hash", "at"])

        return one

    joined = texts.join(open_, (texts["doc_id"] == open_["_id"]) & (texts["key"] == open_["_key"])).select("doc_id", "key", "text", "first", "n")
    single = write_table(map_batches(joined, make_windows, f"doc_id {kind}, key bigint, low bigint, hash bigint, at int"), "repeat-windows")
    firsts = single.groupBy("low", "hash").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("_last")).where("owner < _last").drop("_last")
    firsts = write_table(firsts, "repeat-firsts")
    part = single.join(firsts, ["low", "hash"]).where("doc_id > owner").select("doc_id", "key", F.struct(F.col("at").alias("s"), (F.col("at") + window).alias("e")).alias("x"))
    return whole.unionByName(part).groupBy("doc_id", "key").agg(merged(F.array_sort(F.collect_set("x"))).alias("spans"))


def merged(spans):
    """Sorted (s, e) spans as maximal disjoint ones: a span that begins inside what came before extends it."""
    zero = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("done"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e"))

    def step(a, x):
        joins = a["e"].isNotNull() & (x["s"] <= a["e"])
        done = F.when(joins | a["e"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e")))))
        return F.struct(done.alias("done"), F.when(joins, a["s"]).otherwise(x["s"]).alias("s"), F.when(joins, F.greatest(a["e"], x["e"])).otherwise(x["e"]).alias("e"))

    return F.aggregate(spans, zero, step, lambda a: F.when(a["e"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e"))))))


def _cut(words: list[bytes], spans: list[dict] | None) -> list[bytes]:
    kept, at = [], 0
    for x in spans or ():
        kept += words[at : x["s"]]
        at = x["e"]
    return kept + words[at:] if spans else words


def dedup_substrings(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space) of every row.

    Null and empty texts have no words and keep an empty text; rows with null ids keep all their words. Rows that repeat
    an id stand for themselves, each losing what a smaller id also has, never what only their own id has. Other columns
    are ignored.
    """
    spans = repeated_spans(docs, window=window, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "spans")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), text_key(F.col(f"`{text_col}`")).alias("key"))
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, left, sha, kept = [], [], [], []
            for text, x in zip(binary_list(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = words_of(text)
                rest = _cut(words, x)
                n.append(len(words))
                left.append(len(words) - len(rest))
                kept.append(b" ".join(rest))
                sha.append(hashlib.sha256(kept[-1]).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(left, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

        return one

    joined = texts.join(spans, (texts["doc_id"] == spans["_id"]) & (texts["key"] == spans["_key"]), "left").select("doc_id", "text", "spans")
    return map_batches(joined, make, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
