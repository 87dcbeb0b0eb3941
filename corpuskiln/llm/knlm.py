"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, stored as sorted hash arrays that workers map.

Words are counted by hash and get ids. Counting packs many n-grams into a row: each batch of documents gives, for each
bucket of contexts, the distinct n-grams with their counts as one compressed block. A bucket's task merges its blocks and writes two files into the
shared folder: the n-grams' hashes with counts, and the contexts' hashes with the sums that discounting needs, both
sorted. It also passes the suffixes on, as continuation counts of the next lower order. Scoring maps the files and
finds hashes by binary search; the files are never loaded as a whole, and nothing of the corpus goes to the driver
but a few sums for each order and the words too frequent for one bucket, whose number the buckets bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary_list, commit_file, drop, hash_words, map_arrow, map_batches, mix64, open_file, scratch_path, store

#: Hash of the end token.
END = np.uint64(0x2545F4914F6CDD1D)
#: Ids of the padding before a text and of words that training has not seen. Known words have ids between, by bucket
#: and rank within it, so that frequent words have small ids and blocks of ids compress well.
BEGIN, UNKNOWN = np.uint64(0), np.uint64(2**64 - 1)
#: n-gram tokens that are sorted at once.
SORT_TOKENS = 1_500_000
_BLOCK = "bucket int, kind int, block binary"
_NAMES = ["bucket", "kind", "block"]


def tokens(text: bytes | None) -> np.ndarray:
    """Hashes of the words (A-Z lower-cased) and the end token."""
    return np.append(hash_words(text.lower().split()) if text else np.zeros(0, np.uint64), END)


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        out = mix64(out * np.uint64(0x9DDFEA08EB382D69) ^ c)
    return out


def bucket_of(columns: list[np.ndarray], hot: np.ndarray | None, buckets: int) -> np.ndarray:
    """An n-gram's bucket is that of its context, so that a context meets in one place; a unigram, or an n-gram whose
    context is made of frequent words only (hot), is dealt by its own hash."""
    own = gram_hash(columns)
    if len(columns) > 1:
        own = np.where(hot, own, gram_hash(columns[:-1]))
    return ((own >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def index(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each element among them."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.concatenate((np.ones(min(1, len(x)), bool), ordered[1:] != ordered[:-1]))
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    return ordered[new], at


@dataclass
class Grams:
    """Distinct n-grams with counts, in order: the ids of their words, sorted (of single words at first: hashes), and
    for each place of an n-gram the indices into these."""

    words: np.ndarray
    ids: list[np.ndarray]
    counts: np.ndarray

    def columns(self) -> list[np.ndarray]:
        return [self.words[i] for i in self.ids]

    def where(self, rows: np.ndarray) -> Grams:
        return Grams(self.words, [i[rows] for i in self.ids], self.counts[rows])

    def hot(self, frequent: np.ndarray) -> np.ndarray | None:
        """Whether the context is made of frequent words only."""
        among = _among(self.words, frequent)
        return np.logical_and.reduce([among[i] for i in self.ids[:-1]]) if len(self.ids) > 1 else None


def merge(words: np.ndarray, ids: list[np.ndarray], counts: np.ndarray | None = None) -> Grams:
    """Distinct n-grams and their summed counts (without counts, each row counts once)."""
    bits = max(1, len(words).bit_length())
    n = len(ids[0])
    if n == 0:
        return Grams(words, ids, np.zeros(0, np.int64))
    if bits * len(ids) > 63:  # too many words for one number
        order = np.lexsort(ids[::-1])
        ids = [i[order] for i in ids]
        new = np.concatenate(([True], np.logical_or.reduce([i[1:] != i[:-1] for i in ids])))
        first = np.flatnonzero(new)
        ids = [i[first] for i in ids]
        counts = None if counts is None else counts[order]
    else:
        key = ids[0].astype(np.int64)
        for i in ids[1:]:
            key = key << bits | i
        if counts is None:
            key = np.sort(key)
        else:
            order = np.argsort(key)
            key, counts = key[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key = key[first]
        ids = [key >> bits * (len(ids) - 1 - j) & (1 << bits) - 1 for j in range(len(ids))]
    return Grams(words, ids, np.diff(np.append(first, n)) if counts is None else np.add.reduceat(counts, first))


def _planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones: equal high bytes compress to little."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(raw: memoryview, n: int, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, n * width).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(n)


def word_ids(counts: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """Ids of a bucket's words: 1, 2, ... in turn over the buckets, the most frequent word of each first."""
    ids = np.empty(len(counts), np.uint64)
    ids[np.argsort(-counts, kind="stable")] = np.arange(len(counts), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket + 1)
    return ids


def _bucket_of_id(ids: np.ndarray, buckets: int) -> np.ndarray:
    return ((ids - np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


def pack(g: Grams) -> bytes:
    """A block: its own words and the first place as differences, the other places as indices, the counts; compressed."""
    if sum(len(i) for i in g.ids) < len(g.words):
        used, at = np.unique(np.concatenate(g.ids), return_inverse=True)
        words, ids = g.words[used], np.split(at, len(g.ids))
    else:
        seen = np.zeros(len(g.words), bool)
        for i in g.ids:
            seen[i] = True
        at = np.cumsum(seen) - 1
        words, ids = g.words[seen], [at[i] for i in g.ids]
    width = next(w for w in (1, 2, 4, 8) if len(words) <= 1 << 8 * w)
    size = next(w for w in (1, 2, 4, 8) if int(g.counts.max(initial=0)) < 1 << 8 * w)
    ids = [i.astype(f"<u{width}") for i in ids]
    ids[0] = np.diff(ids[0], prepend=ids[0].dtype.type(0))
    head = np.array([len(g.counts), len(ids), len(words), width, size], "<i8").tobytes()
    return zstandard.compress(b"".join([head, _planes(np.diff(words, prepend=np.uint64(0))), *map(_planes, ids), _planes(g.counts.astype(f"<u{size}"))]), 3)


def unpack(block: bytes) -> Grams:
    raw = memoryview(zstandard.decompress(block))
    n, k, v, width, size = np.frombuffer(raw, "<i8", 5).tolist()
    raw = raw[40:]
    words = np.cumsum(_numbers(raw, v, 8), dtype=np.uint64)
    ids = [_numbers(raw[8 * v + width * n * i :], n, width) for i in range(k)]
    ids[0] = np.cumsum(ids[0], dtype=ids[0].dtype)
    return Grams(words, [i.astype(np.int64) for i in ids], _numbers(raw[8 * v + width * n * k :], n, size).astype(np.int64))


def _blocks(g: Grams, at: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A block for each bucket; at has the n-grams' buckets."""
    order = np.argsort(at, kind="stable")
    g = g.where(order)
    present, first = np.unique(at[order], return_index=True)
    for b, i, j in zip(present.tolist(), first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
        yield b, pack(g.where(slice(i, j)))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    b, k, x = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], _NAMES)


def _count(texts: DataFrame, order: int, frequent: np.ndarray, buckets: int, folder: str) -> DataFrame:
    """Blocks of the order-grams of texts (one column), with padding before each text; of single words by hash, of
    longer n-grams by the ids that folder has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, files = 0, Files(folder, buckets)

        def flush() -> pa.RecordBatch:
            words, at = index(np.concatenate(held))
            if order == 1:
                g = merge(words, [at])
                return _rows([(b, 1, x) for b, x in _blocks(g, bucket_of(g.columns(), None, buckets))])
            ids = np.append(files.ids(words), BEGIN)
            by_id = np.argsort(ids)
            place = np.empty(len(ids), np.int64)
            place[by_id] = np.arange(len(ids))
            length = np.array([len(h) for h in held]) + order - 1
            start = np.arange(len(at)) + np.repeat(np.arange(len(held)) * (order - 1), length - order + 1)  # no n-gram crosses texts
            padded = np.full(length.sum(), place[-1])
            padded[start + order - 1] = place[at]
            g = merge(ids[by_id], [padded[start + i] for i in range(order)])
            return _rows([(b, order, x) for b, x in _blocks(g, bucket_of(g.columns(), g.hot(frequent), buckets))])

        for batch in batches:
            for text in binary_list(batch.column(0)):
                held.append(tokens(text))
                size += len(held[-1])
                if size >= SORT_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return map_arrow(texts, run, _BLOCK)


def _merge_blocks(blocks: DataFrame, buckets: int, done, schema: str = _BLOCK) -> DataFrame:
    """done(bucket, n-grams by kind) for each bucket, from all its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        last = None
        for batch in batches:
            for b, kind, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != last and held:
                    yield from done(last, _together(held))
                    held = {}
                last = b
                held.setdefault(kind, []).append(block)
        if held:
            yield from done(last, _together(held))

    return map_arrow(blocks.repartitionById(buckets, "bucket").sortWithinPartitions("bucket"), run, schema)


def _together(held: dict[int, list[bytes]]) -> dict[int, Grams]:
    out = {}
    for kind, blocks in held.items():
        parts = [unpack(b) for b in blocks]
        words = np.unique(np.concatenate([p.words for p in parts]))
        places = [np.searchsorted(words, p.words) for p in parts]
        ids = [np.concatenate([at[p.ids[i]] for at, p in zip(places, parts, strict=True)]) for i in range(len(parts[0].ids))]
        out[kind] = merge(words, ids, np.concatenate([p.counts for p in parts]))
    return out


#: Kinds of rows that a merge gives beside blocks of n-grams (whose kind is their order).
_SUMS, _CONTEXT, _RAW = -1, -2, -3


#: Numbers are stored as one byte; from this one on the byte stands for a number in the file of large ones.
_LARGE = 255


def _write(uri: str, keys: np.ndarray, columns: list[tuple[str, np.ndarray]]) -> None:
    """Sorted keys with a byte for each number; and, if there are any, large numbers by column and row."""
    order = np.argsort(keys)
    numbers = [c[order] for _, c in columns]
    rows = [np.flatnonzero(c >= _LARGE) for c in numbers]
    if any(len(r) for r in rows):
        place = np.repeat(np.arange(len(rows), dtype=np.int8), [len(r) for r in rows])
        _write_batch(f"{uri}-large", ["column", "row", "number"], [place, np.concatenate(rows), np.concatenate([c[r].astype(np.int64) for c, r in zip(numbers, rows, strict=True)])])
    _write_batch(uri, ["key", *[n for n, _ in columns]], [keys[order], *[np.minimum(c, _LARGE).astype(np.uint8) for c in numbers]])


def _write_batch(uri: str, names: list[str], columns: list[np.ndarray]) -> None:
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def write(sink) -> None:
        with pa.ipc.new_file(sink, batch.schema) as out:
            out.write_batch(batch)

    commit_file(f"{uri}.arrow", write)


def _context_sums(g: Grams) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each context; its total and its numbers of n-grams with count 1, 2 and more."""
    new = np.concatenate(([True], np.logical_or.reduce([i[1:] != i[:-1] for i in g.ids[:-1]])))
    first = np.flatnonzero(new)
    sums = [np.add.reduceat(x.astype(np.int64), first) for x in (g.counts, g.counts == 1, g.counts == 2, g.counts > 2)]
    return gram_hash([g.words[i[first]] for i in g.ids[:-1]]), np.stack(sums)


def _count_of_counts(counts: np.ndarray) -> bytes:
    return np.array([*[(counts == i).sum() for i in range(1, 5)], counts.sum(), len(counts)], "<i8").tobytes()


def discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2 and D3+ from the numbers of n-grams with counts 1 to 4; 0.5, 1 and 1.5 where these are too few."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    if min(n1, n2, n3) > 0:
        y = n1 / (n1 + 2 * n2)
        d = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
        if (d > 0).all() and (d < [1, 2, 3]).all():
            return d
    return np.array([0.5, 1.0, 1.5])


@dataclass
class Model:
    """Where the arrays are and the few sums that the driver holds."""

    order: int
    folder: str
    buckets: int
    frequent: np.ndarray
    train_tokens: int  # N
    types: int  # V
    discounts: dict[int, np.ndarray]  # by order
    continuations: int  # total of the unigrams' continuation counts
    unigram_kinds: np.ndarray  # numbers of unigrams with continuation count 1, 2 and more
    hot: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # sums of the frequent words' contexts, by order


def train(docs: DataFrame, *, order: int = 3, text_col: str = "text") -> Model:
    """Counts docs. Null and empty texts count as an end token. Without rows the model knows no word.

    There are as many buckets as spark.sql.shuffle.partitions; a word is frequent if it alone fills a quarter of one.
    """
    if order < 2:
        raise ValueError("order must be 2 at least")
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch_path(spark, "ngrams")
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    none = np.zeros(0, np.uint64)

    # words: counts by bucket; the frequent ones go to the driver, fewer than 4 * buckets of them
    raw, raw_path = store(_count(texts, 1, none, buckets, folder), "words")

    def sum_words(bucket: int, found: dict) -> Iterator[pa.RecordBatch]:
        keys, counts = found[1].columns()[0], found[1].counts
        ids = word_ids(counts, bucket, buckets)
        _write_batch(f"{folder}/ids-{bucket:06d}", ["key", "id"], [keys, ids.astype(np.uint32) if ids.max() < 1 << 32 else ids])
        by_id = np.argsort(ids)
        yield _rows([(bucket, _RAW, pack(Grams(ids[by_id], [np.arange(len(ids))], counts[by_id]))), (bucket, _SUMS, _count_of_counts(counts))])

    words, words_path = store(_merge_blocks(raw, buckets, sum_words), "word-counts")
    drop(spark, raw_path)
    sums = sum((np.frombuffer(bytes(r.block), "<i8") for r in words.where(F.col("kind") == _SUMS).select("block").toLocalIterator()), np.zeros(6, np.int64))
    n_tokens, types = int(sums[4]), int(sums[5])
    least = max(2, n_tokens // (4 * buckets))

    def find_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                g = unpack(block)
                yield pa.RecordBatch.from_arrays([pa.array(g.words[g.ids[0][g.counts >= least]].view(np.int64))], ["key"])

    keys = map_arrow(words.where(F.col("kind") == _RAW).select("block"), find_frequent, "key bigint").collect()
    frequent = np.sort(np.append(np.array([r.key for r in keys], np.int64).view(np.uint64), BEGIN))

    discount, hot, path = {}, {}, None
    blocks = _count(texts, order, frequent, buckets, folder)
    for k in range(order, 1, -1):

        def merge_grams(bucket: int, found: dict, k: int = k) -> Iterator[pa.RecordBatch]:
            g = found[k]
            _write(f"{folder}/grams-{k}-{bucket:06d}", gram_hash(g.columns()), [("count", g.counts)])
            hot_rows = g.hot(frequent)
            rows = [(bucket, _SUMS, _count_of_counts(g.counts))]
            if (~hot_rows).any():
                keys, sums = _context_sums(g.where(~hot_rows))
                _write(f"{folder}/contexts-{k}-{bucket:06d}", keys, list(zip(("total", "n1", "n2", "n3"), sums, strict=True)))
            if hot_rows.any():
                keys, sums = _context_sums(g.where(hot_rows))
                rows.append((bucket, _CONTEXT, zstandard.compress(np.vstack([keys.view(np.int64), sums]).tobytes())))
            # a suffix continues as many different first words as there are n-grams; at a text's start its own count counts
            once = np.where(g.words[g.ids[1]] == BEGIN, g.counts, 1) if k > 2 else np.ones(len(g.counts), np.int64)
            g = merge(g.words, g.ids[1:], once)
            at = bucket_of(g.columns(), g.hot(frequent), buckets) if k > 2 else _bucket_of_id(g.columns()[0], buckets)
            rows += [(b, k - 1, x) for b, x in _blocks(g, at)]
            yield _rows(rows)

        made, made_path = store(_merge_blocks(blocks, buckets, merge_grams), f"grams-{k}")
        if path:
            drop(spark, path)
        path = made_path
        sums, contexts = np.zeros(6, np.int64), []
        for r in made.where(F.col("kind") < 0).select("kind", "block").toLocalIterator():
            if r.kind == _SUMS:
                sums = sums + np.frombuffer(bytes(r.block), "<i8")
            else:
                contexts.append(np.frombuffer(zstandard.decompress(bytes(r.block)), "<i8").reshape(5, -1))
        discount[k] = discounts(sums)
        hot[k] = _sum_contexts(contexts)
        blocks = made.where(F.col("kind") == k - 1)

    def merge_words(bucket: int, found: dict) -> Iterator[pa.RecordBatch]:
        (ids,), n = found[_RAW].columns(), found[1].counts
        follow = np.zeros(len(ids), np.int64)
        follow[np.searchsorted(ids, found[1].columns()[0])] = n
        _write_batch(f"{folder}/words-{bucket:06d}", ["count", "follow"], [found[_RAW].counts, follow])
        yield _rows([(bucket, _SUMS, _count_of_counts(n) + np.array([(n > 2).sum()], "<i8").tobytes())])

    last = _merge_blocks(blocks.unionByName(words.where(F.col("kind") == _RAW)), buckets, merge_words)
    sums = sum((np.frombuffer(bytes(r.block), "<i8") for r in last.collect()), np.zeros(7, np.int64))  # one row a bucket
    for x in (path, words_path):
        drop(spark, x)
    discount[1] = discounts(sums)
    return Model(order, folder, buckets, frequent, n_tokens, types, discount, int(sums[4]), np.array([sums[0], sums[1], sums[6]]), hot)


def _sum_contexts(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros((4, 0), np.int64)
    together = np.concatenate(parts, axis=1)
    unique, at = index(together[0].view(np.uint64))
    sums = np.zeros((4, len(unique)), np.int64)
    for i in range(4):
        np.add.at(sums[i], at, together[i + 1])
    return unique, sums


class Files:
    """Looks up the mapped arrays of a model, which may still be in the making."""

    def __init__(self, folder: str, buckets: int):
        self.folder, self.buckets, self.files = folder, buckets, {}

    def _open(self, name: str) -> list[np.ndarray] | None:
        if name not in self.files:
            try:
                batch = pa.ipc.open_file(open_file(f"{self.folder}/{name}.arrow")).get_batch(0)
                self.files[name] = [c.to_numpy() for c in batch.columns]
            except FileNotFoundError:
                self.files[name] = None
        return self.files[name]

    def find(self, kind: str, keys: np.ndarray, bucket: np.ndarray, width: int) -> np.ndarray:
        """width numbers for each key; 0 where the array lacks it. Keys are looked up bucket by bucket, in order."""
        out = np.zeros((width, len(keys)), np.int64)
        for b, part in self._by_bucket(bucket):
            name = f"{kind}-{b:06d}"
            if (held := self._open(name)) is None or not len(held[0]):
                continue
            part = part[np.argsort(keys[part])]
            want = keys[part]
            at = np.minimum(np.searchsorted(held[0], want), len(held[0]) - 1)
            ok = held[0][at] == want
            part, at = part[ok], at[ok]
            for i, column in enumerate(held[1 : width + 1]):
                found = column[at].astype(np.int64)
                large = np.flatnonzero(found == _LARGE)
                if len(large):
                    columns, rows, numbers = self._open(f"{name}-large")
                    low, high = np.searchsorted(columns, [i, i + 1])
                    found[large] = numbers[low:high][np.searchsorted(rows[low:high], at[large])]
                out[i, part] = found
        return out

    def _by_bucket(self, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(bucket.astype(np.uint16) if self.buckets <= 1 << 16 else bucket, kind="stable")
        present, first = np.unique(bucket[order], return_index=True)
        return zip(present.tolist(), np.split(order, first[1:]), strict=False)

    def ids(self, words: np.ndarray) -> np.ndarray:
        """Ids of hashes in order; UNKNOWN for unseen ones."""
        out = np.full(len(words), UNKNOWN)
        for b, part in self._by_bucket(bucket_of([words], None, self.buckets)):
            if (held := self._open(f"ids-{b:06d}")) is not None:
                at = np.minimum(np.searchsorted(held[0], words[part]), len(held[0]) - 1)
                ok = held[0][at] == words[part]
                out[part[ok]] = held[1][at[ok]]
        return out


class Reader(Files):
    """Probabilities by a finished model."""

    def __init__(self, model: Model):
        super().__init__(model.folder, model.buckets)
        self.model = model

    def words(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and P(word) of the lowest order, for each word; rows of a bucket's array are in order of ids."""
        m = self.model
        count, follow = np.zeros((2, len(ids)), np.int64)
        known = np.flatnonzero((ids != BEGIN) & (ids != UNKNOWN))
        for b, part in self._by_bucket(_bucket_of_id(ids[known], m.buckets)):
            part, held = known[part], self._open(f"words-{b:06d}")
            row = (ids[part] - np.uint64(1)) // np.uint64(m.buckets)
            count[part], follow[part] = held[0][row], held[1][row]
        uniform = 1.0 / (m.types + 1)
        if not m.continuations:
            return count, np.full(len(ids), uniform)
        d = m.discounts[1]
        left = float(d @ m.unigram_kinds) / m.continuations
        return count, np.maximum(follow - _discount(d, follow), 0) / m.continuations + left * uniform

    def probabilities(self, words: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """words: ids; word_at: the place of each token among them. The count of each token, and P(token | the order - 1
        tokens before it) of all but the first order - 1 tokens. Each distinct n-gram and context is looked up once."""
        m = self.model
        count, p = (x[word_at] for x in self.words(words))
        at, ids = word_at, [np.arange(len(words))]  # the n-gram that ends at each token; the words of each n-gram
        frequent = _among(words, m.frequent)
        hot = frequent  # whether the n-gram is made of frequent words only
        for k in range(2, m.order + 1):
            # what was an n-gram is the context now
            key = gram_hash([words[i] for i in ids])
            sums = self.find(f"contexts-{k}", key, ((key >> np.uint64(32)) % np.uint64(m.buckets)).astype(np.int64), 4)
            hot_keys, hot_sums = m.hot[k]
            if len(hot_keys):
                i = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                ok = hot_keys[i] == key
                sums[:, ok] = hot_sums[:, i[ok]]
            d, total = m.discounts[k], np.maximum(sums[0], 1)
            left = (d[0] * sums[1] + d[1] * sums[2] + d[2] * sums[3]) / total
            context_at = at[:-1]
            pairs, at = index(context_at << 32 | word_at[k - 1 :])
            context, last = pairs >> 32, pairs & 0xFFFFFFFF
            ids = [*[i[context] for i in ids], last]
            gram = [words[i] for i in ids]
            (n,) = self.find(f"grams-{k}", gram_hash(gram), bucket_of(gram, hot[context], m.buckets), 1)
            hot = hot[context] & frequent[last]
            own = np.maximum(n - _discount(d, n), 0) / total[context]
            p = np.where(sums[0][context_at] > 0, own[at] + left[context_at] * p[1:], p[1:])
        return count, p


def _discount(d: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.concatenate(([0.0], d))[np.minimum(count, 3)]


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known (tokens seen in training), base_score (smoothed unigrams), score (the model), both
    log10 probabilities of the whole text, and perplexity (10 to the -score / n_tokens). Null texts are empty; null
    and repeated ids are fine; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        m = shared.value
        reader = Reader(m)

        def some(texts: list[bytes | None]) -> list[np.ndarray]:
            parts = [tokens(t) for t in texts]
            size = np.array([len(p) for p in parts], np.int64)
            pad = m.order - 1
            words, word_at = index(np.concatenate(parts))
            at = np.arange(size.sum()) + np.repeat(np.arange(len(parts)) + 1, size) * pad
            padded = np.full(len(at) + len(parts) * pad, len(words))
            padded[at] = word_at
            count, p = reader.probabilities(np.append(reader.ids(words), BEGIN), padded)
            count, logs = count[at], np.log10(p[at - pad])
            base = np.log10((count + 0.5) / (m.train_tokens + 0.5 * (m.types + 1)))
            first = np.cumsum(size) - size
            return [size, np.add.reduceat((count > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(logs, first)]

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, out, i = binary_list(batch.column(1)), [], 0
            while i < len(texts):
                j, n = i, 0
                while j < len(texts) and (j == i or n < 4_000_000):  # bytes looked up together
                    n += len(texts[j] or b"")
                    j += 1
                out.append(some(texts[i:j]))
                i = j
            size, known, base, logs = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(known), pa.array(base), pa.array(logs), pa.array(10 ** np.minimum(-logs / size, 300))], ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

        return one

    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_batches(texts, make, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double")


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 1):
    """True for the ids whose CRC-32 (as text) falls into the fold; null ids never do."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % folds == fold, F.lit(False))
