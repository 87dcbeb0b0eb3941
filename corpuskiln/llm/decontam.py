"""Benchmark decontamination with suffix arrays over shards of the training text.

The documents stay where they are: each Arrow batch is a shard with a suffix array of its own, in which every suffix
of every benchmark text is looked up by binary search, as far as it matches. The longest matches and their locations
give the words that are hit; nothing is shuffled, and a document's matches are complete because a shard holds whole
documents. The benchmark lies in the shared folder as files of bounded size that a worker takes up one after another,
so a large one changes neither the result nor what is held at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import binary_list, commit_file, map_arrow, open_file, scratch_path, write_table

#: Bytes 0-9, a-z and from 0x80 make words; A-Z is lower-cased; every other byte separates words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: Benchmark text in one file of test suffixes; a larger benchmark becomes several files.
BLOCK_BYTES = 32 << 20


def item_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. Null has none."""
    return text.translate(_TABLE).split() if text else []


@dataclass
class TestSuffixes:
    """The suffixes of one block of benchmark texts: words as ids from 1, item by item, with a 0 after each."""

    vocab: dict[bytes, int]
    seq: np.ndarray
    start: np.ndarray  # where each suffix begins in seq
    item: np.ndarray  # index of its item
    need: np.ndarray  # words in its window
    item_start: np.ndarray  # where each item begins in seq
    least: int  # words in the shortest window

    @classmethod
    def build(cls, texts: list[bytes | None], min_words: int) -> TestSuffixes:
        vocab: dict[bytes, int] = {}
        seq: list[int] = []
        start, item, need, item_start = [], [], [], []
        for i, text in enumerate(texts):
            words = item_words(text)
            window = min(len(words), min_words)
            item_start.append(len(seq))
            for k in range(len(words) - window + 1 if words else 0):
                start.append(len(seq) + k)
                item.append(i)
                need.append(window)
            seq.extend(vocab.setdefault(w, len(vocab) + 1) for w in words)
            seq.append(0)
        return cls(vocab, np.array([*seq, 0], np.int32), np.array(start, np.int64), np.array(item, np.int64), np.array(need, np.int64), np.array(item_start, np.int64), min(need, default=1))


@dataclass
class Matches:
    """Where the suffixes of a block match a shard.

    A suffix i has its longest match, of words[i] words (0 if shorter than its window), at array[lo[root]:hi[root]] +
    i - root with root = root[i]: wherever a suffix occurs only behind the word before it, it shares the match of the
    suffix before it. Each row of windows is a different window that occurs: lo, hi (its range of the array), and
    which[j] is the row of the j-th found suffix in full. best: for each place of the array, the words of the longest
    match that begins there (0: shorter than a window, or inside a longer match).
    """

    words: np.ndarray
    root: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    windows: np.ndarray
    full: np.ndarray
    which: np.ndarray
    best: np.ndarray


class Shard:
    """The suffix array of a batch of documents.

    Words foreign to the benchmark can't be part of a match, so they all become 0, and the runs of known words too
    short for the shortest window are left out; what is left is sorted by prefix doubling until all suffixes differ.
    """

    def __init__(self, texts: list[bytes | None], test: TestSuffixes):
        get, words = test.vocab.get, [item_words(t) for t in texts]
        self.n_words = np.array([len(w) for w in words], np.int64)
        doc = np.repeat(np.arange(len(words)), self.n_words + 1)
        ids = np.zeros(len(doc), np.int32)
        at = 0
        for w in words:
            ids[at : at + len(w)] = np.fromiter((get(x, 0) for x in w), np.int32, len(w))
            at += len(w) + 1
        first = np.concatenate(([0], np.cumsum(self.n_words + 1)[:-1])) if words else np.zeros(0, np.int64)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ids != 0, [0]))))
        runs = edge.reshape(-1, 2)
        runs = runs[runs[:, 1] - runs[:, 0] >= test.least]
        lengths = runs[:, 1] - runs[:, 0] + 1
        begin = np.cumsum(lengths) - lengths
        where = np.arange(lengths.sum()) - np.repeat(begin - runs[:, 0], lengths)
        self.seq = np.append(ids[where], np.int32(0))
        self.seq[begin + lengths - 1] = 0
        self.doc = np.append(doc[where], 0)
        self.pos = np.append(where - first[self.doc[:-1]], 0) if len(where) else np.zeros(1, np.int64)
        self.array = self._sorted()

    def _sorted(self) -> np.ndarray:
        rank, step, n = self.seq.astype(np.int64), 1, len(self.seq)
        while True:
            after = np.concatenate((rank[step:], np.zeros(min(step, n), np.int64)))[:n]
            after[self.seq == 0] = 0  # nothing is compared beyond the end of a run
            key = rank * (int(rank.max()) + 1 if n else 1) + after
            order = np.argsort(key, kind="stable")
            new = np.cumsum(np.concatenate(([0], np.diff(key[order]) != 0)))
            new += key[order[0]] != 0  # rank 0 is the end of a run only
            done = np.empty(n, np.int64)
            done[order] = new
            if np.array_equal(done, rank) or new[-1] >= n - 1 or step >= n:
                return order[self.seq[order] != 0]
            rank, step = done, step * 2

    def search(self, test: TestSuffixes) -> Matches:
        """Binary search of every test suffix, a word at a time: each word narrows its range of the array, until the
        range would become empty.

        A suffix is given up beyond its window once it occurs just as often as the suffix one word longer on the left:
        every further match of it is the end of a match of that one. So a long verbatim copy is followed once, not
        once for each of its words.
        """
        size, n = len(test.start), len(self.array)
        lo, hi, words = np.zeros(size, np.int64), np.full(size, n, np.int64), np.zeros(size, np.int64)
        dropped = np.zeros(size, bool)
        left = np.zeros(size, bool)  # whether the suffix before is of the same item
        left[1:] = test.item[1:] == test.item[:-1]
        window = np.zeros((2, size), np.int64)
        best = np.zeros(n, np.int64)
        live, depth, before, alive = np.arange(size), 0, np.zeros(size, np.int64), np.zeros(size, bool)
        while len(live) and n:
            word = test.seq[test.start[live] + depth]
            a, b = (self._bound(lo[live], hi[live], word, depth, upper) for upper in (False, True))
            on = (a < b) & (word != 0)
            before[live] = hi[live] - lo[live]  # occurrences at the depth before
            live = live[on]
            alive[live] = True
            lo[live], hi[live], depth = a[on], b[on], depth + 1
            words[live] = depth
            full = live[test.need[live] == depth]
            window[0, full], window[1, full] = lo[full], hi[full]
            some = live[test.need[live] <= depth]
            for x, y in np.unique(np.stack((lo[some], hi[some])), axis=1).T.tolist() if len(some) else ():
                best[x:y] = depth
            # i is dropped if i - 1 (now of this depth) occurs as often as i did one word shorter
            prior = np.maximum(live - 1, 0)
            drop = left[live] & alive[prior] & (test.need[live] < depth) & (hi[prior] - lo[prior] == before[live])
            dropped[live[drop]] = True
            alive[live] = False
            live = live[~drop]
            alone = (hi[live] - lo[live] == 1) & (test.need[live] < depth)  # one place: compared as a whole
            for i in live[alone].tolist():
                words[i] += _agree(test.seq, test.start[i] + depth, self.seq, self.array[lo[i]] + depth)
                best[lo[i]] = max(best[lo[i]], words[i])
            live = live[~alone]
        found = words >= test.need
        root = np.maximum.accumulate(np.where(dropped, -1, np.arange(size))) if size else np.zeros(0, np.int64)
        at = np.arange(size)
        words = np.where(dropped, words[root] - (at - root), words) if size else words
        windows, which = np.unique(np.stack((window[0, found], window[1, found], test.need[found])), axis=1, return_inverse=True)
        return Matches(np.where(found, words, 0), root, lo, hi, windows[:2], np.flatnonzero(found), which.ravel(), best)

    def _bound(self, lo: np.ndarray, hi: np.ndarray, word: np.ndarray, depth: int, upper: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        last = len(self.seq) - 1
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            seen = self.seq[np.minimum(self.array[np.minimum(mid, len(self.array) - 1)] + depth, last)]
            right = (seen <= word if upper else seen < word) & open_
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        return lo


def _agree(x: np.ndarray, i: int, y: np.ndarray, j: int) -> int:
    """Words from x[i] and y[j] on that agree, up to the end of an item or run (0)."""
    n, step = 0, 16
    while True:
        a, b = x[i + n : i + n + step], y[j + n : j + n + step]
        k = min(len(a), len(b))
        stop = np.flatnonzero((a[:k] != b[:k]) | (a[:k] == 0))
        if len(stop) or k < step:
            return n + (int(stop[0]) if len(stop) else k)
        n, step = n + step, step * 2


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (row, index) with lo[row] <= index < hi[row]."""
    n = hi - lo
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, in order."""
    both = np.unique(np.stack((a, b)), axis=1) if len(a) else np.zeros((2, 0), np.int64)
    return both[0], both[1]


class Hits:
    """What the texts of a batch share with the benchmark, added up over its blocks."""

    def __init__(self, texts: list[bytes | None]):
        self.texts, n = texts, len(texts)
        self.n_words = np.zeros(n, np.int64)
        self.spans: list[list[np.ndarray]] = [[] for _ in range(n)]
        self.items: list[tuple[np.ndarray, pa.Array]] = []  # texts' numbers (ascending) and items of each block
        self.longest, self.longest_at = np.zeros(n, np.int64), np.full(n, -1, np.int64)

    def add(self, test: TestSuffixes, ids: pa.Array) -> None:
        shard = Shard(self.texts, test)
        self.n_words = shard.n_words
        if not len(shard.array) or not len(test.start):
            return
        found = shard.search(test)
        rank = np.flatnonzero(found.best)
        if not len(rank):
            return
        at, n = shard.array[rank], found.best[rank]
        cover = np.zeros(len(shard.seq) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + n, -1)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(cover) > 0, [0])))).reshape(-1, 2)
        docs, first = shard.doc[edge[:, 0]], shard.pos[edge[:, 0]]
        for d, part in zip(*_grouped(docs, np.stack((first, first + edge[:, 1] - edge[:, 0]), 1)), strict=True):
            self.spans[d].append(part)
        doc, pos = shard.doc[at], shard.pos[at]
        order = np.lexsort((pos, -n, doc))  # of each text the longest, and of these the first
        order = order[np.concatenate(([True], np.diff(doc[order]) != 0))]
        doc, pos, n = doc[order], pos[order], n[order]
        better = (n > self.longest[doc]) | ((n == self.longest[doc]) & (pos < self.longest_at[doc]))
        self.longest[doc[better]], self.longest_at[doc[better]] = n[better], pos[better]
        # texts of each different window, joined with the items of each different window
        row, index = _expand(*found.windows)
        win, doc = _distinct(row, shard.doc[shard.array[index]])
        own, item = _distinct(found.which, test.item[found.full])
        lo = np.searchsorted(own, win)
        row, index = _expand(lo, np.searchsorted(own, win, "right"))
        doc, item = _distinct(doc[row], item[index])
        self.items.append((doc, ids.take(pa.array(item))))

    def merged_spans(self) -> tuple[np.ndarray, pa.Array]:
        """Words covered in each text, and its spans as disjoint (s, e) in order."""
        size, s, e = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        n_hit = np.zeros(len(self.texts), np.int64)
        for i, parts in enumerate(self.spans):
            x = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
            x = x[np.argsort(x[:, 0], kind="stable")]
            top = np.maximum.accumulate(x[:, 1])
            new = np.flatnonzero(np.concatenate(([True], x[1:, 0] > top[:-1]))) if len(x) else np.zeros(0, np.int64)
            s.append(x[new, 0])
            e.append(top[np.append(new[1:], len(x)) - 1] if len(x) else x[:, 1])
            size.append(len(new))
            n_hit[i] = (e[-1] - s[-1]).sum()
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(s)), pa.array(np.concatenate(e))], ["s", "e"])
        return n_hit, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pairs)

    def item_lists(self, kind: pa.DataType) -> pa.Array:
        """The ids of each text's items, with repeats where blocks or items share an id."""
        doc = np.concatenate([np.zeros(0, np.int64), *[d for d, _ in self.items]])
        ids = pa.concat_arrays([pa.array([], kind), *[x for _, x in self.items]])
        order = np.argsort(doc, kind="stable")
        offsets = np.searchsorted(doc[order], np.arange(len(self.texts) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids.take(pa.array(order)))


def _grouped(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Values by key; key is in ascending order."""
    keys, first = np.unique(key, return_index=True)
    return keys, np.split(values, first[1:]) if len(keys) else []


@dataclass
class Benchmark:
    """Test suffixes as files in the shared folder: block-0, block-1, ..."""

    folder: str
    blocks: int
    id_type: str

    def each(self) -> Iterator[tuple[TestSuffixes, pa.Array]]:
        """The blocks, one at a time: suffixes, and the ids of their items."""
        for b in range(self.blocks):
            try:
                with open_file(f"{self.folder}/block-{b:06d}") as f:
                    test, ids = pickle.loads(f.read())
            except FileNotFoundError:  # a block without a text
                continue
            with pa.ipc.open_stream(ids) as found:
                yield test, found.read_all().combine_chunks().column(0).combine_chunks()


def prepare(benchmark: DataFrame, *, min_words: int = 13, block_bytes: int = BLOCK_BYTES, item_col: str = "item_id", item_text_col: str = "text") -> Benchmark:
    """Writes the benchmark's suffixes into the shared folder, in blocks of about block_bytes of text, on the executors.
    Equal rows become one; null texts have no suffix."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{item_text_col}`").alias("t")).where("t is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    folder = scratch_path(spark, "benchmark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        block = whole.column(0)[0].as_py()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([whole.schema.field(1)])) as out:
            out.write_table(whole.select([1]))
        body = pickle.dumps((TestSuffixes.build(binary_list(whole.column(2)), min_words), sink.getvalue().to_pybytes()), 5)
        commit_file(f"{folder}/block-{block:06d}", lambda f: f.write(body))
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "items": pa.array([whole.num_rows], pa.int64())})

    dealt = rows.select(F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int").alias("block"), "i", "t").repartitionById(n, "block").sortWithinPartitions("i", "t")
    map_arrow(dealt, run, "block int, items bigint").collect()  # one row a block
    return Benchmark(folder, n, benchmark.schema[item_col].dataType.simpleString())


class _Held:
    """A task's view of the benchmark: a single block is read once, several are read anew for each batch."""

    def __init__(self, test: Benchmark):
        self.test, self.one = test, list(test.each()) if test.blocks == 1 else None

    def hits(self, texts: list[bytes | None]) -> Hits:
        found = Hits(texts)
        for test, ids in self.one if self.one is not None else self.test.each():
            found.add(test, ids)
        if not found.n_words.any():
            found.n_words = np.array([len(item_words(t)) for t in texts], np.int64)
        return found


def _batchwise(test: Benchmark, one: Callable[[_Held, pa.RecordBatch], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                held = held or _Held(test)
                yield one(held, batch)

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, min_words: int = 13, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """What each document shares with the benchmark.

    A window is min_words consecutive words of an item (an item with fewer, but not none: all of it). Returns per
    row of docs: doc_id, n_words, n_hit (words inside an occurring window), spans (array of (s, e): these words),
    items (array, ascending: the ids of items with an occurring window), longest and longest_at (words of its longest
    verbatim match with an item, and the word at which it begins; 0 and -1 if no window occurs). Null or empty texts
    have no words. Rows are judged one by one, so null and repeated ids are fine. Items with null ids cover words but
    are not listed; items with one id are listed once. An empty benchmark hits nothing. The number of blocks changes
    nothing. Ids may have any type that Arrow can carry and Spark can sort. Other columns are ignored.
    """
    test = prepare(benchmark, min_words=min_words, block_bytes=block_bytes, item_col=item_col, item_text_col=item_text_col)
    item_type = benchmark.schema[item_col].dataType
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words bigint, n_hit bigint, spans array<struct<s: bigint, e: bigint>>, items array<{test.id_type}>, longest bigint, longest_at bigint"
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(item_type)

    def one(held: _Held, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = held.hits(binary_list(batch.column(1)))
        n_hit, spans = found.merged_spans()
        columns = [batch.column(0), pa.array(found.n_words), pa.array(n_hit), spans, found.item_lists(kind), pa.array(found.longest), pa.array(found.longest_at)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "spans", "items", "longest", "longest_at"])

    rows = map_arrow(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), _batchwise(test, one), schema)
    return rows.withColumn("items", F.array_sort(F.array_distinct(F.array_compact("items"))))


def is_contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """True if benchmark windows cover at least one word in share words."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, min_words: int = 13, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The longest verbatim match of every benchmark suffix over all shards, and all places that attain it.

    Returns item_id, item_pos (word at which the suffix begins), n_words (of the match, at least min_words or the
    whole of a shorter item), doc_id, doc_pos. Shards give their own longest matches, which are written once; of them
    the longest overall stay. Nulls, empty tables and repeated rows: as in contamination(); items of one id and
    different texts are kept apart.
    """
    test = prepare(benchmark, min_words=min_words, block_bytes=block_bytes, item_col=item_col, item_text_col=item_text_col)
    schema = f"suffix bigint, item_id {test.id_type}, item_pos bigint, n_words bigint, doc_id {docs.schema[id_col].dataType.simpleString()}, doc_pos bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, (block, ids) in enumerate(test.each()):
                shard = Shard(binary_list(batch.column(1)), block)
                if not len(shard.array) or not len(block.start):
                    continue
                found = shard.search(block)
                good = np.flatnonzero(found.words)
                row, index = _expand(found.lo[found.root[good]], found.hi[found.root[good]])
                row, at = good[row], shard.array[index] + (good - found.root[good])[row]
                item = block.item[row]
                columns = [pa.array((b << 40) + row), ids.take(pa.array(item)), pa.array(block.start[row] - block.item_start[item]), pa.array(found.words[row]), batch.column(0).take(pa.array(shard.doc[at])), pa.array(shard.pos[at])]
                yield pa.RecordBatch.from_arrays(columns, ["suffix", "item_id", "item_pos", "n_words", "doc_id", "doc_pos"])

    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    parts = write_table(map_arrow(texts, run, schema), "longest-matches")
    best = parts.groupBy("suffix").agg(F.max("n_words").alias("_best"))
    return parts.join(best, "suffix").where(F.col("n_words") == F.col("_best")).drop("suffix", "_best")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, share: int = 20, text_col: str = "text", **options) -> DataFrame:
    """docs without the contaminated rows (see contamination() and is_contaminated()), all columns kept.

    Rows are judged in place, without a shuffle, whatever the number of blocks; null and repeated ids do no harm, and
    null texts stay.
    """
    test = prepare(benchmark, **options)
    place = docs.columns.index(text_col)

    def one(held: _Held, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = held.hits(binary_list(batch.column(place)))
        n_hit, _ = found.merged_spans()
        return batch.filter(pa.array(~((n_hit > 0) & (n_hit * share >= found.n_words))))

    return map_arrow(docs, _batchwise(test, one), docs.schema)
