"""Global vectors: word vectors, context vectors and biases that fit the logs of co-occurrence counts.

The loss of a count x between a word and a context is f(x) * (word . context + both biases - log x)^2 / 2, where f(x) is
(x / x_max)^alpha and 1 at most; AdaGrad minimises it.

Words and contexts are dealt into as many blocks; the counts then lie, packed, in a grid of cells (word block, context block). A
round is a job of one task for each word block, and in round r of an epoch the task of word block i works on the cell
with context block i + r. So no two tasks of a round share a parameter, every count is seen once an epoch, and the
result doesn't depend on which executor does what. A task reads its two blocks of parameters from the shared folder and
writes new ones beside them; a repeated task does the same again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import commit_file, drop, open_file, scratch_path
from ..workers import map_arrow
from . import pairs as packed

#: Words of a block: with vectors of 300 numbers and their AdaGrad sums, about 160 MB for the two blocks of a cell.
BLOCK_WORDS = 16_384
#: Counts that are fitted at a time; each word's gradients in them are added up.
BATCH = 1024
#: Counts that a task deals to cells at a time.
HELD_COUNTS = 1 << 22


@dataclass(frozen=True)
class Options:
    size: int = 50
    x_max: float = 100.0
    alpha: float = 0.75
    eta: float = 0.05
    grad_clip: float = 100.0


class Block:
    """Vectors, biases (the last column) and AdaGrad sums of the words n with n % blocks == number."""

    def __init__(self, values: np.ndarray, sums: np.ndarray):
        self.values, self.sums = values, sums

    @classmethod
    def new(cls, side: int, number: int, rows: int, size: int, seed: int) -> Block:
        values = (np.random.default_rng([seed, side, number]).random((rows, size + 1)) - 0.5) / (size + 1)
        return cls(values, np.ones_like(values))

    @classmethod
    def load(cls, uri: str, size: int) -> Block:
        with open_file(uri) as f:
            both = np.frombuffer(f.read(), np.float64).reshape(2, -1, size + 1).copy()
        return cls(both[0], both[1])

    def save(self, uri: str) -> None:
        commit_file(uri, lambda f: (f.write(self.values.tobytes()), f.write(self.sums.tobytes())))


def _groups(index: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different indices, below rows, the places of all in their order, and where each begins among these."""
    index = index.astype(np.uint16) if rows <= 1 << 16 else index  # sorted by their digits then
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
    return index[first], order, first


def fit_cell(word: Block, context: Block, w: np.ndarray, c: np.ndarray, x: np.ndarray, o: Options, batch: int = BATCH) -> float:
    """Fits a cell's counts (rows w and c of the blocks) in their order; returns the loss met on the way."""
    logs, weights = np.log(x), np.minimum((x / o.x_max) ** o.alpha, 1.0)
    loss = 0.0
    size = word.values.shape[1] - 1
    for at in range(0, len(x), batch):
        part = slice(at, at + batch)
        i, j = w[part], c[part]
        a, b = word.values.take(i, 0), context.values.take(j, 0)
        error = (a[:, :-1] * b[:, :-1]).sum(1) + a[:, -1] + b[:, -1] - logs[part]
        pull = weights[part] * error
        loss += float(0.5 * pull @ error)
        pull = o.eta * pull[:, None]
        for block, index, other in ((word, i, b), (context, j, a)):
            some, order, first = _groups(index, len(block.values))
            both = np.empty((len(index), 2, size + 1))  # steps and their squares, summed together
            step = both[:, 0]
            np.multiply(pull, other, out=step)
            np.clip(step[:, :-1], -o.grad_clip, o.grad_clip, out=step[:, :-1])
            step[:, -1:] = pull
            np.multiply(step, step, out=both[:, 1])
            both = np.add.reduceat(both.reshape(len(index), -1).take(order, 0), first, axis=0)
            sums = block.sums.take(some, 0)
            block.values[some] = block.values.take(some, 0) - both[:, : size + 1] / np.sqrt(sums)
            block.sums[some] = sums + both[:, size + 1 :]
    return loss


def train(
    pairs: DataFrame, n_words: int, *, size: int = 50, iterations: int = 25, x_max: float = 100.0, alpha: float = 0.75, eta: float = 0.05, grad_clip: float = 100.0, seed: int = 1, blocks: int | None = None, mirrored: bool = False
) -> tuple[DataFrame, list[float]]:
    """(idx, vector, context) of the words 0 .. n_words - 1, and the loss of each iteration.

    pairs (w1, w2, weight) are co-occurrences of a word with a context, as features.cooccurrence() gives them; weights of
    0 or less, null words and words outside are left out. vector and context hold size numbers each; biases aren't
    returned. Counts of a cell are fitted in a seeded random order. The result is the same for the same seed and number
    of blocks. mirrored: each pair stands once, w1 <= w2, and is fitted in both directions.
    """
    spark, o = pairs.sparkSession, Options(size, x_max, alpha, eta, grad_clip)
    if n_words < 1 or size < 1:
        raise ValueError("no words or no dimensions")
    # two blocks of an own size at least, so that several tasks share the work
    n = blocks or max(1, -(-n_words // BLOCK_WORDS), min(spark.sparkContext.defaultParallelism, n_words // 1000))
    folder = scratch_path(spark, "glove")
    rows = lambda number: len(range(number, n_words, n))

    # each cell is a file of packed (word, context, weight); mirrored, that of the smaller block serves both of them
    inside = pairs.where((F.col("weight") > 0) & F.col("w1").between(0, n_words - 1) & F.col("w2").between(0, n_words - 1))
    width = -(-n_words // n)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            count += len(batch)
            if count > HELD_COUNTS:
                yield from packs(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, count = [], 0
        if count:
            yield from packs(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def packs(w: np.ndarray, c: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        if mirrored:
            turn = w % n > c % n
            w, c = np.where(turn, c, w), np.where(turn, w, c)
        cell, key = w % n * n + c % n, w // n * width + c // n
        order = np.lexsort((key, cell))
        cell, key, x = cell[order].astype(np.int32), key[order], x[order]
        cuts = np.append(np.flatnonzero(np.diff(cell, prepend=-1)), len(cell)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + 1]), *(pa.array([v], t) for v, t in zip(packed.pack(key[a:b], x[a:b]), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True))], ["cell", *packed.NAMES])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], -1
        for b in batches:
            for number, *block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(packed.unpack(*block, np.float64))
        if held:
            keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((values, keys))
            whole = pa.table({k: [v] for k, v in zip(packed.NAMES, packed.pack(keys[order], values[order]), strict=True)})

            def put(f) -> None:
                with pa.ipc.new_file(f, whole.schema) as out:
                    out.write_table(whole)

            commit_file(f"{folder}/cell-{number}", put)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([len(keys)])], ["cell", "n"])

    cells = map_arrow(inside.select(F.col("w1").cast("bigint"), F.col("w2").cast("bigint"), F.col("weight").cast("double")), deal, f"cell int, {packed.BLOCK}").repartitionById(n * n, "cell")
    known = {r.cell for r in map_arrow(cells, write, "cell int, n bigint").collect()}  # one row a cell

    def counts(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Rows of word and context block and weights of a cell, in the order in which they are fitted."""
        turn = mirrored and i > j
        cell = j * n + i if turn else i * n + j
        if cell not in known:
            return None
        with open_file(f"{folder}/cell-{cell}") as f:
            block = pa.ipc.open_file(f).read_all().to_pylist()[0]
        keys, x = packed.unpack(*(block[k] for k in packed.NAMES), np.float64)
        w, c = np.divmod(keys, width)
        if mirrored and i == j:
            other = w != c
            w, c, x = np.concatenate((w, c[other])), np.concatenate((c, w[other])), np.concatenate((x, x[other]))
        order = np.random.default_rng([seed, i, j]).permutation(len(x))
        return (c[order], w[order], x[order]) if turn else (w[order], c[order], x[order])

    def round_(number: int) -> DataFrame:
        shift = number % n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    j = (i + shift) % n
                    word = Block.load(f"{folder}/round-{number - 1}/word-{i}", size) if number else Block.new(0, i, rows(i), size, seed)
                    context = Block.load(f"{folder}/round-{number - 1}/context-{j}", size) if number else Block.new(1, j, rows(j), size, seed)
                    loss = 0.0
                    if (got := counts(i, j)) is not None:
                        loss = fit_cell(word, context, *got, o)
                    word.save(f"{folder}/round-{number}/word-{i}")
                    context.save(f"{folder}/round-{number}/context-{j}")
                    yield pa.RecordBatch.from_arrays([pa.array([loss])], ["loss"])

        return map_arrow(spark.range(0, n, 1, n), run, "loss double")

    losses = []
    for epoch in range(max(iterations, 1)):
        losses.append(0.0)
        for number in range(epoch * n, (epoch + 1) * n):
            losses[-1] += sum(r.loss for r in round_(number).collect())  # one number a task
            drop(spark, f"{folder}/round-{number - 1}")  # every block of it has been read, and written anew
    end = max(iterations, 1) * n - 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                sides = [Block.load(f"{folder}/round-{end}/{side}-{i}", size).values[:, :-1] for side in ("word", "context")]
                ends = pa.array(np.arange(rows(i) + 1) * size, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, n_words, n)), *(pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(v).reshape(-1))) for v in sides)], ["idx", "vector", "context"])

    return map_arrow(spark.range(0, n, 1, n), read, "idx bigint, vector array<double>, context array<double>"), losses
