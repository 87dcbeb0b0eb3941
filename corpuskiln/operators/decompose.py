"""Decompositions of a matrix by rows: truncated SVD, independent components, factor analysis.

Rows stay distributed. What comes together is small: triangular factors for the SVD (a tree of QR factors over blocks of
rows, each of the size of the rank asked for, squared), and moment matrices of the columns for the other two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import commit_file, open_file, scratch_path, write_table
from ..workers import map_arrow

#: Triangular factors that one task joins.
FAN_IN = 32
#: Rows (features) of a block of the right side.
BLOCK_ROWS = 1 << 16
#: Numbers that a task multiplies at a time, and sums of features that it holds.
AT_ONCE, HELD = 1 << 21, 1 << 23
#: Columns at most for moments, which are a square of them.
MOST_COLUMNS = 4096


# --- truncated SVD ---


@dataclass
class Svd:
    """values: descending; left (id, features) of the rows, right (id, features) of the columns."""

    values: np.ndarray
    left: DataFrame
    right: DataFrame


def _normal(columns: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """(column, rank) numbers of a standard normal by hash, the same wherever they are asked for."""
    x = columns.astype(np.uint64)[:, None] * np.uint64(2 * rank) + np.arange(2 * rank, dtype=np.uint64)[None, :] + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.sqrt(-2 * np.log1p(-u[:, :rank])) * np.cos(2 * np.pi * u[:, rank:])


@dataclass
class _Right:
    """A (column, rank) matrix: random numbers, or blocks of files (column c is row c // blocks of block c % blocks)."""

    rank: int
    seed: int = 0
    folder: str | None = None
    blocks: int = 1

    def rows(self, columns: np.ndarray, held: dict) -> np.ndarray:
        if self.folder is None:
            return _normal(columns, self.rank, self.seed)
        out = np.empty((len(columns), self.rank))
        for b in np.unique(columns % self.blocks).tolist():
            if b not in held:
                with open_file(f"{self.folder}/{b}") as f:
                    held[b] = np.frombuffer(f.read_buffer(), np.float64).reshape(-1, self.rank)
            mine = columns % self.blocks == b
            out[mine] = held[b][columns[mine] // self.blocks]
        return out


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row offsets, columns, values."""
    lists = batch.column(1)
    size = np.diff(lists.offsets.to_numpy())
    return np.concatenate(([0], np.cumsum(size))), lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()


def _times(offsets: np.ndarray, columns: np.ndarray, values: np.ndarray, right: _Right, held: dict) -> np.ndarray:
    """Rows of the matrix times right."""
    out = np.zeros((len(offsets) - 1, right.rank))
    first, step = 0, max(1, AT_ONCE // right.rank)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for first in range(0, len(columns), step):
        part = slice(first, first + step)
        distinct, index = np.unique(columns[part], return_inverse=True)
        np.add.at(out, row[part], right.rows(distinct, held)[index] * values[part][:, None])
    return out


def _triangle(parts: DataFrame, rank: int) -> np.ndarray:
    """The joint triangular factor of factors (r), joined FAN_IN at a time."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, rank))
        for batch in batches:
            if batch.num_rows:
                r = np.linalg.qr(np.concatenate((r, batch.column(0).flatten().to_numpy().reshape(-1, rank))), "r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.reshape(-1).tolist()], pa.list_(pa.float64()))], ["r"])

    now = write_table(parts, "triangles")
    while (n := now.count()) > FAN_IN:
        now = write_table(map_arrow(now.repartition(-(-n // FAN_IN)), join, "r array<double>"), "triangles")
    held = [np.array(x.r).reshape(-1, rank) for x in now.collect()]  # FAN_IN at most
    return np.linalg.qr(np.concatenate([np.zeros((rank, rank)), *held]), "r")


def _inverse(r: np.ndarray) -> np.ndarray:
    """Pseudo-inverse, so that a matrix of less rank than asked for is fine."""
    return np.linalg.pinv(r, rcond=1e-12)


def svd(cells: DataFrame, rank: int, *, oversampling: int = 10, rounds: int = 4, seed: int = 1, row: str = "term_id", column: str = "feature_id", value: str = "n") -> Svd:
    """The rank greatest singular values of a sparse matrix of cells, with their vectors, by a random range and rounds
    of subspace iteration.

    Cells of one place are added up; cells with nulls are left out. Row and column numbers are not negative. Vectors of
    values that are 0 (or beyond the matrix's rank) are 0; the sign of a pair of vectors is arbitrary.
    """
    spark = cells.sparkSession
    if rank < 1:
        raise ValueError("rank must be 1 or more")
    named = cells.select(F.col(row).cast("bigint").alias("row"), F.col(column).cast("bigint").alias("column"), F.col(value).cast("double").alias("value")).dropna()
    once = named.groupBy("row", "column").agg(F.sum("value").alias("value"))
    lists = once.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("column", "value"))).alias("x"))
    matrix = write_table(lists.select("row", F.col("x.column").alias("columns"), F.col("x.value").alias("values")), "svd-rows")
    width = (matrix.agg(F.max(F.array_max("columns"))).first()[0] or 0) + 1
    wide = rank + oversampling
    blocks = max(1, -(-width // BLOCK_ROWS))

    def triangle_of_rows(right: _Right) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r, held = np.zeros((0, wide)), {}
            for batch in batches:
                if batch.num_rows:
                    r = np.linalg.qr(np.concatenate((r, _times(*_lists(batch), right, held))), "r")
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array([r.reshape(-1).tolist()], pa.list_(pa.float64()))], ["r"])

        return _triangle(map_arrow(matrix, run, "r array<double>"), wide)

    def back(right: _Right, t: np.ndarray) -> tuple[_Right, np.ndarray]:
        """The transposed matrix times (matrix times right times t), and its triangular factor."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            at: dict[int, int] = {}
            sums = np.zeros((1024, wide))

            def take() -> pa.RecordBatch:
                nonlocal at, sums
                n = len(at)
                out = pa.RecordBatch.from_arrays([pa.array(np.array(list(at), np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * wide, pa.int32()), pa.array(sums[:n].reshape(-1)))], ["column", "sums"])
                at, sums = {}, np.zeros((1024, wide))
                return out

            for batch in batches:
                offsets, columns, values = _lists(batch)
                q = _times(offsets, columns, values, right, held) @ t
                line = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                for first in range(0, len(columns), max(1, AT_ONCE // wide)):
                    part = slice(first, first + max(1, AT_ONCE // wide))
                    distinct, index = np.unique(columns[part], return_inverse=True)
                    place = np.fromiter((at.setdefault(c, len(at)) for c in distinct.tolist()), np.int64, len(distinct))
                    while len(at) > len(sums):
                        sums = np.concatenate((sums, np.zeros_like(sums)))
                    np.add.at(sums, place[index], q[line[part]] * values[part][:, None])
                    if len(at) * wide > HELD:
                        yield take()
            if at:
                yield take()

        folder = scratch_path(spark, "svd-right")
        new = _Right(wide, folder=folder, blocks=blocks)

        def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, out = -1, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                block = batch.column(0)[0].as_py()
                out = np.zeros((len(range(block, width, blocks)), wide)) if out is None else out
                some = batch.filter(pa.array(batch.column(1).to_numpy() >= 0))
                np.add.at(out, some.column(1).to_numpy() // blocks, some.column(2).flatten().to_numpy().reshape(-1, wide))
            if out is not None:
                commit_file(f"{folder}/{block}", lambda f: f.write(out.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([np.linalg.qr(out, "r").reshape(-1).tolist()], pa.list_(pa.float64()))], ["r"])

        dealt = map_arrow(matrix, run, "column bigint, sums array<double>").select((F.col("column") % blocks).cast("int").alias("block"), "column", "sums")
        every = spark.range(blocks).select(F.col("id").cast("int").alias("block"), F.lit(-1).cast("long").alias("column"), F.array().cast("array<double>").alias("sums"))
        return new, _triangle(map_arrow(dealt.unionByName(every).repartitionById(blocks, "block"), save, "r array<double>"), wide)

    right, turn = _Right(wide, seed), np.eye(wide)
    for _ in range(max(rounds, 1)):
        # q = matrix right turn t has orthonormal columns; the next right is the transposed matrix times q
        t = turn @ _inverse(_turned(triangle_of_rows(right), turn))
        before, (right, r) = right, back(right, t)
        turn = _inverse(r)
    u, values, v = np.linalg.svd(r.T)  # the matrix is near q r^T (right turn)^T
    keep = values > 1e-12 * max(values[0], 1e-300)
    values = np.where(keep, values, 0.0)[:rank]
    u, v = (u * keep)[:, :rank], (v.T * keep)[:, :rank]
    return Svd(values, _products(matrix, before, t @ u), _combined(spark, right, turn @ v, width))


def _turned(r: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The triangular factor of a matrix with factor r after its columns were combined by turn."""
    return np.linalg.qr(r @ turn, "r")


def _rows_out(ids: pa.Array, rows: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).reshape(-1)))
    return pa.RecordBatch.from_arrays([ids, lists], ["id", "features"])


def _products(matrix: DataFrame, right: _Right, t: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if batch.num_rows:
                yield _rows_out(batch.column(0), _times(*_lists(batch), right, held) @ t)

    return map_arrow(matrix, run, "id bigint, features array<double>")


def _combined(spark: SparkSession, right: _Right, t: np.ndarray, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                columns = np.arange(b, width, right.blocks)
                for first in range(0, len(columns), 4096):
                    part = columns[first : first + 4096]
                    yield _rows_out(pa.array(part), right.rows(part, {}) @ t)

    return map_arrow(spark.range(0, right.blocks, 1, right.blocks), run, "id bigint, features array<double>")


# --- moments ---


def _summed(rows: DataFrame, shape: tuple[int, ...], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of of(rows of a batch) over all batches: one array a task, added up in Spark."""
    size = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(shape), False
        for batch in batches:
            if batch.num_rows:
                total, seen = total + of(_dense(batch.column(0))), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1).tolist()], pa.list_(pa.float64()))], ["x"])

    got = map_arrow(rows, run, "x array<double>").select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got.column("at").to_numpy()] = got.column("v").to_numpy()
    return out.reshape(shape)


def _dense(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) % len(column):
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1)


def _moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance (divided by the number) of rows (vector)."""
    some = vectors.first()
    if some is None:
        raise ValueError("no rows")
    d = len(some.vector)
    if d > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    total = _summed(vectors, (d + 1,), lambda x: np.append(x.sum(0), len(x)))
    n, mean = int(round(total[-1])), total[:-1] / total[-1]
    return n, mean, _summed(vectors, (d, d), lambda x: (x - mean).T @ (x - mean)) / n


def _mapped(rows: DataFrame, id_type: str, mean: np.ndarray, t: np.ndarray) -> DataFrame:
    """id, features: (row - mean) times t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _rows_out(batch.column(0), (_dense(batch.column(1)) - mean) @ t)

    return map_arrow(rows, run, f"id {id_type}, features array<double>")


def _given(rows: DataFrame, id_col: str, column: str) -> tuple[DataFrame, str]:
    given = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("vector")).where("vector is not null")
    return given, given.schema["id"].dataType.simpleString()


@dataclass
class Components:
    """sources: id, features of each row; mixing: (column, component), so that rows are near mean + features mixing^T."""

    sources: DataFrame
    mixing: np.ndarray
    mean: np.ndarray
    noise: np.ndarray | None = None
    iterations: int = 0


def principal(rows: DataFrame, k: int, *, id_col: str = "idx", column: str = "vector") -> Components:
    """Principal components: the covariance's first k eigenvectors, and the rows along them. The sign of each is such that
    its greatest loading is positive."""
    given, kind = _given(rows, id_col, column)
    _, mean, cov = _moments(given.select("vector"))
    values, vectors = np.linalg.eigh(cov)
    t = vectors[:, np.argsort(-values)[:k]]
    t = t * np.sign(t[np.abs(t).argmax(0), np.arange(t.shape[1])])
    return Components(_mapped(given, kind, mean, t), t, mean)


def fast_ica(rows: DataFrame, k: int, *, max_iter: int = 200, tol: float = 1e-4, seed: int = 1, id_col: str = "idx", column: str = "vector") -> Components:
    """Independent components by symmetric fixed-point steps with the log cosh contrast on whitened rows.

    A step is one pass whose result is a matrix of k rows and columns. Sources have variance 1, their sign and order are
    arbitrary. Rows without a vector are left out; k is at most the rank of the covariance.
    """
    given, kind = _given(rows, id_col, column)
    _, mean, cov = _moments(given.select("vector"))
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    if len(order) < k or values[order[-1]] <= 1e-12 * values[order[0]]:
        raise ValueError("fewer directions than components")
    whiten = vectors[:, order] / np.sqrt(values[order])  # (column, k)
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    done = 0
    for done in range(1, max_iter + 1):

        def step(x: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            z = (x - mean) @ whiten
            g = np.tanh(z @ w.T)
            return np.concatenate((g.T @ z, (1 - g * g).sum(0)[:, None], np.full((k, 1), float(len(z)))), 1)

        s = _summed(given.select("vector"), (k, k + 2), step)
        u, _, v = np.linalg.svd((s[:, :k] - s[:, k][:, None] * w) / s[:, k + 1][:, None])
        new = u @ v
        turned = np.abs(np.abs((new * w).sum(1)) - 1).max()
        w = new
        if turned < tol:
            break
    t = whiten @ w.T
    return Components(_mapped(given, kind, mean, t), np.linalg.pinv(t).T, mean, iterations=done)


def factor_analysis(rows: DataFrame, k: int, *, max_iter: int = 1000, tol: float = 1e-8, id_col: str = "idx", column: str = "vector") -> Components:
    """Factors with a noise variance for each column, by expectation-maximisation on the covariance, which is all that
    it needs of the rows. sources are the factors' expectations; factors are fixed up to a rotation."""
    given, kind = _given(rows, id_col, column)
    n, mean, cov = _moments(given.select("vector"))
    d = len(mean)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    loading = vectors[:, order] * np.sqrt(np.maximum(values[order], 1e-12))
    noise = np.maximum(np.diag(cov) - (loading * loading).sum(1), 1e-6 * np.maximum(np.diag(cov), 1e-12))
    last, done = -np.inf, 0
    for done in range(1, max_iter + 1):
        scaled = loading / noise[:, None]
        inner = np.linalg.inv(np.eye(len(order)) + loading.T @ scaled)
        beta = inner @ scaled.T  # expectation of the factors is beta (row - mean)
        second = inner + beta @ cov @ beta.T
        sign, log_det = np.linalg.slogdet(loading @ loading.T + np.diag(noise))
        likelihood = -0.5 * (log_det + np.trace(np.linalg.solve(loading @ loading.T + np.diag(noise), cov)))
        loading = cov @ beta.T @ np.linalg.inv(second)
        noise = np.maximum(np.diag(cov) - ((cov @ beta.T) * loading).sum(1), 1e-12)
        if likelihood - last < tol * abs(likelihood):
            break
        last = likelihood
    scaled = loading / noise[:, None]
    beta = np.linalg.inv(np.eye(len(order)) + loading.T @ scaled) @ scaled.T
    return Components(_mapped(given, kind, mean, beta.T), loading, mean, noise, done)
