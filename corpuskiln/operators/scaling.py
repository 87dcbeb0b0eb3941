"""Planar maps of vectors: landmark metric scaling and t-SNE, for cosine, euclidean and manhattan distances.

Metric scaling: a bounded number of landmarks is scaled by the eigenvectors of their doubly centred squared distances; every
other row is placed by its distances to the landmarks, in one pass. With no more rows than landmarks it is classical
scaling.

t-SNE: nearest neighbours are found block by block; each row's bandwidth is bisected to the perplexity asked for; the
probabilities of both directions are added over edges. Rows are then moved in rounds. A round is one job: a task reads the
state that all tasks left behind, moves the rows, and leaves the forces on its own rows: attraction along their edges, and
repulsion from a grid's cells, each standing for its rows by their number and centre (its rows themselves, if it is one
row's cell). The state is 10 numbers a row, in files on the shared folder; nothing goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import number_rows
from ..scratch import commit_file, drop, open_file, scratch_path, write_table
from ..workers import map_arrow

#: Landmarks at most: their distances are a matrix on the driver.
LANDMARKS = 500
#: Rows of a block of vectors.
BLOCK_ROWS = 4096
#: Rows whose neighbours one task finds, and those it compares with a block at a time.
TASK_ROWS, ROWS_AT_ONCE = 1024, 512
#: Rows of a block of t-SNE's state, unless there are more cores than such blocks: each task of a round reads all blocks.
STATE_ROWS = 1 << 16
#: Cells of the grid along each side.
GRID = 64


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """(row of a, row of b) distances. A zero vector has cosine distance 1 to all."""
    if metric == "cosine":
        unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1.0)
        return np.maximum(1.0 - unit(a) @ unit(b).T, 0.0)
    if metric == "euclidean":
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0))
    if metric == "manhattan":
        return np.stack([np.abs(a - row).sum(1) for row in b], 1) if len(b) else np.zeros((len(a), 0))
    raise ValueError(f"no metric {metric}")


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n and len(flat) % n:
        raise ValueError("vectors differ in length")
    return flat.reshape(n, -1)


def mds(rows: DataFrame, *, metric: str = "cosine", landmarks: int = LANDMARKS, dimensions: int = 2, seed: int = 1, id_col: str = "idx", column: str = "vector") -> DataFrame:
    """id, point: rows in the plane, distances kept as well as classical scaling can.

    Landmarks are the rows first in the order of a seeded hash of the id. Directions without variance are 0; the sign of
    a direction is such that its greatest landmark coordinate is positive. Rows without a vector have no point and no row.
    """
    if metric not in ("cosine", "euclidean", "manhattan"):
        raise ValueError(f"no metric {metric}")
    given = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("vector")).where("vector is not null")
    chosen = given.orderBy(F.xxhash64(F.lit(seed), F.col("id").cast("string")), "id").limit(landmarks).select("vector").collect()
    marks = np.array([r.vector for r in chosen], np.float64).reshape(len(chosen), -1 if chosen else 0)
    square = distances(marks, marks, metric) ** 2
    np.fill_diagonal(square, 0.0)
    mean = square.mean(0) if len(marks) else np.zeros(0)
    centred = -0.5 * (square - mean[None, :] - mean[:, None] + (mean.mean() if len(marks) else 0.0))
    values, vectors = np.linalg.eigh(centred) if len(marks) else (np.zeros(0), np.zeros((0, 0)))
    best = np.argsort(-values)[:dimensions]
    back = np.zeros((dimensions, len(marks)))
    for k, j in enumerate(best):
        if values[j] > 1e-9 * max(values.max(), 1e-300):
            v = vectors[:, j]
            back[k] = v * np.sign(v[np.abs(v).argmax()]) / np.sqrt(values[j])
    kind = given.schema["id"].dataType.simpleString()
    shared = given.sparkSession.sparkContext.broadcast((marks, mean, back))  # landmarks only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, mean, back = shared.value
        for batch in batches:
            if batch.num_rows:
                points = -0.5 * (distances(_matrix(batch.column(1)), marks, metric) ** 2 - mean) @ back.T
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1) * dimensions, pa.int32()), pa.array(np.ascontiguousarray(points).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "point"])

    return map_arrow(given, run, f"id {kind}, point array<double>").withColumnRenamed("id", id_col)


# --- t-SNE ---


def conditional(squared: np.ndarray, perplexity: float) -> np.ndarray:
    """For each row of squared distances to its neighbours (inf: none) the probabilities of a Gaussian whose perplexity,
    2 to the power of its entropy, is the one asked for, or the number of neighbours if these are fewer."""
    d = squared - squared.min(1, keepdims=True, initial=np.inf)
    there = np.isfinite(squared)
    d = np.where(there, d, 0.0)
    want = np.log(np.minimum(perplexity, np.maximum(there.sum(1), 1)))
    low, high, beta = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    p = np.zeros_like(d)
    for _ in range(100):
        p = np.exp(-np.minimum(d * beta[:, None], 700.0)) * there
        total = np.maximum(p.sum(1), 1e-300)
        p = p / total[:, None]
        entropy = np.log(total) + beta * (d * p).sum(1)
        flat = entropy > want
        low, high = np.where(flat, beta, low), np.where(flat, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
        if np.abs(entropy - want).max(initial=0.0) < 1e-7:
            break
    return p


def _blocks(rows: DataFrame, folder: str) -> None:
    """(at, vector) as files vectors-0, ...: the vectors of BLOCK_ROWS places each."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            number, body = t["block"][0].as_py(), _matrix(t["vector"].chunk(0))
            commit_file(f"{folder}/vectors-{number}", lambda f: f.write(np.array([body.shape[1]], np.int64).tobytes() + body.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([number])], ["block"])

    n = max(1, -(-rows.count() // BLOCK_ROWS))
    dealt = rows.select(F.expr(f"at div {BLOCK_ROWS}").cast("int").alias("block"), "at", "vector").repartitionById(n, "block").sortWithinPartitions("at")
    map_arrow(dealt, save, "block bigint").collect()  # one row a block


def _vectors(folder: str, block: int) -> np.ndarray:
    with open_file(f"{folder}/vectors-{block}") as f:
        data = f.read_buffer()
    return np.frombuffer(data, np.float64, offset=8).reshape(-1, int(np.frombuffer(data, np.int64, 1)[0]))


def nearer(near: np.ndarray, ids: np.ndarray, d: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of those so far (near, ids: in order, k a row, inf: none) and of a further block (squared distances d to
    the rows place, all with greater numbers); ties: smaller number first. Only what may be among them is put in order."""
    n, k = near.shape
    worst = near[:, -1].copy()
    open_ = np.flatnonzero(np.isinf(worst))
    if len(open_) and d.shape[1] > k:
        worst[open_] = np.nextafter(np.partition(d[open_], k - 1, axis=1)[:, k - 1], np.inf)  # ties with the last are in
    row, col = np.nonzero(d < worst[:, None])
    changed = np.unique(row)
    if not len(row):
        return near, ids
    rows = np.concatenate((np.repeat(changed, k), row))
    values, names = np.concatenate((near[changed].reshape(-1), d[row, col])), np.concatenate((ids[changed].reshape(-1), place[col]))
    order = np.lexsort((names, values, rows))
    begins = np.searchsorted(rows[order], changed)
    best = order[begins[:, None] + np.arange(k)]
    near[changed], ids[changed] = values[best], names[best]
    return near, ids


def neighbour_probabilities(rows: DataFrame, n: int, *, perplexity: float, metric: str, folder: str) -> DataFrame:
    """a, b, p over rows (at, vector) numbered from 0: conditional probability of neighbour b given a, over the 3 *
    perplexity nearest (ties: smaller number first). A task compares TASK_ROWS rows with all blocks of vectors."""
    k = int(min(3 * perplexity, max(n - 1, 1)))
    blocks = max(1, -(-n // BLOCK_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(first, ROWS_AT_ONCE)
                at, own = some.column(0).to_numpy(), _matrix(some.column(1))
                near, ids = np.full((len(at), k), np.inf), np.full((len(at), k), -1)
                for b in range(blocks):
                    other = _vectors(folder, b)
                    d = distances(own, other, metric) ** 2
                    place = b * BLOCK_ROWS + np.arange(len(other))
                    d[at[:, None] == place[None, :]] = np.inf
                    near, ids = nearer(near, ids, d, place)
                p = conditional(near, perplexity)
                keep = np.isfinite(near)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, k)[keep.reshape(-1)]), pa.array(ids[keep]), pa.array(p[keep])], ["a", "b", "p"])

    dealt = rows.select("at", "vector").repartitionById(max(1, -(-n // TASK_ROWS)), F.expr(f"at div {TASK_ROWS}").cast("int"))
    return map_arrow(dealt, run, "a bigint, b bigint, p double")


def repulsion(points: np.ndarray, own: slice) -> tuple[np.ndarray, float]:
    """Unnormalised repulsive forces on some points, and their part of the normaliser, from a grid over all points."""
    low, high = points.min(0), points.max(0)
    width = np.maximum((high - low) / GRID, 1e-12)
    cell = np.minimum(((points - low) / width).astype(np.int64), GRID - 1) @ np.array([GRID, 1])
    used, index, count = np.unique(cell, return_inverse=True, return_counts=True)
    sums = np.stack([np.bincount(index, points[:, k], len(used)) for k in range(2)], 1)
    force, total = np.zeros((own.stop - own.start, 2)), 0.0
    for first in range(own.start, own.stop, 1024):
        part = slice(first, min(first + 1024, own.stop))
        y, mine = points[part], index[part]
        n = np.broadcast_to(count.astype(np.float64), (len(y), len(used))).copy()
        n[np.arange(len(y)), mine] -= 1  # not from itself
        centre = np.broadcast_to(sums / count[:, None], (len(y), len(used), 2)).copy()
        rest = np.maximum(count[mine] - 1, 1)[:, None]
        centre[np.arange(len(y)), mine] = (sums[mine] - y) / rest
        away = y[:, None, :] - centre
        q = 1.0 / (1.0 + (away * away).sum(2))
        total += float((n * q).sum())
        force[first - own.start : part.stop - own.start] = ((n * q * q)[:, :, None] * away).sum(1)
    return force, total


def moved(state: np.ndarray, norm: float, step: int, rate: float, early: int) -> np.ndarray:
    """The state (y, velocity, gains, attraction, repulsion) after a step by the forces in it."""
    y, velocity, gains, pull, push = (state[:, 2 * i : 2 * i + 2] for i in range(5))
    gradient = 4 * ((12.0 if step < early else 1.0) * pull - push / max(norm, 1e-300))
    gains = np.maximum(np.where(np.sign(gradient) != np.sign(velocity), gains + 0.2, gains * 0.8), 0.01)
    velocity = (0.5 if step < early else 0.8) * velocity - rate * gains * gradient
    y = y + velocity
    return np.concatenate((y - y.mean(0), velocity, gains, pull, push), 1)


def tsne(rows: DataFrame, *, metric: str = "cosine", perplexity: float = 30.0, iterations: int = 500, early: int | None = None, rate: float | None = None, seed: int = 1, id_col: str = "idx", column: str = "vector") -> DataFrame:
    """id, point: rows in the plane, near ones together.

    perplexity is at most a third of the other rows. In the first early rounds (a quarter, 250 at most) attraction is 12
    times stronger. Rows without a vector have no row. The result is the same for the same seed. Ids must differ.
    """
    spark = rows.sparkSession
    given = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("vector")).where("vector is not null")
    numbered = write_table(number_rows(given, F.col("id"), name="at"), "tsne-rows")
    n = numbered.count()
    perplexity = max(1.0, min(perplexity, (n - 1) / 3))
    early = min(250, iterations // 4) if early is None else early
    rate = max(n / 12 / 4, 50.0) if rate is None else rate
    folder = scratch_path(spark, "tsne")
    _blocks(numbered, folder)
    one_way = write_table(neighbour_probabilities(numbered, n, perplexity=perplexity, metric=metric, folder=folder), "tsne-neighbours")
    both = one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"), "p")).groupBy("a", "b").agg((F.sum("p") / (2 * n)).alias("p"))
    blocks = max(1, min(-(-n // 256), max(spark.sparkContext.defaultParallelism, -(-n // STATE_ROWS))))
    size = -(-n // blocks)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            number, body = t["block"][0].as_py(), t.select(["a", "b", "p"])

            def put(f) -> None:
                with pa.ipc.new_file(f, body.schema) as out:
                    out.write_table(body)

            commit_file(f"{folder}/edges-{number}", put)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32())], ["block"])

    map_arrow(both.select(F.expr(f"a div {size}").cast("int").alias("block"), "a", "b", "p").repartitionById(blocks, "block").sortWithinPartitions("a", "b"), save, "block int").collect()  # one row a block
    for step in range(iterations):
        _round(spark, folder, n, blocks, size, step, rate, early, seed)
        drop(spark, f"{folder}/state-{step - 1}")
    kind = given.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = None
        for batch in batches:
            if batch.num_rows:
                y = _points(folder, n, blocks, iterations, rate, early, seed)[:, :2] if y is None else y
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * 2, pa.int32()), pa.array(np.ascontiguousarray(y[batch.column(1).to_numpy()]).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "point"])

    return map_arrow(numbered.select("id", "at"), read, f"id {kind}, point array<double>").withColumnRenamed("id", id_col)


def _points(folder: str, n: int, blocks: int, step: int, rate: float, early: int, seed: int) -> np.ndarray:
    """The state at the start of a round, from what the round before left."""
    if step == 0:
        y = np.random.default_rng(seed).normal(0, 1e-4, (n, 2))
        return np.concatenate((y, np.zeros((n, 2)), np.ones((n, 2)), np.zeros((n, 4))), 1)
    parts, norm = [], 0.0
    for b in range(blocks):
        with open_file(f"{folder}/state-{step - 1}/{b}") as f:
            data = np.frombuffer(f.read(), np.float64)
        norm += data[0]
        parts.append(data[1:].reshape(-1, 10))
    return moved(np.concatenate(parts), norm, step - 1, rate, early)


def _round(spark: SparkSession, folder: str, n: int, blocks: int, size: int, step: int, rate: float, early: int, seed: int) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                state = _points(folder, n, blocks, step, rate, early, seed)
                own = slice(min(b * size, n), min((b + 1) * size, n))
                y = state[:, :2]
                pull, norm = np.zeros((own.stop - own.start, 2)), 0.0
                try:
                    with open_file(f"{folder}/edges-{b}") as f:
                        t = pa.ipc.open_file(f).read_all()
                    a, c, p = (t.column(k).to_numpy() for k in range(3))
                    away = y[a] - y[c]
                    away *= (p / (1.0 + (away * away).sum(1)))[:, None]
                    for k in range(2):
                        pull[:, k] = np.bincount(a - own.start, away[:, k], len(pull))
                except FileNotFoundError:  # rows without a neighbour
                    pass
                push, norm = repulsion(y, own) if own.stop > own.start else (pull, 0.0)
                out = np.concatenate((state[own, :6], pull, push), 1)
                commit_file(f"{folder}/state-{step}/{b}", lambda f, norm=norm, out=out: f.write(np.array([norm]).tobytes() + np.ascontiguousarray(out).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([b])], ["block"])

    map_arrow(spark.range(0, blocks, 1, blocks), run, "block bigint").collect()  # one row a block
