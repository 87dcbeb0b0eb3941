"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade >= k) = sigmoid(w . x - t_k) with weights w shared by all grades and ordered thresholds t_1 < t_2 < ...
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import binary_list, map_batches

#: log2 of the number of hashed features.
FEATURE_BITS = 20
#: At most this many labelled rows are fitted: those with the smallest seeded hash of their id.
SAMPLE_ROWS = 12_000
#: A feature enters the fit if its correlation with the grade is this many standard errors from zero; of few labelled
#: rows, which reach that seldom, the FEW strongest features enter if they reach half of it.
LEAST_Z, FEW = 5.0, 200
_PUNCT = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def features(text: bytes | None) -> np.ndarray:
    """Hashed features that a text has, ascending, each once: its words (lower case, without the punctuation around
    them), the punctuation and capitals of its words, and how repetitive it is. The whole text counts."""
    words = text.split() if text else []
    seen = set(words)
    found = set()
    for w in seen:
        core = w.strip(_PUNCT)
        tail = w[len(w.rstrip(_PUNCT)) :]
        found.add(core.lower())
        found.add(b"\x01" + tail + (b"U" if len(core) > 1 and core.isupper() else b""))
    if words:
        found.add(b"\x02%d" % (10 * len(seen) // len(words)))
        found.add(b"\x03%d" % min(20, len(words).bit_length()))
    mask = (1 << FEATURE_BITS) - 1
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(x) & mask for x in found), np.uint32, len(found)))


@dataclass
class OrdinalModel:
    weights: np.ndarray  # float32, one for each hashed feature
    thresholds: np.ndarray  # ascending

    def tails(self, text: bytes | None) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        return _sigmoid(float(self.weights[features(text)].sum(dtype=np.float64)) - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def fit(rows: list[np.ndarray], grades: np.ndarray, *, top: int = 2, least_z: float = LEAST_Z, l2: float = 1e-3, steps: int = 400) -> OrdinalModel:
    """Maximum likelihood by Adam on the features that correlate with the grade. Grades are 0, ..., top."""
    n = len(rows)
    weights = np.zeros(1 << FEATURE_BITS, np.float32)
    if n == 0:
        return OrdinalModel(weights, np.zeros(top))
    at = np.concatenate(rows).astype(np.int64)
    doc = np.repeat(np.arange(n), [len(r) for r in rows])
    centred = grades - grades.mean()
    has = np.bincount(at, minlength=1 << FEATURE_BITS)
    score = np.bincount(at, weights=centred[doc], minlength=1 << FEATURE_BITS)
    spread = np.sqrt(np.maximum(has * (1 - has / n), 1e-12)) * (grades.std() + 1e-12)
    z = np.where(has >= min(3, n), np.abs(score) / spread, 0.0)
    chosen = np.flatnonzero((z >= least_z) | ((z >= least_z / 2) & (z >= np.sort(z)[-FEW])))
    column = np.full(1 << FEATURE_BITS, -1)
    column[chosen] = np.arange(len(chosen))
    ok = column[at] >= 0
    x = np.zeros((n, len(chosen) + top), np.float32)
    x[doc[ok], column[at[ok]]] = 1.0
    # parameters: weights, first threshold, logs of the steps to the next ones
    p = np.zeros(len(chosen) + top)
    share = np.array([(grades >= k).mean() for k in range(1, top + 1)]).clip(0.01, 0.99)
    first = np.log((1 - share) / share)
    p[len(chosen)] = first[0]
    p[len(chosen) + 1 :] = np.log(np.maximum(np.diff(first), 0.05))
    m, v, d = np.zeros_like(p), np.zeros_like(p), len(chosen)
    x = np.ascontiguousarray(x[:, :d])
    for t in range(1, steps + 1):
        cut = p[d] + np.concatenate(([0.0], np.cumsum(np.exp(p[d + 1 :]))))
        s = x @ p[:d].astype(np.float32)
        upper = np.where(grades > 0, _sigmoid(s - cut[np.maximum(grades - 1, 0)]), 1.0)  # P(>= grade)
        lower = np.where(grades < top, _sigmoid(s - cut[np.minimum(grades, top - 1)]), 0.0)  # P(> grade)
        like = np.maximum(upper - lower, 1e-9)
        du, dl = np.where(grades > 0, upper * (1 - upper), 0.0) / like, np.where(grades < top, lower * (1 - lower), 0.0) / like
        g = np.zeros_like(p)
        g[:d] = -(x.T @ (du - dl).astype(np.float32)) / n + l2 * p[:d] / 10
        per = np.array([(np.where(grades == k, du, 0).sum() - np.where(grades == k - 1, dl, 0).sum()) / n for k in range(1, top + 1)])
        tail = np.cumsum(per[::-1])[::-1]
        g[d] = tail[0]
        g[d + 1 :] = tail[1:] * np.exp(p[d + 1 :])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights[chosen] = p[:d]
    return OrdinalModel(weights, p[d] + np.concatenate(([0.0], np.cumsum(np.exp(p[d + 1 :])))))


def grade(quality: Column, toxic: Column) -> Column:
    """The graded rating of a labelled row: 0 toxic, 1 harmless but poor, 2 good; null if a label is missing."""
    return F.when(toxic.isNull() | quality.isNull(), None).when(toxic > 0, 0).when(quality > 0, 2).otherwise(1)


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, top: int = 2, seed: int = 9, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> OrdinalModel:
    """Fits labels (id, grade) on a bounded sample: the sample_rows labelled ids with the smallest seeded hash.

    The sample's texts become features on the executors; the driver gets feature numbers only. Null ids and grades
    outside 0 to top are left out. Without labelled rows all weights and thresholds are 0.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")).cast("binary"))
    few = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{grade_col}`").cast("int").alias("_grade")).where(F.col("_id").isNotNull() & F.col("_grade").between(0, top)).orderBy(order, "_id", "_grade").limit(sample_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("_doc"), F.col(f"`{text_col}`").alias("text"))
    # sample_rows rows of two numbers: a proven bound for the broadcast
    rows = texts.join(F.broadcast(few), texts["_doc"] == few["_id"]).select("_id", "_grade", "text")

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = [features(t).tobytes() for t in binary_list(batch.column(2))]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["id", "grade", "features"])

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    got = sorted((r.id, r.grade, bytes(r.features)) for r in map_batches(rows, make, f"id {kind}, grade int, features binary").collect())
    return fit([np.frombuffer(f, np.uint32) for _, _, f in got], np.array([g for _, g, _ in got], np.int64), top=top)


def score(docs: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tails (array: P(grade >= 1), P(grade >= 2), ...) of each row.

    Null and empty texts have no features; null and repeated ids are fine; other columns are ignored. The model (a few
    MB, of fixed size) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        held = shared.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            tails = np.array([held.tails(t) for t in binary_list(batch.column(1))])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(tails) + 1) * tails.shape[1], pa.int32()), pa.array(tails.ravel()))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), lists], ["doc_id", "expected_grade", "tails"])

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), make, f"doc_id {kind}, expected_grade double, tails array<double>")


def select(docs: DataFrame, model: OrdinalModel, *, least_grade: int = 2, least_p: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs with P(grade >= least_grade) of at least least_p, all columns kept, judged in place."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        held = shared.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = binary_list(batch.column(batch.schema.get_field_index(text_col)))
            return batch.filter(pa.array([bool(held.tails(t)[least_grade - 1] >= least_p) for t in texts], pa.bool_()))

        return one

    return map_batches(docs, make, docs.schema)
