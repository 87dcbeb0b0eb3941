"""Operators on embeddings: DataFrames (idx, word, count, vector array<double or float>)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workers import map_arrow
from . import lookup

#: Tokens whose vectors are put together at a time.
TOKENS_AT_ONCE = 1 << 14


def norm(vector: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(embeddings: DataFrame, column: str = "vector") -> DataFrame:
    """Vectors scaled to length 1; a zero vector becomes NaN."""
    scaled = F.transform(column, lambda x: F.when(F.col("_norm") == 0, F.lit(float("nan"))).otherwise(x.cast("double") / F.col("_norm")))
    return embeddings.withColumn("_norm", norm(F.col(column))).withColumn(column, scaled).drop("_norm")


def concat(parts: list[DataFrame]) -> DataFrame:
    """Embedding sets one after another; idx runs on."""
    marked = [p.withColumn("_src", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(DataFrame.unionByName, marked)
    sizes = both.groupBy("_src").agg(F.count(F.lit(1)).alias("_n"))
    shift = sizes.select("_src", F.coalesce(F.sum("_n").over(Window.orderBy("_src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    return both.join(F.broadcast(shift), "_src").withColumn("idx", F.col("idx") + F.col("_shift")).drop("_src", "_shift")  # one row a set


def doc_vectors(corpus: DataFrame, embeddings: DataFrame, column: str = "sentences") -> DataFrame:
    """doc_ord, vectors: an array with the vector (or null) of each token of each valid document, in order.

    Vectors are looked up in mapped files, so neither tokens nor vectors are shuffled. A null or empty payload has no
    vectors; words must differ.
    """
    table = lookup.write(embeddings.select("word", "vector"), "word", "vector")
    kind = embeddings.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(1)
            sentences = docs.flatten()
            outer = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(docs), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            inner = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(sentences), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            words, ends = sentences.flatten(), inner[outer]
            first = 0
            while first < len(batch):  # a document at least, and some thousand tokens, at a time
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + TOKENS_AT_ONCE, "right")) - 1)
                vectors = table.find(words.slice(ends[first], ends[last] - ends[first]))
                lists = pa.ListArray.from_arrays(pa.array(ends[first : last + 1] - ends[first], pa.int32()), vectors)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists], ["doc_ord", "vectors"])
                first = last

    rows = corpus.where("error is null").select("doc_ord", F.col(column))
    return map_arrow(rows, run, f"doc_ord {corpus.schema['doc_ord'].dataType.simpleString()}, vectors array<{kind}>")


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine, euclidean or manhattan distance of two vectors."""
    pairs = lambda f: F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    if metric == "euclidean":
        return F.sqrt(pairs(lambda x, y: (x - y) * (x - y)))
    if metric == "manhattan":
        return pairs(lambda x, y: F.abs(x - y))
    if metric == "cosine":
        return 1.0 - pairs(lambda x, y: x * y) / (norm(a) * norm(b))
    raise ValueError(f"no metric {metric}")


#: Query vectors that one pass over the embeddings takes along.
QUERY_BLOCK = 4096


def nearest(queries: DataFrame, embeddings: DataFrame, k: int = 10, *, digits: int | None = None, id_col: str = "idx", column: str = "vector") -> DataFrame:
    """query, rank (from 1), neighbour, similarity: the k most cosine-similar vectors to each query, itself left out
    (ties: smaller id first). Zero vectors have similarity 0. With digits, similarities are rounded before they are ranked.

    Queries are a stated set: they go to the workers in blocks of QUERY_BLOCK, each partition answers with its own k
    best for each by matrix products, and only these are merged.
    """
    kind = embeddings.schema[id_col].dataType.simpleString()
    spark, rows = embeddings.sparkSession, embeddings.select(id_col, column).where(F.col(column).isNotNull())
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    parts = []
    for b in range(blocks):
        some = queries.select(id_col, column).where(F.col(column).isNotNull())
        some = some if blocks == 1 else some.where(F.pmod(F.hash(id_col), F.lit(blocks)) == b)
        got = some.orderBy(id_col).collect()
        ids, matrix = [r[0] for r in got], _unit(np.array([r[1] for r in got], np.float64))
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            best: list[tuple] = [()] * len(ids)
            for batch in batches:
                if not batch.num_rows or not ids:
                    continue
                own = np.array(batch.column(0).to_pylist())
                values = _unit(np.array(batch.column(1).to_pylist(), np.float64))
                similar = matrix @ values.T
                similar = similar if digits is None else np.round(similar, digits) + 0.0
                for i, q in enumerate(ids):
                    s = similar[i]
                    at = np.lexsort((own, -s))[: k + 1]
                    best[i] = tuple(sorted([*best[i], *((-float(s[j]), own[j].item()) for j in at if own[j] != q)])[:k])
            rows = [(q, -s, x) for q, found in zip(ids, best, strict=True) for s, x in found]
            if rows:
                q, s, x = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(x), pa.array(s)], ["query", "neighbour", "similarity"])

        parts.append(map_arrow(rows, run, f"query {kind}, neighbour {kind}, similarity double"))
    every = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "neighbour")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "neighbour", "similarity")


def _unit(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return x
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1.0)


def most_frequent(embeddings: DataFrame, words: int = 50, skip: int = 0, source: str = "source") -> DataFrame:
    """For a plot: of each source the words most frequent words after the skip first ones."""
    rank = F.row_number().over(Window.partitionBy(source).orderBy(F.col("count").desc(), "idx"))
    return embeddings.withColumn("rank", rank).where((F.col("rank") > skip) & (F.col("rank") <= skip + words))


def pairwise(points: DataFrame, metric: str = "cosine", *, id_col: str = "idx", column: str = "vector", most: int = 5000) -> DataFrame:
    """a, b, distance of every pair of a selection to plot. More than most points are refused: a plot's selection is
    a few dozen words, and this is no similarity join."""
    if points.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} points to compare")
    a = points.select(F.col(id_col).alias("a"), F.col(column).alias("_x"))
    b = points.select(F.col(id_col).alias("b"), F.col(column).alias("_y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", distance(F.col("_x"), F.col("_y"), metric).alias("distance"))
