"""Helpers that the training-data operators share: words, hashes, Arrow batches and scratch tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import workers
from ..scratch import commit_file, local_path, open_file, scratch_path, write_table  # noqa: F401

#: Batches stay whole: they are shards, and their size was measured.
map_arrow = partial(workers.map_arrow, piece_bytes=None)

#: White space that separates words, as the contracts fix it: space and \t \n \v \f \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def store(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As write_table, with the path, for drop()."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a stored table when all that was made of it is stored itself, so that no lost task needs it again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def binary_list(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding it."""
    return column.cast(pa.binary()).to_pylist()


def words_of(text: bytes | None) -> list[bytes]:
    """Words of [^\\x20\\x09-\\x0D]+; bytes.split() separates at exactly these bytes. Null has none."""
    return text.split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with a function for one batch; make() runs once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            if batch.num_rows and (out := one(batch)) is not None:
                yield out

    return map_arrow(df, run, schema)


def word_count(text: Column) -> Column:
    """Number of words, inside the JVM; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def pinned(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that a caller's other columns can't clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])
