"""What Python workers need: this package on every executor, and batches bounded by bytes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that a Python worker gets at once, unless the session sets another limit than Spark's own.
BATCH_BYTES = 8 << 20
#: Bytes that an operator goes over at once.
PIECE_BYTES = 4 << 20
_BATCH_CONF, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864", "67108864b", "64m", "64MB")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that their Python workers can import it; and bounds
    what a worker holds at once by bytes, as documents may be long."""
    context, root = spark.sparkContext, Path(__file__).parent
    if spark.conf.get(_BATCH_CONF, None) in _SPARKS_OWN:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    if getattr(context, "_corpuskiln_shipped", False) or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="corpuskiln-")) / "corpuskiln.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._corpuskiln_shipped = True


def give_back() -> None:
    """Returns a worker's freed memory to the machine: Spark keeps workers for further tasks, of other operators too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches, those above most bytes in even pieces of about so many; a row stays whole."""
    for batch in batches:
        n = min(-(-batch.nbytes // most), batch.num_rows)
        step = -(-batch.num_rows // max(n, 1))
        for first in range(0, batch.num_rows, step) if n > 1 else ():
            yield batch.take(pa.array(range(first, min(first + step, batch.num_rows))))  # a copy, so that nothing refers to the whole
        if n <= 1:
            yield batch


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, piece_bytes: int | None = PIECE_BYTES) -> DataFrame:
    """mapInArrow by a function that the workers can import. piece_bytes: what run gets at once (None: whole
    batches), as Spark bounds the batches of mapInArrow by rows only."""
    ship(df.sparkSession)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(pieces(batches, piece_bytes) if piece_bytes else batches)
        finally:
            give_back()

    return df.mapInArrow(bounded, schema)
