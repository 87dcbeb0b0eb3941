"""Tables that tasks look values up in: files sorted by the keys' hashes in the shared folder, which workers map.

A table of any size costs a worker the pages that it touches, so nothing is joined, no frequent key makes a large task,
and nothing is sent around. Keys are compared whole; hashes only find them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import commit_file, open_file, scratch_path
from ..workers import map_arrow

#: Entries of a file, which one task sorts and writes.
FILE_ROWS = 1 << 21
#: Seed of Spark's xxhash64.
_SEED = 42


@dataclass
class SortedTable:
    """Files folder/0, folder/1, ...: hash, key, value, sorted by hash; file hash % files."""

    folder: str
    files: int
    rows: int
    key_type: pa.DataType
    value_type: pa.DataType
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_open": {}}  # maps are a task's own

    def _file(self, number: int) -> tuple[np.ndarray, pa.Array, pa.Array] | None:
        if number not in self._open:
            try:
                with open_file(f"{self.folder}/{number}") as f:
                    t = pa.ipc.open_file(f).read_all().combine_chunks()
                self._open[number] = (t["hash"].chunk(0).to_numpy(), t["key"].chunk(0), t["value"].chunk(0))
            except FileNotFoundError:  # no key fell into it
                self._open[number] = None
        return self._open[number]

    def find(self, keys: pa.Array) -> pa.Array:
        """The value of each key, null for those that the table doesn't have. Keys may repeat; null has no value."""
        coded = keys.cast(self.key_type).dictionary_encode()
        known = self._find_distinct(coded.dictionary)
        return known.take(coded.indices)

    def _find_distinct(self, keys: pa.Array) -> pa.Array:
        texts = keys.cast(pa.string()).cast(pa.binary()).to_pylist()
        h = np.fromiter((xxhash.xxh64_intdigest(t, _SEED) for t in texts), np.uint64, len(texts)).view(np.int64)
        parts, order = [], []
        for number in np.unique(h % self.files).tolist():
            mine = np.flatnonzero(h % self.files == number)
            opened = self._file(number)
            if opened is None:
                continue
            hashes, own, values = opened
            place, left = np.searchsorted(hashes, h[mine]), np.arange(len(mine))
            found = np.full(len(mine), -1)
            while len(left):  # entries of one hash stand side by side
                at = place[left]
                left, at = left[at < len(hashes)], at[at < len(hashes)]
                same = hashes[at] == h[mine[left]]
                left, at = left[same], at[same]
                equal = pc.equal(own.take(pa.array(at)), keys.take(pa.array(mine[left]))).to_numpy(zero_copy_only=False).astype(bool)
                found[left[equal]] = at[equal]
                left = left[~equal]
                place[left] += 1
            hit = np.flatnonzero(found >= 0)
            parts.append(values.take(pa.array(found[hit])))
            order.append(mine[hit])
        if not order:
            return pa.nulls(len(keys), self.value_type)
        where = np.full(len(keys), -1)
        where[np.concatenate(order)] = np.arange(sum(map(len, order)))
        return pa.concat_arrays(parts).take(pa.array(where, mask=where < 0))


def write(table: DataFrame, key: str, value: str) -> SortedTable:
    """Writes a table with different keys. Null keys are left out."""
    spark = table.sparkSession
    rows = table.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col(f"`{value}`").alias("value"))
    n = rows.count()
    files = max(1, -(-n // FILE_ROWS))
    folder = scratch_path(spark, "lookup")
    hashed = rows.select(F.xxhash64(F.col("key").cast("string")).alias("hash"), "key", "value").withColumn("file", F.pmod("hash", F.lit(files)).cast("int"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            number = whole["file"][0].as_py()

            def put(f) -> None:
                body = whole.select(["hash", "key", "value"])
                with pa.ipc.new_file(f, body.schema) as out:
                    out.write_table(body)

            commit_file(f"{folder}/{number}", put)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32())], ["file"])

    map_arrow(hashed.repartitionById(files, "file").sortWithinPartitions("hash"), save, "file int").collect()  # one row a file
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(rows.schema[c].dataType) for c in ("key", "value")]
    return SortedTable(folder, files, n, *kinds)
