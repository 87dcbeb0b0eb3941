"""Intermediate tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_fallback_dir: str | None = None


def _root(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir. Only a local master may go without that setting; it then
    gets a temporary folder of its own, which goes when the process ends."""
    global _fallback_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _fallback_dir is None:
            _fallback_dir = tempfile.mkdtemp(prefix="corpuskiln-")
            atexit.register(shutil.rmtree, _fallback_dir, ignore_errors=True)
        base = f"file://{_fallback_dir}"
    return f"{base.rstrip('/')}/corpuskiln/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{_root(spark)}/{label}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and returns the written table."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes all that this application has written into the shared folder. Results that still read it are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a stored path when all that was made of it is stored itself, so that no lost task needs it again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri.removeprefix("file:").lstrip("/")
    return uri if "://" not in uri else None


def commit_file(uri: str, write: Callable[[object], None]) -> None:
    """Writes a file under a temporary name and renames it, so that lost or repeated tasks leave whole files only."""
    path, mark = local_path(uri), f".{uuid.uuid4().hex}.part"
    if path is None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(path + mark) as sink:
            write(sink)
        store.move(path + mark, path)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    try:
        with pa.OSFile(path + mark, "wb") as sink:
            write(sink)
        os.replace(path + mark, path)
    finally:
        if os.path.exists(path + mark):
            os.unlink(path + mark)


def open_file(uri: str):
    """A file for random access: memory-mapped if it has a path here, else read through its store."""
    path = local_path(uri)
    if path is not None:
        return pa.memory_map(path)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
