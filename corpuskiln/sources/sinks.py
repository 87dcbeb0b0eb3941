"""Sinks: stored corpora, text files, embeddings for other tools, collected files."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import check_unique
from ..scratch import commit_file, drop, open_file, scratch_path
from ..workers import map_arrow


def store(corpus: DataFrame, path: str, *, append: bool = False, checked: bool = True) -> DataFrame:
    """Writes a corpus and returns it as read back. A repeated name in an archive fails unless checked is off; what is
    appended is checked against what is there as well."""
    if checked and append:
        jvm, conf = corpus.sparkSession._jvm, corpus.sparkSession._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(conf).exists(target):
            old = corpus.sparkSession.read.parquet(path).select("archive", "doc_name")
            check_unique(old.unionByName(corpus.select("archive", "doc_name"))).write.format("noop").mode("overwrite").save()
    (check_unique(corpus) if checked else corpus).write.mode("append" if append else "overwrite").parquet(path)
    return corpus.sparkSession.read.parquet(path)


def text_corpus(corpus: DataFrame, path: str, *, archive_dirs: bool = False, suffix: str | None = None, invalid: str = "skip", tar: bool = False) -> None:
    """Writes a text corpus as files under path, a local or mounted folder that all workers share.

    One file a document, in a folder for each archive with archive_dirs; or one tar file for each archive. suffix
    takes the place of a name's short extension. Invalid documents are left out, or empty with invalid='empty'.
    Files are many: for large corpora prefer store(). Each partition writes by itself.
    """
    rows = corpus.select("archive", "doc_name", "doc_ord", F.when(F.col("error").isNull(), F.col("text")).otherwise(F.lit("")).alias("text"), F.col("error").isNull().alias("ok"))
    if invalid == "skip":
        rows = rows.where("ok")

    def file_name(name: str) -> str:
        if suffix is None:
            return name
        return (re.sub(r"\.[^.]*$", "", name) if "." in name[-4:] else name) + suffix

    def write(part) -> None:
        open_tars: dict[str, tarfile.TarFile] = {}
        for r in part:
            name, data = file_name(r.doc_name), (r.text or "").encode()
            if tar:
                if r.archive not in open_tars:
                    Path(path).mkdir(parents=True, exist_ok=True)
                    open_tars[r.archive] = tarfile.open(Path(path) / f"{r.archive}.tar", "w")
                info = tarfile.TarInfo(name)
                info.size = len(data)
                open_tars[r.archive].addfile(info, io.BytesIO(data))
            else:
                to = Path(path, r.archive, name) if archive_dirs else Path(path, name)
                to.parent.mkdir(parents=True, exist_ok=True)
                to.write_bytes(data)
        for t in open_tars.values():
            t.close()

    if tar:
        rows = rows.repartition("archive").sortWithinPartitions("archive", "doc_ord")
    rows.foreachPartition(write)


def embedding_lines(embeddings: DataFrame) -> DataFrame:
    """idx, line: a vector's numbers between tabs."""
    return embeddings.select("idx", F.array_join(F.transform("vector", lambda x: x.cast("string")), "\t").alias("line"))


def _in_pieces(rows: DataFrame, outputs: dict[str, Callable[[pa.RecordBatch], bytes]], heads: dict[str, bytes]) -> None:
    """Writes files (path -> bytes of a batch) of rows in the order of idx: ranges of idx become pieces, written side by
    side, which are then strung together byte by byte behind heads."""
    spark, names = rows.sparkSession, list(outputs)
    folder, n = scratch_path(spark, "pieces"), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()

        def write(left: list[str], sinks: list) -> None:
            if left:
                commit_file(f"{folder}/{len(sinks)}-{number}", lambda f: write(left[1:], [*sinks, f]))
                return
            for batch in batches:
                for name, sink in zip(names, sinks, strict=True):
                    sink.write(outputs[name](batch))

        write(names, [])
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32())], ["piece"])

    made = sorted(r.piece for r in map_arrow(rows.repartitionByRange(n, "idx").sortWithinPartitions("idx"), run, "piece int").collect())  # one row a piece
    for i, name in enumerate(names):

        def join(f, i: int = i, name: str = name) -> None:
            f.write(heads.get(name, b""))
            for piece in made:
                with open_file(f"{folder}/{i}-{piece}") as part:
                    while data := part.read(1 << 20):
                        f.write(data)

        commit_file(name, join)
    drop(spark, folder)


def store_tsv(embeddings: DataFrame, path: str) -> None:
    """embeddings.tsv (vectors) and metadata.tsv (Word, Count with a header), both in the order of idx."""
    lines = embedding_lines(embeddings)
    _in_pieces(lines, {f"{path}/embeddings.tsv": lambda b: b"".join(x + b"\n" for x in b.column(1).cast(pa.binary()).to_pylist())}, {})
    embeddings.orderBy("idx").select(F.col("word").alias("Word"), F.col("count").alias("Count")).coalesce(1).write.mode("overwrite").csv(f"{path}/metadata.tsv", sep="\t", header=True)


def store_word2vec(embeddings: DataFrame, path: str) -> None:
    """A binary word2vec file and path.vocab, in the order of idx; spaces in words are marked. Vectors of different lengths
    are an error."""
    n, dim = embeddings.count(), len((embeddings.select("vector").first() or [[]])[0])
    mark = lambda w: w.replace(" ", "<space>").replace("\u00a0", "<nbspace>").encode()

    def vectors(batch: pa.RecordBatch) -> bytes:
        values = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(len(batch), dim)
        return b"".join(mark(w) + b" " + v.tobytes() + b"\n" for w, v in zip(batch.column(1).to_pylist(), values, strict=True))

    def counts(batch: pa.RecordBatch) -> bytes:
        return b"".join(b"%s %d\n" % (mark(w), c) for w, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))

    _in_pieces(embeddings.select("idx", "word", "count", "vector"), {path: vectors, f"{path}.vocab": counts}, {path: f"{n} {dim}\n".encode()})


def collect_files(spark: SparkSession, collections: list[list[str]], path: str, *, names: list[str] | None = None, subdirs: bool = False) -> list[str]:
    """Copies the files of several collections into path: into a folder for each, or with its number or name in front;
    returns the copies. Copies run through Hadoop's file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    width = len(str(max(0, len(collections) - 1)))
    for i, files in enumerate(collections):
        label = names[i] if names else f"{i:0{width}d}"
        for f in files:
            source = jvm.org.apache.hadoop.fs.Path(f)
            target = jvm.org.apache.hadoop.fs.Path(f"{path}/{label}/{source.getName()}" if subdirs else f"{path}/{label}_{source.getName()}")
            jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, True, conf)
            out.append(target.toString())
    return out


def chart_data(results: list[tuple[str, float | None]], spark: SparkSession) -> DataFrame:
    """label, value of results to chart; a missing one shows as ('unavailable', 0)."""
    rows = [(label, float(value)) if value is not None else ("unavailable", 0.0) for label, value in results]
    return spark.createDataFrame(rows, "label string, value double")


def copy_file(spark: SparkSession, source: str, target: str) -> None:
    """Copies one file out of (or into) a store, through Hadoop's file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
