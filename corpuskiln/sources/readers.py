"""Sources: text files, tar archives, XML, vertical text, tables, stored corpora and embeddings."""

from __future__ import annotations

import html
import io
import json
import re
import tarfile
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import europarl_lines, split_lines
from ..model import ERROR_TYPE, error, from_table, no_error, number_in_files
from ..scratch import local_path, write_table
from ..workers import map_arrow, ship

#: Characters of members of an archive that are held before they are given out.
TAR_CHARS = 1 << 20
_RANGE = re.compile(r"^(?P<path>.+?)(?::(?P<a>\d+)-(?P<b>\d+)|:(?P<c>\d+)-|:-(?P<d>\d+))?$")


def _binary_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of all files of a path, file, folder or glob. Spark's reader leaves out what is empty, so the paths that
    only its listing has are added."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    uris = json.loads(spark._jvm.com.fasterxml.jackson.databind.ObjectMapper().writeValueAsString(found._jdf.inputFiles()))  # in one piece: a call for each name is slow
    listed = spark.createDataFrame(pa.table({"uri": pa.array(uris, pa.string())}))
    local = lambda x: F.regexp_replace(x, "^file:/+", "file:/")
    plain = F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))
    empty = listed.select(local(plain).alias("path")).join(found.select(local(F.col("path")).alias("path")), "path", "left_anti")
    return found.select("path", "content").unionByName(empty.select("path", F.lit(b"").alias("content")))


def _file_table(spark: SparkSession, files: list[str], exclude: list[str] | None) -> DataFrame:
    """path, content, first, last (line range) of all files. A leading ? marks a file that may be missing."""
    parts = []
    for item in files:
        optional, m = item.startswith("?"), _RANGE.match(item.removeprefix("?"))
        first = int(m["a"] or m["c"] or 0)
        last = int(m["b"] or m["d"] or 0)
        try:
            df = _binary_files(spark, m["path"])
        except Exception:
            if optional:
                continue
            raise
        parts.append(df.select("path", "content", F.lit(first).alias("first"), F.lit(last).alias("last"), F.lit(m["path"]).alias("root")))
    if not parts:
        raise FileNotFoundError(f"none of {files} exists")
    every = reduce(DataFrame.unionByName, parts)
    for x in exclude or ():
        gone = _binary_files(spark, x).select("path")
        every = every.join(gone, "path", "left_anti")
    return every


def _unique_names(df: DataFrame) -> DataFrame:
    """Clashing doc_names get -0, -1, ... in the order of paths."""
    same = Window.partitionBy("doc_name")
    at = F.row_number().over(same.orderBy("path")) - 1
    return df.withColumn("_n", F.count(F.lit(1)).over(same)).withColumn("_at", at).withColumn("doc_name", F.when(F.col("_n") > 1, F.concat_ws("-", "doc_name", "_at")).otherwise(F.col("doc_name"))).drop("_n", "_at")


def _decoded(content: Column, encoding: str, errors: str = "strict") -> Column:
    """Bytes as text. errors is what to do with bytes that are none: strict (fail), ignore, replace."""
    if errors not in ("strict", "ignore", "replace"):
        raise ValueError(f"encoding_errors can't be {errors}")
    if errors != "strict":

        @F.pandas_udf("string")
        def decode(x: pd.Series) -> pd.Series:
            return x.map(lambda b: None if b is None else bytes(b).decode(encoding, errors))

        return decode(content)
    return F.decode(content, {"utf8": "UTF-8", "utf-8": "UTF-8", "latin1": "ISO-8859-1", "latin-1": "ISO-8859-1", "ascii": "US-ASCII"}.get(encoding.lower(), encoding))


def _as_corpus(df: DataFrame, payload: dict[str, Column]) -> DataFrame:
    """Rows (path, doc_name, ...), one a file, as a corpus in the order of paths."""
    ordered = number_in_files(df.withColumn("_place", F.lit(0)), "_place")
    return ordered.select(F.lit("corpus").alias("archive"), "doc_name", "doc_ord", *[c.alias(n) for n, c in payload.items()], no_error().alias("error"))


def text_files(spark: SparkSession, files: list[str], *, exclude: list[str] | None = None, encoding: str = "utf8", encoding_errors: str = "strict") -> DataFrame:
    """One document a file, by sorted path: globs and folders; path:X-Y takes lines X to Y (from 1)."""
    raw = _file_table(spark, files, exclude)
    text = _decoded(F.col("content"), encoding, encoding_errors)
    lines = F.slice(split_lines(text), F.greatest(F.col("first"), F.lit(1)), F.when(F.col("last") > 0, F.col("last") - F.greatest(F.col("first"), F.lit(1)) + 1).otherwise(F.lit(2**31 - 1)))
    ranged = F.when((F.col("first") > 0) | (F.col("last") > 0), F.array_join(lines, "\n")).otherwise(text)
    named = _unique_names(raw.withColumn("doc_name", F.element_at(F.split("path", "/"), -1)))
    return _as_corpus(named, {"text": ranged})


def text_archives(spark: SparkSession, files: list[str], *, encoding: str = "utf8", encoding_errors: str = "strict") -> DataFrame:
    """One document a member of tar archives (.tar, .tar.gz, .tgz, ...); names without extension, after the archive's
    name if there are several."""
    found = spark.read.format("binaryFile").load(files)
    mounted = all(f.startswith("file:") for f in found.inputFiles())  # then members are read one by one, never a whole archive
    raw = found.select("path", (F.lit(None) if mounted else F.col("content")).cast("binary").alias("content"))
    several = len(files) > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list[tuple]) -> pa.RecordBatch:
            path, name, at, text = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(name, pa.string()), pa.array(at, pa.int64()), pa.array(text, pa.string())], ["path", "doc_name", "at", "text"])

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, at = [], 0, 0
                base = re.sub(r"(\.tar)?(\.\w+)?$", "", path.rsplit("/", 1)[-1])
                with io.BytesIO(content) if content is not None else open(local_path(path), "rb") as whole, tarfile.open(fileobj=whole) as tar:
                    for member in tar:
                        tar.members = []  # the archive would remember every member
                        if not member.isfile():
                            continue
                        name = re.sub(r"\.[^./]*$", "", member.name)
                        text = tar.extractfile(member).read().decode(encoding, encoding_errors)
                        rows.append((path, f"{base}/{name}" if several else name, at, text))
                        held, at = held + len(text), at + 1
                        if held >= TAR_CHARS:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    found = map_arrow(raw, run, "path string, doc_name string, at bigint, text string")
    ordered = number_in_files(found)
    return ordered.select(F.lit("corpus").alias("archive"), "doc_name", "doc_ord", "text", no_error().alias("error"))


def xml_text(markup: Column, node: str = "doc") -> Column:
    """Texts of all elements named node in possibly malformed markup: tags out, the five basic entities decoded."""
    inside = F.regexp_extract_all(markup, F.lit(f"(?is)<{node}(?:\\s[^>]*)?>(.*?)</{node}\\s*>"), F.lit(1))
    return F.transform(inside, _bare)


def _bare(x: Column) -> Column:
    out = F.regexp_replace(x, "(?s)<!--.*?-->|<[^>]*>", "")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


_XML_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z_][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)


def xml_elements(markup: str, node: str) -> list[tuple[str, str]]:
    """(attributes, text) of every element named node (in any case), nested ones too, in the order of their start tags.

    Text is that of all that the element holds, with named and numeric references decoded and CDATA taken as it is; comments
    and tags go. An element that isn't closed ends with the markup, an end tag that closes nothing is ignored.
    """
    wanted, pieces = node.lower(), []
    out: list[list] = []  # attributes, first piece, end
    open_: list[int] = []
    at = 0
    for m in _XML_PIECE.finditer(markup):
        pieces.append(html.unescape(markup[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            pieces.append(m[1])
        if (m[3] or "").lower() != wanted:
            continue
        if m[2]:
            if open_:
                out[open_.pop()][2] = len(pieces)
        else:
            out.append([m[4], len(pieces), len(pieces) if m[4].endswith("/") else None])
            if out[-1][2] is None:
                open_.append(len(out) - 1)
    pieces.append(html.unescape(markup[at:]))
    return [(head, "".join(pieces[first:end])) for head, first, end in out]


def xml_files(
    spark: SparkSession, files: list[str], *, exclude: list[str] | None = None, encoding: str = "utf8", encoding_errors: str = "strict", node: str = "doc", name_attr: str = "filename", attrs: dict[str, str] | None = None
) -> DataFrame:
    """One document an element named node, by file and place: named by name_attr, or by the file (with -1, -2, ...
    for further ones); attrs keeps elements with these attribute values. Files ending in .gz are unpacked. Nested elements
    are documents of their own beside the one around them."""
    raw = _file_table(spark, files, exclude).select("path", "content")
    wanted = dict(attrs or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                rows = []
                for head, text in xml_elements(body.decode(encoding, encoding_errors), node):
                    given = {k: html.unescape(x or y) for k, x, y in _XML_ATTRIBUTE.findall(head)}
                    if all(given.get(k) == v for k, v in wanted.items()):
                        rows.append((given.get(name_attr, ""), text))
                for first in range(0, len(rows), 1000):
                    part = rows[first : first + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(range(first, first + len(part)), pa.int64()), pa.array([x for x, _ in part], pa.string()), pa.array([x for _, x in part], pa.string())], ["path", "at", "given", "text"])

    rows = map_arrow(raw, run, "path string, at bigint, given string, text string")
    base = F.element_at(F.split("path", "/"), -1)
    rows = rows.withColumn("doc_name", F.when(F.col("given") != "", F.col("given")).otherwise(F.when(F.col("at") > 0, F.concat_ws("-", base, "at")).otherwise(base)))
    ordered = number_in_files(write_table(rows, "xml"))
    return ordered.select(F.lit("corpus").alias("archive"), "doc_name", "doc_ord", "text", no_error().alias("error"))


_XML_ATTRIBUTE = re.compile(r"""([^\s=/]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")


def europarl(corpus: DataFrame) -> DataFrame:
    """A text corpus of proceedings, cleaned (see europarl_lines); with fewer than 4 lines left it is invalid."""
    lines = europarl_lines(F.col("text"))
    short = F.size("_lines") < 4
    out = corpus.withColumn("_lines", lines)
    bad = F.when(F.col("error").isNotNull(), F.col("error")).when(short, error("europarl_reader", "fewer than 4 lines")).cast(ERROR_TYPE)
    return out.withColumn("text", F.when(bad.isNull(), F.array_join("_lines", "\n"))).withColumn("error", bad).drop("_lines")


def vertical_text(spark: SparkSession, files: list[str], fields: list[str]) -> DataFrame:
    """Documents between <text ...> and </text> of vertical-text files: a word a line, its fields between tabs,
    <sentence> elements as sentences (else the whole text is one). Text that isn't closed is left out."""
    raw = spark.read.format("binaryFile").load(files).select("path", _decoded(F.col("content"), "utf8").alias("t"))
    inside = F.regexp_extract_all("t", F.lit("(?s)<text(?:\\s[^>]*)?>(.*?)</text>"), F.lit(1))
    rows = raw.select("path", F.posexplode(inside).alias("at", "body"))
    cut = F.filter(F.split("body", "(?s)</?(?:sentence|s)(?:\\s[^>]*)?>"), lambda s: s.rlike("[^\\s]"))

    def word(line: Column) -> Column:
        cells = F.split(line, "\t", -1)
        return F.struct(*[F.get(cells, i).alias(f) for i, f in enumerate(fields)])

    sentences = F.transform(cut, lambda s: F.transform(F.filter(F.split(s, "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("<")), word))
    rows = rows.withColumn("sentences", F.filter(sentences, lambda s: F.size(s) > 0)).withColumn("doc_name", F.concat_ws("-", F.element_at(F.split("path", "/"), -1), "at"))
    ordered = number_in_files(rows)
    return ordered.select(F.lit("corpus").alias("archive"), "doc_name", "doc_ord", "sentences", no_error().alias("error"))


def table_columns(df: DataFrame, columns: list[str], *, order: str, name: str | None = None) -> dict[str, DataFrame]:
    """A text corpus for each column of a table, aligned by name (order's value, or a name column)."""
    return {c: from_table(df, order=order, payload={"text": F.col(c).cast("string")}, name=name) for c in columns}


def labelled_table(docs: DataFrame, labels: DataFrame, *, on: str, text: str = "text", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Aligned text and label corpora of the rows that two tables share."""
    both = docs.select(on, F.col(text).alias("text")).join(labels.select(on, F.col(label).cast("string").alias("label")), on)
    return from_table(both, order=on, payload={"text": "text"}), from_table(both, order=on, payload={"label": "label"})


def load(spark: SparkSession, path: str) -> DataFrame:
    """A stored corpus or dataset."""
    return spark.read.parquet(path)


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """at (from 0, in file order), value. Spark splits a file in order; the splits' numbers of lines are added up, and
    lines stay in the tasks that read them."""
    lines = spark.read.text(path).withColumn("_m", F.monotonically_increasing_id())
    sizes = lines.groupBy(F.shiftright("_m", 33).alias("_split")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    offsets = sizes.select("_split", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    placed = lines.withColumn("_split", F.shiftright("_m", 33)).join(F.broadcast(offsets), "_split")
    return placed.select((F.col("_offset") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).alias("at"), "value")


def _vector_rows(lines: DataFrame, limit: int | None, skip: int) -> DataFrame:
    rows = lines.where(F.col("at") >= skip)
    if limit is not None:
        rows = rows.where(F.col("at") < skip + limit)
    cells = F.split(F.rtrim(F.col("value")), " ")
    return rows.select((F.col("at") - skip).alias("idx"), F.get(cells, 0).alias("word"), F.transform(F.slice(cells, 2, F.size(cells)), lambda x: x.cast("float")).alias("vector"))


def glove_text(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """idx, word, count, vector of a file of words and numbers without header."""
    rows = _vector_rows(_numbered_lines(spark, path), limit, 0)
    return _ranked(rows)


def fasttext_vec(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """As glove_text(), after a header line 'words dimensions'; counts fall from the number of rows so that they keep
    the order."""
    if path.endswith(".zip"):
        raise ValueError("unpack .zip files first: only .vec files can be read")
    return _ranked(_vector_rows(_numbered_lines(spark, path), limit, 1))


def _ranked(rows: DataFrame) -> DataFrame:
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    return rows.crossJoin(F.broadcast(n)).select("idx", "word", (F.col("_n") - 1 - F.col("idx")).alias("count"), "vector")  # one row


def word2vec(spark: SparkSession, path: str, *, binary: bool = True, limit: int | None = None) -> DataFrame:
    """idx, word, count, vector of a word2vec file, with counts from path.vocab if it exists; <space> and <nbspace>
    in words are read back."""
    if not binary:
        rows = _vector_rows(_numbered_lines(spark, path), limit, 1)
    else:
        raw = spark.read.format("binaryFile").load(path).select("content")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for content in batch["content"]:
                    end = content.index(b"\n")
                    n, dim = map(int, content[:end].split())
                    at, rows = end + 1, []
                    for i in range(min(n, limit) if limit is not None else n):
                        stop = content.index(b" ", at)
                        word = content[at:stop].lstrip(b"\n").decode("utf8")
                        at = stop + 1 + 4 * dim
                        rows.append((i, word, np.frombuffer(content, "<f4", dim, stop + 1).tolist()))
                        if len(rows) == 5000:
                            yield pd.DataFrame(rows, columns=["idx", "word", "vector"])
                            rows = []
                    yield pd.DataFrame(rows, columns=["idx", "word", "vector"])

        rows = raw.mapInPandas(run, "idx bigint, word string, vector array<float>")
    try:
        vocab = _numbered_lines(spark, f"{path}.vocab")
    except Exception:
        out = _ranked(rows)
    else:
        cells = F.split("value", " ")
        out = rows.join(vocab.select(F.get(cells, 0).alias("word"), F.get(cells, 1).cast("bigint").alias("count")), "word", "left").select("idx", "word", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"), "vector")
    return out.withColumn("word", F.replace(F.replace("word", F.lit("<space>"), F.lit(" ")), F.lit("<nbspace>"), F.lit(" ")))


def _archive_entries(content: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, data) of an archive of documents: before each block of JSON metadata and of data stands its length,
    seven bits a byte, low bits first."""
    at = 0

    def block() -> bytes:
        nonlocal at
        size = shift = 0
        while True:
            b = content[at]
            at += 1
            size |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                break
        at += size
        return content[at - size : at]

    while at < len(content):
        yield json.loads(block())["name"], block()


def document_archives(spark: SparkSession, files: list[str], payload: str = "text") -> DataFrame:
    """A corpus of stored document archives (.prc), in the order of their paths: archive is a file's name, payload the
    document's UTF-8 text."""
    raw = spark.read.format("binaryFile").load(files).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(path, i, name, data.decode("utf8")) for i, (name, data) in enumerate(_archive_entries(content))]
                yield pd.DataFrame(rows, columns=["path", "at", "doc_name", "body"])

    ship(spark)
    found = raw.mapInPandas(run, "path string, at bigint, doc_name string, body string")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", "")
    ordered = number_in_files(found).withColumn("archive", name)
    return ordered.select("archive", "doc_name", "doc_ord", F.col("body").alias(payload), no_error().alias("error"))


def custom(spark: SparkSession, keys: list[str], read: Callable[[str], Iterator[tuple[str, dict]]], payload: str) -> DataFrame:
    """A corpus from a reader of one's own: read(key) gives (document name, payload columns) in order; the keys (files,
    shards, queries) are read side by side, each becoming an archive. payload is a DDL string."""
    schema = f"archive string, at bigint, doc_name string, {payload}"
    columns = [f.name for f in spark.createDataFrame([], schema).schema][3:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key in batch["key"]:
                rows = [{"archive": key, "at": i, "doc_name": name} | {c: doc.get(c) for c in columns} for i, (name, doc) in enumerate(read(key))]
                yield pd.DataFrame(rows, columns=["archive", "at", "doc_name", *columns])

    ship(spark)
    found = spark.createDataFrame([(k,) for k in keys], "key string").repartition(max(1, len(keys))).mapInPandas(run, schema)
    place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("archive")) if keys else F.lit(0)
    return found.withColumn("doc_ord", (place - 1) * F.lit(1 << 40) + F.col("at")).select("archive", "doc_name", "doc_ord", *columns, no_error().alias("error"))
