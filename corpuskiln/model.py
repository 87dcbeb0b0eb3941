"""The data model: corpora as DataFrames of documents, document types, invalid documents.

A corpus has archive, doc_name, doc_ord (its order, bigint), payload columns by document type, and error: null for a
valid document, else struct(module_name, error_info). Every "first" or "next" is written against doc_ord.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import write_table

ERROR_TYPE = "struct<module_name:string,error_info:string>"
KEYS = ["archive", "doc_name", "doc_ord"]


@dataclass(frozen=True)
class DocType:
    """A document type: its payload columns (name -> Spark type) and the type that it specialises."""

    name: str
    fields: tuple[tuple[str, str], ...]
    parent: str | None = None
    options: tuple[tuple[str, object], ...] = ()

    @property
    def columns(self) -> list[str]:
        return [n for n, _ in self.fields]


def annotations_type(fields: list[str], name: str = "word_annotations") -> DocType:
    """Sentences of words with named string fields. Repeated names are an error."""
    if len(set(fields)) != len(fields):
        raise ValueError(f"repeated annotation field in {fields}")
    inner = ",".join(f"`{f}`:string" for f in fields)
    return DocType(name, (("sentences", f"array<array<struct<{inner}>>>"),), "tokenized", (("fields", tuple(fields)),))


_INTS, _FLOATS = "array<array<bigint>>", "array<array<double>>"
#: Document types by the name that pipeline files use.
DOC_TYPES = {
    t.name: t
    for t in (
        DocType("invalid", ()),
        DocType("raw", (("raw", "binary"),)),
        DocType("text", (("text", "string"),), "raw"),
        DocType("raw_text", (("text", "string"),), "text"),
        DocType("tokenized", (("sentences", "array<array<string>>"),), "text"),
        DocType("lemmatized", (("sentences", "array<array<string>>"),), "tokenized"),
        DocType("char_tokenized", (("sentences", "array<array<string>>"),), "tokenized"),
        DocType("segmented_lines", (("sentences", "array<array<string>>"),), "tokenized"),
        annotations_type(["word"]),
        annotations_type(["word", "pos", "head", "deprel"], "dependency_parsed"),
        DocType("integer_lists", (("lists", _INTS),), "raw"),
        DocType("integer_list", (("list", "array<bigint>"),), "raw"),
        DocType("integer", (("value", "bigint"),), "raw"),
        DocType("integer_table", (("table", _INTS),), "raw"),
        DocType("float_lists", (("lists", _FLOATS),), "raw"),
        DocType("float_list", (("list", "array<double>"),), "raw"),
        DocType("vector", (("vector", "array<double>"),), "raw", (("dimensions", 10),)),
        DocType("label", (("label", "string"),), "raw"),
        DocType("json", (("data", "string"),), "raw"),
        DocType("tree_strings", (("trees", "array<string>"),), "raw"),
    )
}


_CODECS: dict[str, tuple[Callable[[Column], dict[str, Column]], Callable[[dict[str, Column]], Column]]] = {}


def register_type(name: str, fields: dict[str, str], *, decode: Callable[[Column], dict[str, Column]], encode: Callable[[dict[str, Column]], Column], parent: str = "raw") -> DocType:
    """A document type of one's own: its payload columns with their Spark types (VARIANT for JSON of any shape), and how
    they come from the stored text and go back to it, as expressions. Names are taken once."""
    if name in DOC_TYPES:
        raise ValueError(f"the type {name} is registered already")
    if parent not in DOC_TYPES:
        raise ValueError(f"no parent type {parent}")
    if not fields or {*fields} & {*KEYS, "error"}:
        raise ValueError("a payload column is needed, and none may be called like a corpus's own columns")
    DOC_TYPES[name] = DocType(name, tuple(fields.items()), parent)
    _CODECS[name] = decode, encode
    return DOC_TYPES[name]


def decode_documents(corpus: DataFrame, name: str, column: str = "raw") -> DataFrame:
    """The corpus with the payload of a registered type in place of its stored text; what gives no payload at all (all of
    its columns null) is invalid."""
    kind, made = DOC_TYPES[name], _CODECS[name][0](F.col(column))
    payload = {c: F.when(F.col("error").isNull(), made[c].cast(t) if t != "variant" else made[c]) for c, t in kind.fields}
    rows = corpus.select(*KEYS, *[x.alias(c) for c, x in payload.items()], "error")
    there = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in payload])
    lost = F.when(F.col("error").isNull() & ~there, error(name, "not of this type")).otherwise(F.col("error"))
    return rows.select(*KEYS, *payload, lost.alias("error"))


def encode_documents(corpus: DataFrame, name: str) -> DataFrame:
    """The corpus with the stored text (raw) of a registered type; null for invalid documents."""
    raw = _CODECS[name][1]({c: F.col(c) for c in DOC_TYPES[name].columns})
    return corpus.select(*KEYS, F.when(F.col("error").isNull(), raw).alias("raw"), "error")


def is_subtype(given: DocType, wanted: DocType) -> bool:
    """Whether given documents may stand where wanted ones are asked for. Word annotations need at least the wanted
    fields."""
    need = dict(wanted.options).get("fields")
    if need is not None:
        have = dict(given.options).get("fields")
        return have is not None and set(need) <= set(have)
    at: DocType | None = given
    while at is not None:
        if at.name == wanted.name:
            return True
        at = DOC_TYPES.get(at.parent) if at.parent else None
    return False


def common_type(types: list[DocType]) -> DocType:
    """The type of several corpora together: one of theirs that all others specialise. Raises TypeError if none is."""
    for t in types:
        if all(is_subtype(x, t) for x in types):
            return t
    raise TypeError(f"no common type of {', '.join(t.name for t in types)}")


def add_annotation_fields(given: DocType, new: list[str]) -> DocType:
    """The annotation type with new fields beside the given ones (of plain tokens: beside word)."""
    return annotations_type([*dict(given.options).get("fields", ("word",)), *new])


def no_error() -> Column:
    return F.lit(None).cast(ERROR_TYPE)


def error(module_name: str, info: Column | str) -> Column:
    """An invalid document's error value."""
    return F.struct(F.lit(module_name).alias("module_name"), (F.lit(info) if isinstance(info, str) else info).alias("error_info"))


def from_table(df: DataFrame, *, order: str, payload: dict[str, Column | str], name: Column | str | None = None, archive: Column | str | None = None) -> DataFrame:
    """A corpus from any table: order gives doc_ord (its values, which must be unique), name defaults to it."""
    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    name = F.col(order).cast("string") if name is None else as_col(name).cast("string")
    archive = F.lit("corpus") if archive is None else as_col(archive).cast("string")
    return df.select(archive.alias("archive"), name.alias("doc_name"), F.col(order).cast("bigint").alias("doc_ord"), *[as_col(c).alias(n) for n, c in payload.items()], no_error().alias("error"))


def valid(corpus: DataFrame) -> DataFrame:
    return corpus.where("error is null")


def payload_columns(corpus: DataFrame) -> list[str]:
    return [c for c in corpus.columns if c not in (*KEYS, "error")]


def check_unique(corpus: DataFrame) -> DataFrame:
    """The corpus, failing when read if a document name occurs twice in an archive."""
    n = F.count(F.lit(1)).over(Window.partitionBy("archive", "doc_name"))
    clash = F.assert_true(F.col("_n") == 1, F.concat(F.lit("repeated document "), F.col("archive"), F.lit("/"), F.col("doc_name")))
    return corpus.withColumn("_n", n).where(clash.isNull()).drop("_n")


def number_rows(df: DataFrame, key: Column, *ties: str, name: str = "pos", unique: tuple[str, ...] = ()) -> DataFrame:
    """Adds name: 0, 1, 2, ... in the order of key, then ties. Null keys come first.

    Rows are dealt to ranges of (key, ties), as many as there are shuffle partitions; each range is numbered by itself
    and moved by the sizes of those before it, so no task sees more than a range. The numbers are written before they
    are used, so that recomputed tasks number alike. Of rows that unique columns identify only these, key and ties are
    put in order, and the numbers are joined back; null values of these columns must not occur, and two rows that share
    their values are an error (ValueError), as they would be joined with each other's numbers.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select(*dict.fromkeys([*unique, *ties]), key.alias("_key")) if unique else df.withColumn("_key", key)
    order = [F.col("_key").asc_nulls_first(), *ties]
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = write_table(dealt.select(*unique, "_id") if unique else dealt.drop("_key"), "numbers")
    if unique and not placed.groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"rows repeat their {', '.join(unique)}")
    placed = placed.withColumn("_range", F.shiftright("_id", 33)).withColumn("_within", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    numbered = placed.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_offset") + F.col("_within"))  # one row a range
    numbered = numbered.drop("_id", "_range", "_within", "_offset")
    return df.join(numbered, list(unique)).select(*df.columns, name) if unique else numbered


def number_in_files(rows: DataFrame, at: str = "at") -> DataFrame:
    """Adds doc_ord to documents of files: by path, then place in the file (at: 0, 1, 2, ... in each). Only the files'
    numbers of documents are put in order, never the documents."""
    sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    offsets = sizes.select("path", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return rows.join(offsets, "path").withColumn("doc_ord", (F.col("_offset") + F.col(at)).cast("bigint")).drop("_offset")
