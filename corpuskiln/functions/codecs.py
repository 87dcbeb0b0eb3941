"""Raw (stored) forms of document types and their columns, both ways."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import join_sentences, no_lines, split_lines

#: Fixed marks of the stored form of word annotations.
SENTENCE_MARK, NULL_MARK, NEWLINE_MARK, TAB_MARK, SLASH_MARK = "<SENT>", "<NONE>", "<LINEBREAK>", "<TAB>", "@slash@"
#: struct codes of integer widths, (bytes, signed).
INT_CODES = {(1, True): "b", (1, False): "B", (2, True): "h", (2, False): "H", (4, True): "i", (4, False): "I", (8, True): "q", (8, False): "Q"}


def encode_tokenized(sentences: Column) -> Column:
    return join_sentences(sentences)


def decode_tokenized(raw: Column) -> Column:
    return F.transform(split_lines(raw), lambda x: F.filter(F.split(x, " "), lambda w: w != ""))


def encode_segmented(sentences: Column) -> Column:
    return join_sentences(F.transform(sentences, lambda s: F.transform(s, lambda w: F.replace(w, F.lit("/"), F.lit(SLASH_MARK)))), "/")


def decode_segmented(raw: Column) -> Column:
    return F.transform(split_lines(raw), lambda x: F.when(x == "", no_lines()).otherwise(F.transform(F.split(x, "/", -1), lambda w: F.replace(w, F.lit(SLASH_MARK), F.lit("/")))))


def encode_annotations(sentences: Column, fields: list[str]) -> Column:
    """One word a line, fields between tabs, a mark between sentences."""

    def word(w: Column) -> Column:
        cells = [F.coalesce(F.replace(F.replace(w[f], F.lit("\n"), F.lit(NEWLINE_MARK)), F.lit("\t"), F.lit(TAB_MARK)), F.lit(NULL_MARK)) for f in fields]
        return F.concat_ws("\t", *cells)

    return F.array_join(F.transform(sentences, lambda s: F.array_join(F.transform(s, word), "\n")), f"\n{SENTENCE_MARK}\n")


def decode_annotations(raw: Column, fields: list[str]) -> Column:
    def cell(x: Column) -> Column:
        return F.when(x == NULL_MARK, None).otherwise(F.replace(F.replace(x, F.lit(NEWLINE_MARK), F.lit("\n")), F.lit(TAB_MARK), F.lit("\t")))

    def word(line: Column) -> Column:
        cells = F.split(line, "\t", -1)
        return F.struct(*[cell(F.get(cells, i)).alias(f) for i, f in enumerate(fields)])

    sentences = F.split(raw, f"\n{SENTENCE_MARK}\n", -1)
    return F.when(raw == "", F.slice(F.transform(F.array(raw), lambda x: F.array(word(x))), 1, 0)).otherwise(F.transform(sentences, lambda s: F.transform(F.filter(F.split(s, "\n"), lambda x: x != ""), word)))


#: Columns of the tab-separated form of dependency parses.
CONLL_FIELDS = ["id", "word", "lemma", "cpos", "pos", "feats", "head", "deprel", "phead", "pdeprel"]


def encode_conll(sentences: Column, fields: list[str]) -> Column:
    """A word a line, an empty line after each sentence; fields that the words lack are _."""

    def word(w: Column, i: Column) -> Column:
        cells = [(i + 1).cast("string") if f == "id" else F.coalesce(w[f], F.lit("_")) if f in fields else F.lit("_") for f in CONLL_FIELDS]
        return F.concat_ws("\t", *cells)

    return F.array_join(F.transform(sentences, lambda s: F.concat(F.array_join(F.transform(s, word), "\n"), F.lit("\n"))), "\n")


def decode_conll(raw: Column, fields: list[str]) -> Column:
    """Sentences of words with the wanted fields; _ is null."""
    at = [CONLL_FIELDS.index(f) for f in fields]

    def word(line: Column) -> Column:
        cells = F.split(line, "\t", -1)
        return F.struct(*[F.nullif(F.get(cells, i), F.lit("_")).alias(f) for i, f in zip(at, fields, strict=True)])

    parts = F.filter(F.split(raw, "\n\\s*\n"), lambda s: F.trim(s) != "")
    return F.transform(parts, lambda s: F.transform(F.filter(F.split(s, "\n"), lambda x: F.trim(x) != ""), word))


def encode_trees(trees: Column) -> Column:
    return F.array_join(trees, "\n\n")


def decode_trees(raw: Column) -> Column:
    return F.when(raw == "", no_lines()).otherwise(F.split(raw, "\n\n", -1))


def pack_lists(rows: list[list[int]], width: int = 8, signed: bool = False, length_bytes: int = 2) -> bytes:
    """Ragged integer lists: each with its length before it."""
    code, size = INT_CODES[(width, signed)], INT_CODES[(length_bytes, False)]
    return b"".join(struct.pack(f"<{size}{len(r)}{code}", len(r), *r) for r in rows)


def unpack_lists(raw: bytes, width: int = 8, signed: bool = False, length_bytes: int = 2) -> list[list[int]]:
    code, size, out, at = INT_CODES[(width, signed)], INT_CODES[(length_bytes, False)], [], 0
    while at < len(raw):
        (n,) = struct.unpack_from(f"<{size}", raw, at)
        at += length_bytes
        out.append(list(struct.unpack_from(f"<{n}{code}", raw, at)))
        at += n * width
    return out


def pack_table(rows: list[list[int]], row_length: int, width: int = 8, signed: bool = False) -> bytes:
    """Integer rows of one fixed length."""
    if any(len(r) != row_length for r in rows):
        raise ValueError(f"rows must have {row_length} values")
    return struct.pack(f"<{sum(map(len, rows))}{INT_CODES[(width, signed)]}", *[x for r in rows for x in r])


def unpack_table(raw: bytes, row_length: int, width: int = 8, signed: bool = False) -> list[list[int]]:
    flat = struct.unpack(f"<{len(raw) // width}{INT_CODES[(width, signed)]}", raw)
    return [list(flat[i : i + row_length]) for i in range(0, len(flat), row_length)]


def pack_floats(values: list[float]) -> bytes:
    return struct.pack(f"<{len(values)}d", *values)


def unpack_floats(raw: bytes) -> list[float]:
    return list(struct.unpack(f"<{len(raw) // 8}d", raw))


def int_lists_codec(width: int = 8, signed: bool = False, length_bytes: int = 2):
    """(encode, decode): Arrow-batched functions between binary and array<array<bigint>>."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield x.map(lambda v: None if v is None else pack_lists([list(map(int, r)) for r in v], width, signed, length_bytes))

    @F.pandas_udf("array<array<bigint>>")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield x.map(lambda v: None if v is None else unpack_lists(bytes(v), width, signed, length_bytes))

    return encode, decode
