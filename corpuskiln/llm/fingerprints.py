"""Canonical exact digests of documents.

A text is normalised (NFKC), case-folded (and normalised again), its white space is folded to single spaces, and the
result is digested by the 128-bit XXH3. Rows with equal digests are compared byte by byte; should different texts
ever share a digest, all but one of them get a numbered fingerprint.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import binary_list, map_arrow, map_batches, write_table

#: Where null ids stand among the others; a flag tells them from this id itself.
_NULL_ID = -(1 << 63)


def canonical(text: str) -> bytes:
    """The canonical form: NFKC, case folding, NFKC again, white space runs as one space, trimmed; as UTF-8."""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(form: bytes, bits: int = 128) -> bytes:
    """The wide hash of a canonical form. Fewer bits are for tests of what happens when digests collide."""
    return (int.from_bytes(xxhash.xxh3_128_digest(form), "big") & ((1 << bits) - 1)).to_bytes(16, "big")


def _digests(docs: DataFrame, bits: int) -> DataFrame:
    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [digest(canonical(t or ""), bits) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "digest"])

        return one

    return map_batches(docs, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest binary")


def _shared_ids(docs: DataFrame, bits: int) -> DataFrame:
    """Ids of the rows whose digest another row has too."""
    found = write_table(_digests(docs, bits), "digests")
    many = write_table(found.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "digest-buckets")
    return found.join(many, "digest").select("doc_id")


def _named(rows: DataFrame) -> DataFrame:
    """rows (digest, form: the canonical bytes where the digest is shared) -> with fingerprint.

    Compares the bytes inside equal buckets by their least and greatest value, which needs no bucket in one place.
    """
    clash = rows.where("form is not null").groupBy("digest").agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a <> b").select("digest")
    clash = write_table(clash, "digest-clashes")
    plain = F.lower(F.hex("digest"))
    if clash.isEmpty():
        return rows.withColumn("fingerprint", plain)
    forms = rows.join(clash, "digest", "left_semi").select("digest", "form").distinct()
    number = forms.withColumn("_k", F.row_number().over(Window.partitionBy("digest").orderBy("form")) - 1)
    number = number.select(F.col("digest").alias("_d"), F.col("form").alias("_f"), "_k")
    joined = rows.join(number, (rows["digest"] == number["_d"]) & (rows["form"] == number["_f"]), "left")
    return joined.withColumn("fingerprint", F.when(F.coalesce("_k", F.lit(0)) > 0, F.concat(plain, F.lit("-"), F.col("_k").cast("string"))).otherwise(plain)).drop("_d", "_f", "_k")


def fingerprints(docs: DataFrame, *, bits: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of each row: equal exactly if the canonical forms are.

    Null texts count as empty. Null and repeated ids are fine, and so are other columns, which are ignored. Only the
    texts of shared digests are moved to be compared.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    shared = _shared_ids(texts, bits).distinct().withColumn("_shared", F.lit(True)).withColumnRenamed("doc_id", "_id")
    marked = texts.join(shared, texts["doc_id"].eqNullSafe(shared["_id"]), "left").select("doc_id", "text", "_shared")

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            form = [canonical(t or "") for t in batch.column(1).to_pylist()]
            kept = [f if s else None for f, s in zip(form, batch.column(2).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(f, bits) for f in form], pa.binary()), pa.array(kept, pa.binary())], ["doc_id", "digest", "form"])

        return one

    rows = write_table(map_batches(marked, make, f"doc_id {docs.schema[id_col].dataType.simpleString()}, digest binary, form binary"), "digest-forms")
    return _named(rows).select("doc_id", "fingerprint")


def duplicate_groups(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint, group_id (smallest id with the fingerprint), group_size. See fingerprints()."""
    rows = write_table(fingerprints(docs, **options), "fingerprints")
    groups = write_table(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("group_size")), "fingerprint-groups")
    return rows.join(groups, "fingerprint").select("doc_id", "fingerprint", "group_id", "group_size")


def edit_report(docs: DataFrame, *, bits: int = 128) -> DataFrame:
    """How the fingerprint of each document bears an edit and tells it from the next document.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many first ones (or all)
    of the next document's text, in ascending order of doc_id (bigint; null ids first; after the last the first; rows
    with one id in the order of their texts, null as empty). Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next: 1.0 if the canonical forms are equal, else 0.0. Null texts are empty.

    Documents are cut into ranges of ids; the first row of each range also goes to the range before it, so texts
    are moved once, compressed; only those of repeated ids go with their plain text, to be put in order. An edited
    text's fingerprint is its plain digest. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.coalesce(F.col("doc_id"), F.lit(_NULL_ID)).cast("long").alias("doc_id"), F.col("doc_id").isNotNull().cast("int").alias("has"), "text")
    again = write_table(given.groupBy("doc_id", "has").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "has", F.lit(True).alias("_again")), "repeated-ids")
    if again.isEmpty():
        texts = given.select("doc_id", "text", "has", F.lit(None).cast("string").alias("tie"))
    else:
        texts = given.join(again, ["doc_id", "has"], "left").select("doc_id", "text", "has", F.when(F.col("_again"), F.coalesce("text", F.lit(""))).alias("tie"))
    ids = texts.select("doc_id")
    cuts = np.unique(np.array(ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n), np.float64).astype(np.int64))

    def make_range():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, batch.column(0).to_numpy(), "right")), batch.column(0)], ["part", "doc_id"])

        return one

    ranged = map_batches(ids, make_range, "part bigint, doc_id bigint")
    firsts = sorted((r.part, r.id) for r in ranged.groupBy("part").agg(F.min("doc_id").alias("id")).collect())  # one row a range
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    out = "part bigint, doc_id bigint, kind int, body binary, has int, tie string"
    names = ["part", "doc_id", "kind", "body", "has", "tie"]

    def make_rows():
        pack = zstandard.ZstdCompressor(level=1).compress

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc = batch.column(0).to_numpy()
            body = [pack(t or b"") for t in binary_list(batch.column(1))]
            part = np.searchsorted(cuts, doc, "right")
            tail = [i for i, d in enumerate(doc.tolist()) if d in before]
            kind = np.concatenate((np.full(len(doc), 1), np.full(len(tail), 2))).astype(np.int32)
            rows = pa.array(np.concatenate((np.arange(len(doc)), tail)).astype(np.int64))
            parts = [pa.array(np.concatenate((part, [before[int(doc[i])] for i in tail])).astype(np.int64)), batch.column(0).take(rows), pa.array(kind), pa.array(body + [body[i] for i in tail], pa.binary())]
            return pa.RecordBatch.from_arrays([*parts, batch.column(2).take(rows), batch.column(3).take(rows)], names)

        return one

    def make_flags():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc = batch.column(0).to_numpy()
            k = len(doc)
            return pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, doc, "right")), batch.column(0), pa.array(np.zeros(k, np.int32)), pa.nulls(k, pa.binary()), pa.array(np.zeros(k, np.int32)), pa.nulls(k, pa.string())], names)

        return one

    rows = map_batches(texts, make_rows, out).unionByName(map_batches(_shared_ids(texts, bits), make_flags, out))
    # in a range: flags of shared digests before their documents (null ids before the least one), the next range's first
    # row last
    order = rows.withColumn("part", F.col("part").cast("int")).repartitionById(n, "part").sortWithinPartitions("part", F.col("kind") == 2, "doc_id", F.when(F.col("kind") > 0, F.col("has")), "tie", "kind")
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, digest binary, edited_digest binary, near_edited double, near_next double, form binary"

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(id, text, canonical form, shared, next text, next form)"""
        unpack = zstandard.ZstdDecompressor().decompress
        held, flagged, last = None, set(), None
        for batch in batches:
            for part, doc, kind, body, has in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if part != last:
                    held, flagged, last = None, set(), part
                if kind == 0:
                    flagged = {doc}
                    continue
                text = unpack(body).decode() if body else ""
                form = canonical(text)
                if held:
                    yield *held, text, form
                held = (doc if has else None, text, form, doc in flagged) if kind == 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        got: list[tuple] = []
        for doc, text, form, shared, nxt, nxt_form in pairs(batches):
            half = len(text) // 2
            edited = text[: len(text) - half] + nxt[:half]
            e_form = canonical(edited)
            got.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(form, bits), digest(e_form, bits), float(e_form == form), float(nxt_form == form), pack(form) if shared else None))
            if len(got) >= 1000:
                yield _batch(got)
                got = []
        if got:
            yield _batch(got)

    done = write_table(map_arrow(order, run, schema), "fingerprint-edits")
    return _named(done).select("doc_id", "n_chars", "edited_sha256", "fingerprint", F.lower(F.hex("edited_digest")).alias("edited_fingerprint"), "near_edited", "near_next")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.binary()]
    names = ["doc_id", "n_chars", "edited_sha256", "digest", "edited_digest", "near_edited", "near_next", "form"]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
