"""Vocabularies: building, counting, mapping tokens to ids and back, bags of words, tf-idf.

A vocabulary is a DataFrame (id int, token string, df bigint).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import number_rows
from ..scratch import commit_file, open_file, scratch_path, write_table
from ..workers import map_arrow
from . import lookup

#: Ids of a file of inverse document frequencies.
IDF_ROWS = 1_000_000
#: Up to this many rows may be put in order by one task.
ONE_TASK = 1_000_000


@dataclass
class Vocab:
    """words: (id, token, df); stopwords: (token); stats: one row (num_docs, num_pos, num_nnz)."""

    words: DataFrame
    stopwords: DataFrame
    stats: DataFrame


def token_rows(corpus: DataFrame, column: str = "sentences") -> DataFrame:
    """doc_ord, pos, token of every token of every valid document."""
    return corpus.where("error is null").select("doc_ord", F.posexplode(F.flatten(F.col(column))).alias("pos", "token"))


def _counted(corpus: DataFrame, column: str) -> DataFrame:
    """token, df, n, doc_ord, pos: for each batch of valid documents its tokens, the documents and places that have
    them, and the first place. A document is one row, so only a batch's different tokens are ever moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(1)
            sentences = docs.flatten()
            tokens = sentences.flatten()
            outer = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(docs), 0).to_numpy(zero_copy_only=False))))
            inner = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(sentences), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            ends = inner[outer]  # tokens before each document
            coded = tokens.dictionary_encode()
            valid = coded.indices.is_valid().to_numpy(zero_copy_only=False)
            word = coded.indices.fill_null(0).to_numpy()[valid].astype(np.int64)
            if not len(word):
                continue
            place = np.flatnonzero(valid)
            doc = np.searchsorted(ends, place, "right") - 1
            cell, first = np.unique(word * (len(ends)) + doc, return_index=True)
            df = np.bincount(cell // len(ends), minlength=len(coded.dictionary))
            n = np.bincount(word, minlength=len(coded.dictionary))
            ids = batch.column(0).to_numpy()
            at = first[np.lexsort((place[first] - ends[doc[first]], ids[doc[first]], word[first]))]
            at = at[np.concatenate(([True], np.diff(word[at]) != 0))]  # of each word, in its order
            some = word[at]
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(some)), pa.array(df[some]), pa.array(n[some]), pa.array(ids[doc[at]]), pa.array((place[at] - ends[doc[at]]).astype(np.int64))], ["token", "df", "n", "doc_ord", "pos"])

    rows = corpus.where("error is null").select(F.col("doc_ord").cast("bigint").alias("doc_ord"), F.col(column).alias("s"))
    return map_arrow(rows, run, "token string, df bigint, n bigint, doc_ord bigint, pos bigint")


def build(
    corpus: DataFrame, *, threshold: int = 0, max_prop: float = 1.0, limit: int | None = None, include: list[str] | None = None, oov: str | None = None, stopwords: DataFrame | None = None, column: str = "sentences"
) -> Vocab:
    """The vocabulary of a tokenised corpus.

    Ids follow first occurrence. Kept are tokens in threshold to max_prop * documents documents, of these the limit
    most frequent (ties: earlier first). Tokens above max_prop join the stopwords. include adds missing terms at the
    end with df 0, unless they are stopwords; oov adds a term whose df is the number of documents with a token
    outside. Counts are exact: nothing is pruned while counting.
    """
    n_docs = corpus.where("error is null").agg(F.count(F.lit(1)).alias("n"))
    words = _counted(corpus, column).groupBy("token").agg(F.sum("df").alias("df"), F.min(F.struct("doc_ord", "pos")).alias("first"), F.sum("n").alias("_n"))
    given = (stopwords.select("token") if stopwords is not None else words.select("token").limit(0)).distinct()
    if stopwords is not None:
        words = words.join(given, "token", "left_anti")
    stats = words.agg(F.sum("_n").alias("num_pos"), F.sum("df").alias("num_nnz")).crossJoin(n_docs.withColumnRenamed("n", "num_docs")).select("num_docs", F.coalesce("num_pos", F.lit(0)).alias("num_pos"), F.coalesce("num_nnz", F.lit(0)).alias("num_nnz"))
    most = F.floor(F.col("n") * F.lit(float(max_prop)))
    judged = words.crossJoin(F.broadcast(n_docs)).withColumn("_most", most)  # one row
    frequent = judged.where("df > _most").select("token")
    kept = judged.where((F.col("df") >= threshold) & (F.col("df") <= F.col("_most"))).select("token", "df", "first")
    if limit is not None:
        kept = kept.orderBy(F.col("df").desc(), "first").limit(limit)
    if limit is not None and limit <= ONE_TASK:
        out = kept.select((F.row_number().over(Window.orderBy("first")) - 1).alias("id"), "token", "df")
    else:
        out = number_rows(kept, F.col("first"), name="id").select("id", "token", "df")
    stop = given.unionByName(frequent).distinct()
    if include:
        spark = corpus.sparkSession
        wanted = spark.createDataFrame([(t, i) for i, t in enumerate(dict.fromkeys(include))], "token string, _at int")
        new = wanted.join(out, "token", "left_anti").join(stop, "token", "left_anti")
        new = new.select((F.row_number().over(Window.orderBy("_at")) - 1).alias("_k"), "token")
        size = out.agg(F.count(F.lit(1)).alias("_size"))
        out = out.unionByName(new.crossJoin(size).select((F.col("_size") + F.col("_k")).cast("int").alias("id"), "token", F.lit(0).cast("bigint").alias("df")))
    if oov is not None:
        out = out.unionByName(oov_entry(corpus, out, oov, column))
    return Vocab(out.select(F.col("id").cast("int").alias("id"), "token", "df"), stop, stats)


def word_counts(corpus: DataFrame, column: str = "sentences") -> DataFrame:
    """token, n: how often each token stands in the valid documents."""
    return _counted(corpus, column).groupBy("token").agg(F.sum("n").alias("n"))


def number_words(counts: DataFrame, limit: int | None = None) -> DataFrame:
    """id, token, n: words by falling count (ties: by token), of these the limit first."""
    if limit is not None:
        counts = counts.orderBy(F.desc("n"), "token").limit(limit)
    return write_table(number_rows(counts, -F.col("n"), "token", name="id").select("id", "token", "n"), "words")


def oov_entry(corpus: DataFrame, words: DataFrame, oov: str, column: str = "sentences") -> DataFrame:
    """The row of the out-of-vocabulary term: next id; df: documents with a token outside words."""
    outside = token_rows(corpus, column).select("doc_ord", "token").join(words.select("token"), "token", "left_anti")
    df = outside.agg(F.countDistinct("doc_ord").alias("df"))
    size = words.agg(F.count(F.lit(1)).alias("_size"))
    return df.crossJoin(size).select(F.col("_size").cast("int").alias("id"), F.lit(oov).alias("token"), "df")


def build_dual(terms: DataFrame, *, term: dict, feature: dict) -> tuple[Vocab, Vocab]:
    """Vocabularies of the terms and of the features (with count above 0) of (doc_ord, term, features map)."""
    as_corpus = lambda c: terms.select("doc_ord", F.array(c).alias("sentences"), F.lit(None).cast("string").alias("error"))
    features = F.map_keys(F.map_filter("features", lambda k, v: v > 0))
    return build(as_corpus(F.array("term")), **term), build(as_corpus(features), **feature)


def count(ids: DataFrame, words: DataFrame, *, oov_excluded: bool = False, column: str = "lists") -> DataFrame:
    """id, freq for every id of the vocabulary (and one more if oov_excluded): 0 where it doesn't occur."""
    seen = ids.where("error is null").select(F.explode(F.flatten(F.col(column))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("freq"))
    every = words.select(F.col("id").cast("bigint").alias("id"))
    if oov_excluded:
        every = every.unionByName(words.agg(F.count(F.lit(1)).alias("id")))
    return every.join(seen, "id", "left").select("id", F.coalesce("freq", F.lit(0)).alias("freq"))


def _lookup(corpus: DataFrame, table: DataFrame, key: str, value: str, column: str, out: str, missing: object, drop_empty: bool, fail: str | None) -> DataFrame:
    """Replaces each element of nested arrays by table's value for it. missing None drops the elements without one;
    fail makes documents with such an element invalid. A null payload stays null, a null array in it too (unless empty
    ones are dropped); a null element has no value.

    The table lies in sorted files that tasks map, whatever its size; each batch's different elements are looked up.
    """
    found = lookup.write(table, key, value)
    drop = fail is None and missing is None
    fill = missing if fail is None else None
    kind = table.schema[value].dataType.simpleString()
    at = corpus.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(at)
            sentences = docs.values
            got = found.find(sentences.values)
            outer = docs.offsets.to_numpy()
            inner = sentences.offsets.to_numpy() if len(sentences) else np.zeros(1, np.int32)  # no offsets may be written for none
            lost = sentences.is_null().to_numpy(zero_copy_only=False)
            if drop:
                keep = got.is_valid().to_numpy(zero_copy_only=False)
                got, inner = got.filter(pa.array(keep)), np.concatenate(([0], np.cumsum(keep)))[inner]
            elif fill is not None:
                got = got.fill_null(pa.scalar(fill, got.type))
            if drop_empty:
                full = np.diff(inner) > 0
                outer, inner, lost = np.concatenate(([0], np.cumsum(full)))[outer], np.concatenate((inner[:1], inner[1:][full])), lost[full]
            nested = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), got, mask=pa.array(lost) if lost.any() else None)
            whole = pa.ListArray.from_arrays(pa.array(outer, pa.int32()), nested, mask=docs.is_null())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if i != at), whole], [*(c for i, c in enumerate(batch.schema.names) if i != at), "_got"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in corpus.schema if f.name != column]
    rows = map_arrow(corpus, run, ", ".join([*fields, f"_got array<array<{kind}>>"]))
    rows = rows.withColumn("_got", F.when(F.col("error").isNull(), F.col("_got")))  # invalid documents have no payload
    if fail is not None:
        lost = F.exists("_got", lambda s: F.exists(s, lambda w: w.isNull()))
        bad = F.struct(F.lit(fail).alias("module_name"), F.lit("id outside the vocabulary").alias("error_info"))
        rows = rows.withColumn("error", F.when(F.col("error").isNull() & lost, bad).otherwise(F.col("error"))).withColumn("_got", F.when(F.col("error").isNull(), F.col("_got")))
    others = [c for c in corpus.columns if c != column]
    return rows.select(*[c for c in others if c != "error"], F.col("_got").alias(out), "error")


def map_tokens(corpus: DataFrame, words: DataFrame, oov: str | None = None, *, column: str = "sentences") -> DataFrame:
    """Tokens to ids. Unknown tokens get the id after the last; oov='skip' drops them and then empty sentences; any
    other oov is a token of the vocabulary that stands for them."""
    table = words.select("token", F.col("id").cast("bigint").alias("id"))
    if oov == "skip":
        return _lookup(corpus, table, "token", "id", column, "lists", None, True, None)
    if oov is None:
        unknown = words.count()
    else:
        row = words.where(F.col("token") == oov).select("id").first()
        if row is None:
            raise ValueError(f"the vocabulary has no token {oov}")
        unknown = row[0]
    return _lookup(corpus, table, "token", "id", column, "lists", unknown, False, None)


def unmap_ids(corpus: DataFrame, words: DataFrame, oov: str | None = None, *, column: str = "lists") -> DataFrame:
    """Ids to tokens. oov is the token for unknown ids, or 'skip' to drop them; without it documents that have one
    become invalid."""
    table = words.select(F.col("id").cast("bigint").alias("id"), "token")
    if oov is None:
        return _lookup(corpus, table, "id", "token", column, "sentences", None, False, "vocab_unmapper")
    return _lookup(corpus, table, "id", "token", column, "sentences", None if oov == "skip" else oov, oov == "skip", None)


def bags(corpus: DataFrame, column: str = "lists") -> DataFrame:
    """doc_ord, items, counts: the different elements of each valid document's nested arrays, and how often each stands
    there. A document is a row, so it is counted within its row; nulls are left out."""
    kind = corpus.schema[column].dataType.elementType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(1)
            sentences = docs.flatten()
            outer = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(docs), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            inner = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(sentences), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            coded = sentences.flatten().dictionary_encode()
            there = np.flatnonzero(coded.indices.is_valid().to_numpy(zero_copy_only=False))
            item = coded.indices.fill_null(0).to_numpy()[there].astype(np.int64)
            doc = np.searchsorted(inner[outer], there, "right") - 1
            cells, counts = np.unique(doc * max(len(coded.dictionary), 1) + item, return_counts=True)
            doc, item = np.divmod(cells, max(len(coded.dictionary), 1))
            offsets = pa.array(np.searchsorted(doc, np.arange(len(batch) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(item))), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64)))],
                ["doc_ord", "items", "counts"],
            )

    rows = corpus.where("error is null").select(F.col("doc_ord").cast("bigint").alias("doc_ord"), F.col(column).alias("s"))
    return map_arrow(rows, run, f"doc_ord bigint, items array<{kind}>, counts array<bigint>")


def _bag_rows(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("doc_ord", F.explode(F.arrays_zip("items", "counts")).alias("x")).select("doc_ord", F.col("x.items").alias(name), F.col("x.counts").alias("freq"))


def bag_of_words(ids: DataFrame, ignore_ids: list[int] | None = None, *, column: str = "lists") -> DataFrame:
    """doc_ord, id, freq of each id in each valid document. Nothing is shuffled."""
    rows = _bag_rows(bags(ids, column), "id")
    return rows.where(~F.col("id").isin(ignore_ids)) if ignore_ids else rows


def tfidf(bow: DataFrame, n_docs: int, key: str = "id") -> DataFrame:
    """doc_ord, key, w: freq * log2(documents / df), scaled to length 1 for each document."""
    df = bow.groupBy(key).agg(F.count(F.lit(1)).alias("_df"))
    raw = bow.join(df, key).withColumn("_w", F.col("freq") * F.log2(F.lit(float(n_docs)) / F.col("_df")))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("doc_ord")))
    return raw.select("doc_ord", key, F.when(norm > 0, F.col("_w") / norm).otherwise(F.lit(0.0)).alias("w"))


def tfidf_bags(ids: DataFrame, ignore_ids: list[int] | None = None, *, column: str = "lists") -> DataFrame:
    """doc_ord, items, weights: as tfidf, for ids of a vocabulary, each document staying one row.

    Documents are counted for each id first; the logarithms then lie in one file of 8 bytes an id in the shared folder,
    which tasks map, so that no word of a document is ever moved.
    """
    spark = ids.sparkSession
    rows = bags(ids, column)
    if ignore_ids:
        keep = lambda x: ~x["items"].isin(ignore_ids)
        kept = F.filter(F.arrays_zip("items", "counts"), keep)
        rows = rows.select("doc_ord", F.transform(kept, lambda x: x["items"]).alias("items"), F.transform(kept, lambda x: x["counts"]).alias("counts"))
    rows = write_table(rows, "bags")
    df = write_table(rows.select(F.explode("items").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df")), "document-frequencies")
    n_docs, size = rows.count(), (df.agg(F.max("id")).first()[0] or 0) + 1
    uri = scratch_path(spark, "idf")
    parts = max(1, -(-size // IDF_ROWS))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, values = -1, None
        for batch in batches:
            part = batch.column(0)[0].as_py()
            values = np.zeros(-(-size // parts)) if values is None else values
            values[batch.column(1).to_numpy() // parts] = np.log2(n_docs / batch.column(2).to_numpy())
        if values is not None:
            commit_file(f"{uri}/{part}", lambda f: f.write(values.tobytes()))
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32())})

    map_arrow(df.select((F.col("id") % parts).cast("int").alias("part"), "id", "df").repartitionById(parts, "part"), save, "part int").collect()  # one row a part

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[int, np.ndarray] = {}
        for batch in batches:
            items, counts = batch.column(1), batch.column(2)
            ids_, n = items.flatten().to_numpy(), counts.flatten().to_numpy()
            idf = np.zeros(len(ids_))
            for part in np.unique(ids_ % parts).tolist():
                if part not in files:
                    files[part] = np.frombuffer(open_file(f"{uri}/{part}").read_buffer(), np.float64)
                mine = ids_ % parts == part
                idf[mine] = files[part][ids_[mine] // parts]
            w = n * idf
            doc = np.repeat(np.arange(len(batch)), np.diff(items.offsets.to_numpy()))
            norm = np.sqrt(np.bincount(doc, w * w, len(batch)))[doc]
            w = np.divide(w, norm, out=np.zeros(len(w)), where=norm > 0)
            offsets = pa.array(items.offsets.to_numpy() - items.offsets[0].as_py(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids_)), pa.ListArray.from_arrays(offsets, pa.array(w))], ["doc_ord", "items", "weights"])

    return map_arrow(rows, weigh, "doc_ord bigint, items array<bigint>, weights array<double>")


def doc2bow(corpus: DataFrame, words: DataFrame, column: str = "sentences") -> tuple[DataFrame, DataFrame]:
    """Bags of a tokenised corpus: (doc_ord, id, freq) of known words and (doc_ord, token, freq) of the others."""
    counts = _bag_rows(bags(corpus, column), "token")
    both = counts.join(words.select("token", F.col("id").cast("bigint").alias("id")), "token", "left")
    return both.where("id is not null").select("doc_ord", "id", "freq"), both.where("id is null").select("doc_ord", "token", "freq")
