"""Ranked lexical search: a join of queries with an index, seeded by thresholds.

1. Index: a document is a row of its terms' hashes and frequencies, for the terms that queries ask for (of others only
   the document's length matters).
2. Each term's statistics are stored: documents, greatest impact, and the k-th greatest. The k-th impact of any of its
   terms is a score that k documents reach, so the best of them seeds a query's threshold.
3. A query's terms are ordered by greatest impact. Where the sum of the greatest impacts from some term on (the suffix
   bound) is below the threshold, documents that have only those terms can't be among the k best; the terms before are
   the ones that candidates come from.
4. The join goes over the index once: the terms before make candidates; those whose sum with the suffix bound stays below
   the threshold are dropped, the others are scored exactly. Each task raises the thresholds by what it has seen.
5. The k best of each query are merged from the tasks' best.

Impacts are whole numbers, so no order of summing changes a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workers import map_arrow
from ._common import binary_list, commit_file, drop, map_batches, open_file, pinned, scratch_path, store, write_table

#: Bytes that separate terms become spaces, A-Z become small; all else stays.
_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
#: Rows of (query, term) in a block that a task holds at a time: about 60 MB.
BLOCK_ROWS = 1 << 20
#: Terms in a block of the query vocabulary.
VOCABULARY_ROWS = 1 << 19
#: Cells of the matrix (document, query) and contributions that are added up at a time.
CELLS, CONTRIBUTIONS = 1 << 21, 1 << 21


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms: maximal runs of letters, digits and all characters beyond ASCII; only A-Z lower-cased. Null has none."""
    return text.translate(_FOLD).split() if text else []


def _hash(term: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(term, seed)


@dataclass
class Vocabulary:
    """The queries' terms as files sorted by hash, in the shared folder; hashes of different terms differ."""

    folder: str
    blocks: int
    seed: int


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term, n): how often each query has a term. Rows of one id are one query."""
    rows = pinned(queries, id_col, text_col).toDF("item", "text")
    kind = rows.schema["item"].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = [Counter(terms_of(t)) for t in binary_list(batch.column(1))]
            at = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array([t for c in counts for t in c], pa.binary()), pa.array([n for c in counts for n in c.values()], pa.int64())],
                ["item", "term", "n"],
            )

        return one

    return map_batches(rows, make, f"item {kind}, term binary, n bigint").groupBy("item", "term").agg(F.sum("n").alias("n"))


def _blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def write_vocabulary(terms: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """Writes the distinct terms of (item, term, n) as files of hashes; returns them with (item, hash, n).

    Should two terms share a hash, another seed is taken, so that a hash stands for one term.
    """
    spark = terms.sparkSession
    distinct = write_table(terms.select("term").distinct(), "search-terms")
    n = distinct.count()
    for seed in range(8):

        def make(seed: int = seed) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
            def one(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = [_hash(t, seed) for t in batch.column(0).to_pylist()]
                return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["term", "hash"])

            return one

        hashed = write_table(map_batches(distinct, make, "term binary, hash bigint"), "search-hashes")
        if hashed.select("hash").distinct().count() == n:
            break
    else:
        raise RuntimeError("no seed tells the terms apart")
    vocabulary = Vocabulary(scratch_path(spark, "search-vocabulary"), _blocks(n, VOCABULARY_ROWS), seed)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            block = whole.column(0)[0].as_py()
            _save(f"{vocabulary.folder}/block-{block:06d}", whole.select(["term", "hash"]))
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32())})

    dealt = hashed.select(F.pmod("hash", F.lit(vocabulary.blocks)).cast("int").alias("block"), "term", "hash")
    map_arrow(dealt.repartitionById(vocabulary.blocks, "block").sortWithinPartitions("hash"), save, "block int").collect()  # one row a block
    return vocabulary, terms.join(hashed, "term").select("item", "hash", "n")


def _save(uri: str, table: pa.Table) -> None:
    def write(sink) -> None:
        with pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table)

    commit_file(uri, write)


def _load(uri: str) -> pa.Table | None:
    """A block, or none if nothing fell into it."""
    try:
        with open_file(uri) as f:
            return pa.ipc.open_file(f).read_all().combine_chunks()
    except FileNotFoundError:
        return None


def build_index(docs: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tf): each document with at least one term, its number of terms with repeats, and the hashes and
    frequencies of those that the vocabulary has. One row a document; nothing is shuffled."""
    rows = pinned(docs, id_col, text_col).toDF("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch | None]:
        def load(b: int) -> tuple[np.ndarray, pa.Array] | None:
            t = _load(f"{vocabulary.folder}/block-{b:06d}")
            return None if t is None else (t["hash"].to_numpy(), t["term"])

        only = [load(0)] if vocabulary.blocks == 1 else None

        def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            counts = [Counter(terms_of(t)) for t in binary_list(batch.column(1))]
            size = np.array([c.total() for c in counts], np.int64)
            at = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            number: dict[bytes, int] = {}
            which = np.fromiter((number.setdefault(t, len(number)) for c in counts for t in c), np.int64, len(at))
            tf = np.fromiter((n for c in counts for n in c.values()), np.int64, len(at))
            terms = list(number)
            hashes = np.fromiter((_hash(t, vocabulary.seed) for t in terms), np.uint64, len(terms)).view(np.int64)
            known = np.zeros(len(terms), bool)
            for b in range(vocabulary.blocks):
                block = only[0] if only else load(b)
                if block is None or not len(terms):
                    continue
                place = np.minimum(np.searchsorted(block[0], hashes), len(block[0]) - 1)
                maybe = np.flatnonzero(block[0][place] == hashes)
                same = [terms[i] == t for i, t in zip(maybe, block[1].take(pa.array(place[maybe])).to_pylist(), strict=True)]
                known[maybe[np.array(same, bool)]] = True
            keep = known[which]
            at, which, tf = at[keep], which[keep], tf[keep]
            offsets = pa.array(np.searchsorted(at, np.arange(len(counts) + 1)), pa.int32())
            some = pa.array(size > 0)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.ListArray.from_arrays(offsets, pa.array(hashes[which])), pa.ListArray.from_arrays(offsets, pa.array(tf))],
                ["doc_id", "n", "terms", "tf"],
            ).filter(some)

        return one

    return map_batches(rows, make, f"doc_id {kind}, n bigint, terms array<bigint>, tf array<bigint>")


def _quotient(tf: Column, n: Column, total_docs: int, total_terms: int) -> Column:
    """An impact without its term's weight."""
    m = F.lit(25).cast("long") + F.call_function("div", F.lit(75).cast("long") * n * F.lit(total_docs).cast("long"), F.lit(max(total_terms, 1)).cast("long"))
    return F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, F.lit(1000).cast("long") * tf + F.lit(8).cast("long") * m)


def term_statistics(index: DataFrame, k: int, total_docs: int, total_terms: int) -> DataFrame:
    """(hash, df, w, best, kth) of each term that a document has; kth is 0 where fewer than k documents have it.

    Counts are summed before they are shuffled; of each term every task passes on its k greatest quotients only.
    """
    each = index.select("n", F.explode(F.arrays_zip("terms", "tf")).alias("p")).select(F.col("p.terms").alias("hash"), _quotient(F.col("p.tf"), F.col("n"), total_docs, total_terms).alias("q"))
    counts = each.groupBy("hash").agg(F.count("*").alias("df"), F.max("q").alias("q1"))
    top = each.withColumn("r", F.row_number().over(Window.partitionBy("hash").orderBy(F.desc("q")))).where(F.col("r") <= k)
    kth = top.groupBy("hash").agg(F.count("*").alias("held"), F.min("q").alias("qk"))
    w = F.floor(1000 * F.log((F.lit(2 * total_docs + 2)).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    both = counts.join(kth, "hash").withColumn("w", w)
    return both.select("hash", "df", "w", (F.col("w") * F.col("q1")).alias("best"), F.when(F.col("held") >= k, F.col("w") * F.col("qk")).otherwise(F.lit(0)).alias("kth"))


def query_bounds(terms: DataFrame, statistics: DataFrame) -> DataFrame:
    """(item, hash, weight, essential, threshold, rest) from (item, hash, n): weight = n * w; threshold: the greatest k-th
    impact of the query's terms, 1 at least; essential: the term's suffix bound reaches it; rest: the greatest sum of
    impacts that the other terms can add. Terms that no document has, or that weigh nothing, are left out."""
    found = terms.join(statistics, "hash").where("w > 0").withColumn("most", F.col("n") * F.col("best"))
    mine = Window.partitionBy("item")
    suffix = mine.orderBy(F.desc("most"), "hash").rowsBetween(0, Window.unboundedFollowing)
    found = found.withColumn("threshold", F.greatest(F.max(F.col("n") * F.col("kth")).over(mine), F.lit(1))).withColumn("suffix", F.sum("most").over(suffix))
    essential = F.col("suffix") >= F.col("threshold")
    rest = F.sum(F.when(~essential, F.col("most")).otherwise(F.lit(0))).over(mine)
    return found.select("item", "hash", (F.col("n") * F.col("w")).alias("weight"), essential.alias("essential"), "threshold", rest.alias("rest"))


def _write_queries(bounds: DataFrame) -> tuple[str, int]:
    """query_bounds() as files of about BLOCK_ROWS rows, sorted by term; a query lies in one file."""
    spark = bounds.sparkSession
    rows = write_table(bounds, "search-queries")
    n = _blocks(rows.count(), BLOCK_ROWS)
    folder = scratch_path(spark, "search-blocks")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            block = whole.column(0)[0].as_py()
            _save(f"{folder}/block-{block:06d}", whole.drop_columns(["block"]))
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32())})

    dealt = rows.select(F.pmod(F.xxhash64("item"), F.lit(n)).cast("int").alias("block"), "*").repartitionById(n, "block").sortWithinPartitions("hash", "item")
    map_arrow(dealt, save, "block int").collect()  # one row a block
    return folder, n


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (row, index) with lo[row] <= index < hi[row]."""
    n = hi - lo
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]


class QueryBlock:
    """The queries of a block, ready to be joined with documents; thresholds rise while a task goes on."""

    def __init__(self, table: pa.Table, k: int):
        self.k = k
        codes = table["item"].chunk(0).dictionary_encode(null_encoding="encode")
        self.items, self.item = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.term, self.weight = table["hash"].to_numpy(), table["weight"].to_numpy()
        essential = table["essential"].to_numpy(zero_copy_only=False)
        self.sides = [np.flatnonzero(essential), np.flatnonzero(~essential)]
        self.floor, self.rest = np.ones(len(self.items), np.int64), np.zeros(len(self.items), np.int64)
        self.floor[self.item], self.rest[self.item] = table["threshold"].to_numpy(), table["rest"].to_numpy()
        self.best = np.zeros((len(self.items), k), np.int64)  # ascending

    def _add(self, scores: np.ndarray, side: np.ndarray, doc: np.ndarray, term: np.ndarray, quotient: np.ndarray, where: np.ndarray | None) -> None:
        """Adds impacts of the side's terms to the matrix (document, query); only to cells of where, if given."""
        lo, hi = np.searchsorted(self.term[side], term), np.searchsorted(self.term[side], term, "right")
        some = np.flatnonzero(hi > lo)
        ends = np.cumsum((hi - lo)[some])
        first = 0
        while first < len(some):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CONTRIBUTIONS, "right")))
            part = some[first:last]
            row, at = _expand(lo[part], hi[part])
            at, row = side[at], part[row]
            cell = doc[row] * len(self.items) + self.item[at]
            if where is not None:
                keep = where[cell]
                cell, row, at = cell[keep], row[keep], at[keep]
            np.add.at(scores, cell, self.weight[at] * quotient[row])
            first = last

    def join(self, docs: int, doc: np.ndarray, term: np.ndarray, quotient: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, query, score) of those of the documents 0 .. docs - 1 that may be among the k best; doc is in
        ascending order."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width, step = len(self.items), max(1, CELLS // len(self.items))
        for first in range(0, docs, step):
            a, b = np.searchsorted(doc, [first, first + step])
            n = min(step, docs - first)
            mine, t, q = doc[a:b] - first, term[a:b], quotient[a:b]
            scores = np.zeros(n * width, np.int64)
            self._add(scores, self.sides[0], mine, t, q, None)
            table = scores.reshape(n, width)
            candidate = (table > 0) & (table + self.rest >= self.floor)
            docs_left = candidate.any(axis=1)
            if not docs_left.any():
                continue
            keep = docs_left[mine]
            self._add(scores, self.sides[1], mine[keep], t[keep], q[keep], candidate.reshape(-1))
            d, i = np.nonzero(candidate & (table >= self.floor))
            self._raise(i, table[d, i])
            keep = table[d, i] >= self.floor[i]
            d, i = d[keep], i[keep]
            found.append((d + first, i, table[d, i]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        d, i, s = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = s >= self.floor[i]
        return d[keep], i[keep], s[keep]

    def _raise(self, query: np.ndarray, score: np.ndarray) -> None:
        """Puts new scores among each query's k best, and its floor to the k-th."""
        order = np.lexsort((-score, query))
        query, score = query[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        query, score, rank = query[rank < self.k], score[rank < self.k], rank[rank < self.k]
        touched = np.unique(query)
        new = np.zeros((len(self.items), self.k), np.int64) if len(touched) > 64 else None
        if new is None:
            for i in touched.tolist():
                self.best[i] = np.sort(np.concatenate((self.best[i], score[query == i])))[-self.k :]
        else:
            new[query, rank] = score
            self.best[touched] = np.sort(np.concatenate((self.best[touched], new[touched]), axis=1), axis=1)[:, -self.k :]
        self.floor[touched] = np.maximum(self.floor[touched], self.best[touched, 0])


def search(
    docs: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_text_col: str = "text"
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query, scores above 0 only; equal scores in the order
    of the ids (null last).

    A term t that df of N documents have weighs w = floor(1000 * ln((2N + 2) / (2df + 1))); it gives a document that
    has it tf times w * (10^9 * tf div (1000 * tf + 8m)), m = 25 + (75 * n * N div L), times its number in the query.
    Null and empty texts have no terms: as documents they don't count, as queries they find nothing. Rows of one
    query id (null is one, too) are one query; rows of docs stand for themselves, so repeated ids may be found twice.
    Empty tables give no rows. Columns other than those named are ignored.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    asked = write_table(query_terms(queries, query_id_col, query_text_col), "search-asked")
    vocabulary, terms = write_vocabulary(asked)
    index, path = store(build_index(docs, vocabulary, id_col=id_col, text_col=text_col), "search-index")
    n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    statistics = write_table(term_statistics(index, k, n_docs, n_terms), "search-statistics")
    folder, blocks = _write_queries(query_bounds(terms, statistics))
    item_kind = queries.schema[query_id_col].dataType.simpleString()
    doc_kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, QueryBlock] = {}
        floors: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            size = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(batch.num_rows), size)
            term, tf = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            m = 25 + 75 * batch.column(1).to_numpy()[doc] * n_docs // max(n_terms, 1)
            quotient = 1_000_000_000 * tf // (1000 * tf + 8 * m)
            for b in range(blocks):
                if b not in held:
                    table = _load(f"{folder}/block-{b:06d}")
                    if table is None:
                        continue
                    if blocks > 1:
                        held.clear()  # one block at a time; what it has learnt stays
                    held[b] = QueryBlock(table, k)
                    if b in floors:
                        held[b].floor, held[b].best = floors[b]
                one = held[b]
                d, i, s = one.join(batch.num_rows, doc, term, quotient)
                floors[b] = one.floor, one.best
                if len(d):
                    yield pa.RecordBatch.from_arrays([one.items.take(pa.array(i)), batch.column(0).take(pa.array(d)), pa.array(s)], ["item_id", "doc_id", "score"])

    found = map_arrow(index, run, f"item_id {item_kind}, doc_id {doc_kind}, score bigint")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best, _ = store(found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "search-found")
    drop(docs.sparkSession, path)
    return best
