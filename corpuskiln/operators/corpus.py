"""Operators on whole corpora: concatenate, interleave, cut, sample, split, shuffle, filter, group, align."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import check_unique, number_rows, payload_columns


def portable_hash(seed: int | str, *ids: Column) -> Column:
    """A 32-bit number from a seed and ids, the same in any engine that has md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def group(corpus: DataFrame, archive_size: int = 1000, basename: str = "archive") -> DataFrame:
    """Groups documents, in order, into archives of archive_size; names are zero-padded to the last archive's width."""
    numbered = number_rows(corpus, F.col("doc_ord"), name="_row", unique=("doc_ord",))
    n = corpus.agg((F.count(F.lit(1)) - 1).alias("_last"))
    width = F.length(F.floor(F.greatest("_last", F.lit(0)) / archive_size).cast("string"))
    named = numbered.drop("archive").crossJoin(F.broadcast(n))  # one row
    number = F.floor(F.col("_row") / archive_size).cast("string")
    return named.withColumn("archive", F.concat(F.lit(f"{basename}-"), F.lpad(number, width, "0"))).select(*corpus.columns)


def concat(corpora: list[DataFrame]) -> DataFrame:
    """All documents of the first corpus, then of the next; archives get the prefix corpus{i}_.

    doc_ord is made to ascend over all: each corpus is moved beyond the largest of those before it.
    """
    if len({tuple(payload_columns(c)) for c in corpora}) != 1:
        raise TypeError("corpora must have the same payload columns")
    parts = []
    for i, c in enumerate(corpora):
        parts.append(c.withColumn("archive", F.concat(F.lit(f"corpus{i}_"), F.col("archive"))).withColumn("_src", F.lit(i)))
    both = reduce(DataFrame.unionByName, parts)
    ends = both.groupBy("_src").agg((F.max("doc_ord") - F.min("doc_ord") + 1).alias("_span"), F.min("doc_ord").alias("_least"))
    shift = ends.select("_src", "_least", F.coalesce(F.sum("_span").over(Window.orderBy("_src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    moved = both.join(F.broadcast(shift), "_src").withColumn("doc_ord", F.col("doc_ord") - F.col("_least") + F.col("_shift"))  # one row a corpus
    return moved.select(*corpora[0].columns)


def _added(values: Column) -> Column:
    """The sum of a list of doubles, added from left to right."""
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _blocks(step: Column, n: Column) -> Column:
    """Blocks of 16^k steps, largest first, as many sizes as n has hexadecimal digits: their length and their sum,
    which is that of 16 of the next smaller blocks."""
    block = lambda length, total: F.struct(length.cast("bigint").alias("length"), total.cast("double").alias("total"))
    first = F.array(block(F.lit(1), step))
    more = F.array_repeat(F.lit(0), F.length(F.hex(n)) - 1)
    return F.aggregate(more, first, lambda a, _: F.concat(F.array(block(a[0]["length"] * 16, _added(F.array_repeat(a[0]["total"], 16)))), a))


def _sum_of_blocks(blocks: Column, n: Column) -> Column:
    """The sum of n steps: as many blocks of each size as n's hexadecimal digit says, added from the largest."""
    return _added(F.flatten(F.transform(blocks, lambda b: F.array_repeat(b["total"], (F.floor(n / b["length"]) % 16).cast("int")))))


def interleave(corpora: list[DataFrame], *, scaled: bool = False, in_blocks: bool = False) -> DataFrame:
    """Documents of all corpora spread evenly: always one of the corpus whose progress is least (ties: the first).

    A document moves its corpus on by longest / own length. Progress is the running sum of these steps, as adding
    them up one by one gives it, which keeps a corpus's numbering in one task. Two other forms number slices side by
    side and order alike but for rounding of ties: scaled=True takes position / length instead; in_blocks=True adds up
    blocks of 16 steps, blocks of 16 such blocks and so on, the largest first, which is how DuckDB's sum over rows up
    to the one before rounds. The formula never depends on the size. Archives become corp{i}_{archive}; adds pos from
    0, which becomes doc_ord.
    """
    if scaled and in_blocks:
        raise ValueError("scaled and in_blocks exclude each other")
    parts = []
    for i, c in enumerate(corpora):
        name = F.concat(F.lit(f"corp{i}_"), F.col("archive"))
        parts.append(c.withColumn("archive", name).withColumn("_src", F.lit(i)))
    both = reduce(DataFrame.unionByName, parts)
    keys = both.select("_src", "doc_ord")  # documents themselves are moved once, in the last join
    sizes = keys.groupBy("_src").agg(F.count(F.lit(1)).alias("_len"))
    sizes = sizes.withColumn("_step", F.max("_len").over(Window.partitionBy()).cast("double") / F.col("_len"))  # one row a corpus
    if scaled or in_blocks:
        sizes = sizes.withColumn("_blocks", _blocks(F.col("_step"), F.col("_len"))) if in_blocks else sizes
        ranked = reduce(DataFrame.unionByName, [number_rows(keys.where(F.col("_src") == i), F.col("doc_ord"), name="_at") for i in range(len(corpora))])
        ranked = ranked.join(F.broadcast(sizes), "_src")  # one row a corpus
        ranked = ranked.withColumn("_progress", _sum_of_blocks(F.col("_blocks"), F.col("_at")) if in_blocks else F.col("_at") / F.col("_len"))
    else:
        before = Window.partitionBy("_src").orderBy("doc_ord").rowsBetween(Window.unboundedPreceding, -1)
        ranked = keys.join(F.broadcast(sizes), "_src").withColumn("_progress", F.coalesce(F.sum("_step").over(before), F.lit(0.0)))
    placed = number_rows(ranked.select("_src", "doc_ord", "_progress"), F.col("_progress"), "_src", "doc_ord", name="pos").select("_src", "doc_ord", "pos")
    out = both.join(placed, ["_src", "doc_ord"])
    return out.withColumn("doc_ord", F.col("pos")).select(*corpora[0].columns, "pos")


def subset(corpus: DataFrame, size: int, offset: int = 0, *, skip_invalid: bool = False) -> DataFrame:
    """size documents in order after the first offset ones; skip_invalid counts valid documents only, for both."""
    rows = corpus.where("error is null") if skip_invalid else corpus
    numbered = number_rows(rows.select("doc_ord"), F.col("doc_ord"), name="_row").where(F.col("_row").between(offset, offset + size - 1))
    return rows.join(numbered.select("doc_ord"), "doc_ord", "left_semi").select(*corpus.columns)


def subsample(corpus: DataFrame, p: float, seed: int = 1234, *, skip_invalid: bool = False) -> DataFrame:
    """Each document with probability p, by a seeded hash of its order; p > 1 is a wanted number of documents."""
    rows = corpus.where("error is null") if skip_invalid else corpus
    if p > 1:
        n = corpus.count()
        p = int(p) / n if n else 0.0
    return rows.where(portable_hash(seed, F.col("doc_ord")) < p * 2.0**32)


def split(corpus: DataFrame, set1_size: float, seed: int = 1234) -> tuple[DataFrame, DataFrame]:
    """Two disjoint sets of all documents: exactly set1_size of them (a share if at most 1), drawn by a seeded hash,
    and the rest."""
    n = corpus.count()
    k = min(n, int(set1_size)) if set1_size > 1 else int(set1_size * n)
    ranked = number_rows(corpus, portable_hash(seed, F.col("doc_ord")), "doc_ord", name="_rank", unique=("doc_ord",))
    return ranked.where(F.col("_rank") < k).select(*corpus.columns), ranked.where(F.col("_rank") >= k).select(*corpus.columns)


def names(corpus: DataFrame) -> DataFrame:
    """The document names, as a string list."""
    return corpus.select(F.col("doc_name").alias("value"), F.col("doc_ord").alias("ord"))


def shuffle(corpus: DataFrame, seed: int = 999, *, keep_archive_names: bool = False) -> DataFrame:
    """All documents in a seeded random order: adds pos from 0, which becomes doc_ord. keep_archive_names puts the
    archive before the name, as archive__name."""
    out = number_rows(corpus, portable_hash(seed, F.col("doc_ord")), "doc_ord", name="pos", unique=("doc_ord",))
    if keep_archive_names:
        out = out.withColumn("doc_name", F.concat_ws("__", "archive", "doc_name"))
    return out.withColumn("doc_ord", F.col("pos")).select(*corpus.columns, "pos")


def shuffle_linear(corpus: DataFrame, seed: int = 999, *, bin_size: int = 100, num_bins: int = 0, keep_archive_names: bool = False) -> DataFrame:
    """Documents dealt, in order, to bins at random, and put in a random order inside each bin, bin after bin: adds pos
    from 0, which becomes doc_ord. There are num_bins bins or, if that is 0, enough for bin_size documents in each."""
    bins = num_bins or max(1, -(-corpus.count() // bin_size))
    at = portable_hash(f"{seed}:bin", F.col("doc_ord")) % bins
    keyed = corpus.withColumn("_inside", portable_hash(seed, F.col("doc_ord")))
    out = number_rows(keyed, at, "_inside", "doc_ord", name="pos", unique=("doc_ord",))
    if keep_archive_names:
        out = out.withColumn("doc_name", F.concat_ws("__", "archive", "doc_name"))
    return out.withColumn("doc_ord", F.col("pos")).select(*corpus.columns, "pos")


def list_filter(corpus: DataFrame, wanted: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Documents whose name is in a list, and the others."""
    keys = wanted.select(F.col(column).cast("string").alias("doc_name")).distinct()
    return corpus.join(keys, "doc_name", "left_semi").select(*corpus.columns), corpus.join(keys, "doc_name", "left_anti").select(*corpus.columns)


def align(corpora: list[DataFrame], prefixes: list[str] | None = None, *, strict: bool = True) -> DataFrame:
    """Corpora side by side, one row for each (archive, doc_name), payloads prefixed. strict fails when read if a
    document is missing from any of them; otherwise such documents are left out. doc_ord is the first's."""
    prefixes = prefixes or [f"in{i}_" for i in range(len(corpora))]
    on, how = ["archive", "doc_name"], "full_outer" if strict else "inner"
    out = None
    for i, (c, p) in enumerate(zip(corpora, prefixes, strict=True)):
        part = c.select(*on, *[F.col(x).alias(p + x) for x in (*payload_columns(c), "error")], F.col("doc_ord").alias(f"_ord{i}"))
        out = part if out is None else out.join(part, on, how)
    if strict:
        whole = reduce(lambda a, b: a & b, [F.col(f"_ord{i}").isNotNull() for i in range(len(corpora))])
        out = out.where(F.assert_true(whole, F.concat(F.lit("not in all corpora: "), F.concat_ws("/", *on))).isNull())
    return out.withColumn("doc_ord", F.col("_ord0")).drop(*[f"_ord{i}" for i in range(len(corpora))])


def append_checked(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both corpora's documents; fails when read if a name occurs twice in an archive."""
    return check_unique(old.unionByName(new))


def after(corpus: DataFrame, archive: str, doc_name: str) -> DataFrame:
    """The documents after a named one, to take up a stopped run. Raises ValueError if there is none of that name."""
    row = corpus.where((F.col("archive") == archive) & (F.col("doc_name") == doc_name)).select("doc_ord").first()
    if row is None:
        raise ValueError(f"no document {archive}/{doc_name}")
    return corpus.where(F.col("doc_ord") > row[0])
