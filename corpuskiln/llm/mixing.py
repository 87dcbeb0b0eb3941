"""Mixing sources to target weights by capped water-filling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import word_count, write_table

#: A source's documents are dealt into 2 ** 12 buckets by the top bits of a 60-bit hash; only the bucket in which the
#: cut falls is put in order.
CUT_BUCKET_BITS = 12


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Targets of sources (source_key, source_size, weight) that share total by weight.

    A source's target stops at max_epochs times its size and the excess goes to the others by weight, again and
    again until no source is above. In the order of size / weight the clamped sources come first, so running sums
    find the last clamped source; this gives the same targets as repeating the redistribution. One row a source:
    the window without partition sorts sources, never documents.

    Returns the columns of sources and target. Weight 0 or null: target 0. If all are clamped, total is not reached.
    """
    w = F.coalesce(F.greatest(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.orderBy(F.col("_ratio").asc_nulls_last(), F.col("source_key"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = (
        sources.withColumn("_w", w).withColumn("_cap", cap)
        .withColumn("_ratio", F.when(F.col("_w") > 0, F.col("_cap") / F.col("_w")))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", F.when(F.col("_w") > 0, F.greatest(F.lit(float(total)) - F.col("_capped"), F.lit(0.0)) / F.col("_rest")))
    )
    # the level is the one computed where clamping stops: at the first source whose cap is not below it
    level = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "source_key", "_level"))).over(every)["_level"]
    filled = ranked.withColumn("_stop", level)
    target = F.when(F.col("_w") <= 0, F.lit(0.0)).when(F.col("_stop").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * F.col("_stop")))
    return filled.select(*[F.col(c) for c in sources.columns], target.alias("target"))


def source_key(source: Column) -> Column:
    """A source's name as a non-null key that keeps null apart from the empty string."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def rank_weights(sources: DataFrame, cycle: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """Adds weight: the cycle's values in turn, to sources by code point (null last). One row a source."""
    at = F.row_number().over(Window.orderBy("_is_null", "_name")) - 1
    return (
        sources.withColumn("_is_null", F.substring("source_key", 1, 1)).withColumn("_name", F.expr("substring(source_key, 2)"))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (at % len(cycle) + 1).cast("int")))
        .drop("_is_null", "_name")
    )


def mix_plan(
    docs: DataFrame,
    *,
    weights: DataFrame | None = None,
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often a mix takes each document.

    The mix holds share times all words. Weights (source_key, weight) default to rank_weights(). A source with
    target t and size s takes every document floor(t / s) times; the fraction left is met by documents in the order
    of a seeded hash of the id, up to the document whose running sum comes nearest to it. Documents are dealt into
    buckets by that hash, so only bucket sums and the single bucket with the cut are ever ordered, however large a
    source is.

    Returns doc_id, source_key, size, source_size, target, repeats (int), taken = size * repeats. Null text has
    size 0; a null source is a source of its own; rows with null ids take part (all have one hash); repeated rows
    are counted each. An empty table gives no rows. Other columns are ignored.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")
    sized = write_table(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"), source_key(F.col(f"`{source_col}`")).alias("source_key"),
            word_count(F.col(f"`{text_col}`")).alias("size"), h.alias("_h"), F.shiftright(h, 60 - CUT_BUCKET_BITS).cast("int").alias("_bucket"),
        ),
        "mix-sizes",
    )
    buckets = write_table(sized.groupBy("source_key", "_bucket").agg(F.sum("size").alias("_sum")), "mix-buckets")
    sources = buckets.groupBy("source_key").agg(F.sum("_sum").alias("source_size"))
    total = buckets.agg(F.sum("_sum")).first()[0] or 0
    weighed = rank_weights(sources) if weights is None else sources.join(weights.select("source_key", "weight"), "source_key", "left")
    targets = write_table(water_fill(weighed, total * share, max_epochs), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    split = targets.withColumn("_whole", whole).withColumn("_need", F.col("target") - F.col("_whole") * F.col("source_size"))

    running = Window.partitionBy("source_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        buckets.join(split.select("source_key", "_need"), "source_key")
        .withColumn("_before", F.coalesce(F.sum("_sum").over(running), F.lit(0)))
        .where("_before <= _need and _need < _before + _sum")
        .select("source_key", F.col("_bucket").alias("_cut"), (F.col("_need") - F.col("_before")).alias("_left"))
    )
    plan = write_table(split.join(cut, "source_key", "left"), "mix-plan")
    placed = sized.join(plan, "source_key")
    # a source without a cut bucket needs none of its documents once more (need 0) or, at need = size, all of them
    outside = F.when(F.col("_cut").isNull(), (F.col("_need") >= F.col("source_size")) & (F.col("source_size") > 0)).otherwise(F.col("_bucket") < F.col("_cut"))
    in_cut = F.coalesce(F.col("_bucket") == F.col("_cut"), F.lit(False))
    order = Window.partitionBy("source_key").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.where(in_cut).withColumn("_sum", F.sum("size").over(order)).withColumn("_more", (F.col("_sum") - F.col("size") / 2 <= F.col("_left")) & (F.col("size") > 0))
    rest = placed.where(~in_cut).withColumn("_more", outside)
    repeats = (F.col("_whole") + F.col("_more").cast("int")).alias("repeats")
    out = rest.select(*placed.columns, "_more").unionByName(inside.select(*placed.columns, "_more"))
    out = out.select("doc_id", "source_key", "size", "source_size", "target", repeats)
    return out.withColumn("taken", F.col("size") * F.col("repeats"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: every row of docs as often as mix_plan() says; the columns of docs, in order.

    Needs unique ids; a document taken 0 times is left out. A row with a null id is taken as often as its source's
    whole repetitions say, or once more, like all null ids of that source.
    """
    plan = mix_plan(docs, id_col=id_col, **options).where("repeats > 0").select("doc_id", "repeats").dropDuplicates(["doc_id"])
    joined = docs.join(plan, docs[id_col].eqNullSafe(plan["doc_id"]))
    plain = [docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]  # a caller's names can't clash with ours
    copies = joined.select(*plain, F.explode(F.sequence(F.lit(1), plan["repeats"])).alias("copy"))
    return copies.drop("copy").toDF(*docs.columns)
