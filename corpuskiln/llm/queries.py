"""The contract queries opN_<name>: each reads its whole table, applies its operator and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fingerprints, htmltree, knlm, lexical, mixing, ordinal, periodic, pii, simhash, substrings, tokenstore, urls
from ._common import WORD_PATTERN, scratch_path
from .sql import ORACLE_SQL  # noqa: F401


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    ids = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
        decontam.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltree.extract(_read(spark, sf_dir, "pages"), keep=("url",)).select("page_id", "url", "text", "n_chars")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(_read(spark, sf_dir, "documents")).drop("kept")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = knlm.train(docs.where(~knlm.held_out()))
    found = knlm.score(docs, model)
    return found.select("doc_id", knlm.held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_read(spark, sf_dir, "documents"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(_read(spark, sf_dir, "documents"))


def graded(labels: DataFrame) -> DataFrame:
    """labels with the rating that op9 learns."""
    return labels.select("doc_id", ordinal.grade(F.col("quality"), F.col("toxic")).alias("grade"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = ordinal.train(docs, graded(_read(spark, sf_dir, "labels")))
    p = [F.element_at("tails", k) for k in (1, 2)]
    return ordinal.score(docs, model).select("doc_id", "expected_grade", p[0].alias("p_harmless"), p[1].alias("p_good"), (p[1] >= 0.5).alias("keep"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark, "tokens")
    shards = tokenstore.write_tokens(_read(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return tokenstore.read_tokens(spark, folder, [(r.shard, r.tokens) for r in shards.collect()])


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; of each tenth document by the hash of its id, the words from one place on are replaced by
    repetitions of the words that stand there, as op13's contract says. A null id leaves its text as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD_PATTERN), F.lit(0))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = (F.col("n") - F.col("a")).cast("int")
    period = F.slice("w", F.col("a") + 1, F.col("p"))
    again = F.slice(F.flatten(F.array_repeat(period, F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    changed = F.array_join(F.concat(F.slice(F.col("w"), F.lit(1), F.col("a")), again), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(planted_runs(_read(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = found.withColumn("best", periodic.longest())
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )


_ALL = (
    op1_decontaminate, op2_simhash, op3_html, op4_substrings, op5_lm, op6_pii, op7_mix, op8_fingerprint, op9_quality, op10_tokens, op11_search, op12_urls, op13_runs,
)
QUERIES = {f.__name__: f for f in _ALL}
