"""The training-data pipeline: quality, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet into the shared folder and
reads it again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuskiln.llm import decontam, mixing, ordinal, queries, simhash, tokenstore
from corpuskiln.llm._common import scratch_path, write_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what is more likely good than not; fitted to the labelled rows of docs."""
    model = ordinal.train(docs, queries.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return ordinal.select(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that with the smallest id. Linked are SimHash fingerprints of
    five-word shingles that the index on byte positions finds near enough, and what shares 0.8 of its shingles."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark passages cover one word in twenty or more."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources wants it; a row for each time."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files and returns the documents as read back from them."""
    import public_tokenizers

    folder = scratch_path(spark, "tokens")
    shards = tokenstore.write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return tokenstore.read_tokens(spark, folder, [(r.shard, r.tokens) for r in shards.collect()])


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("mixed", mixed), ("tokens", tokens)]

#: SQL has neither the classifier nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
