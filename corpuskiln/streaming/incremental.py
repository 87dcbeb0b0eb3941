"""Incremental corpus processing: new documents in a folder are mapped once and appended, across restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def map_new_documents(spark: SparkSession, source: str, schema: StructType | str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, *, max_files: int | None = None) -> int:
    """Applies transform to what arrived in source (Parquet) since the last call, appends it to target, and returns
    the number of batches. The checkpoint remembers what is done, so a restart goes on where the last run ended and
    nothing is processed twice. transform must work on each document by itself.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    out = transform(reader.parquet(source))
    q = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return len([p for p in q.recentProgress if p["numInputRows"]])


def windowed_counts(events: DataFrame, *, ts: str = "ts", key: str = "event_type", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by time window and key, of a batch or a stream; in a stream events later than late are left out."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
