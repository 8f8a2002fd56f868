"""Structured Streaming forms: incremental bronze and silver, windowed counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import CleanConfig, bronze
from ..operators.raw import adapt_rows
from ..operators.records import with_record_columns


def raw_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """New JSON lines files as ``raw_object_key, raw_row_index, line, seen_at``; lines are numbered within their file."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.jsonl").load(path)
    rows = files.select(F.col("_metadata.file_path").alias("raw_object_key"), F.col("_metadata.file_modification_time").alias("seen_at"), F.posexplode(F.split("value", "\r?\n")).alias("raw_row_index", "line"))
    return rows.where(F.trim("line") != "")


def silver_stream(lines: DataFrame, config: CleanConfig = CleanConfig(), horizon: str = "7 days") -> DataFrame:
    """Bronze rules, then dedup of message text within ``horizon``: the state is bounded by the watermark."""
    records = with_record_columns(adapt_rows(lines)).withColumn("__key", F.col("meta.dedupe_key_sha256")).withColumn("seen_at", F.current_timestamp())
    return bronze(records, config).withWatermark("seen_at", horizon).dropDuplicatesWithinWatermark(["__key"]).drop("__key", "seen_at")


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window; works over a stream and over a table alike."""
    base = events.withWatermark("ts", late) if events.isStreaming else events
    return base.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("starts"), "event_type", "n", "total")
