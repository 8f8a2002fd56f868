"""Bronze and silver: drop reasons, ids, first-wins dedup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import messages as M


@dataclass(frozen=True)
class CleanConfig:
    min_messages: int = 2
    min_assistant_chars: int = 2
    max_chars: int = 120_000
    quality_score: float = 0.8


def drop_reason(config: CleanConfig = CleanConfig()) -> Column:
    """The first rule a record breaks, or null."""
    answered = F.exists("messages", lambda m: (m["role"] == "assistant") & (F.length(m["content"]) >= config.min_assistant_chars))
    return (
        F.when(F.size("messages") < config.min_messages, "too_few_messages")
        .when(~answered, "missing_assistant")
        .when(M.total_chars(F.col("messages")) > config.max_chars, "too_long")
    )


def classified(records: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    return records.withColumn("drop_reason", drop_reason(config))


def bronze(records: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    return classified(records, config).where("drop_reason IS NULL").drop("drop_reason")


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a total order; one shuffle, with a rank limit on either side of it."""
    kept = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(kept)).where("__nth = 1").drop("__nth")


def silver(bronze_rows: DataFrame) -> DataFrame:
    """Bronze without repeats of message text, over all sources; the first by file, row and trace stays."""
    return first_wins(bronze_rows, ["meta.dedupe_key_sha256"], ["meta.raw_object_key", "meta.raw_row_index", "meta.trace_index", "id"])


def drop_counts(records: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    """``reason, n``: drops by rule, and the repeats that silver leaves out, in one pass over the keys."""
    rows = classified(records, config).select("drop_reason", F.col("meta.dedupe_key_sha256").alias("key"))
    by_key = rows.groupBy("drop_reason", "key").agg(F.count("*").alias("n"))
    spread = by_key.select(F.explode(F.array(F.struct(F.coalesce("drop_reason", F.lit("duplicate")).alias("reason"), F.when(F.col("drop_reason").isNull(), F.col("n") - 1).otherwise(F.col("n")).alias("n")))).alias("s"))
    return spread.groupBy("s.reason").agg(F.sum("s.n").alias("n")).where("n > 0")
