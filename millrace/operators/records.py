"""Canonical records: source facts, ids, and records of turn tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions.schema import META, VERSION
from ..functions.text import source_of, uuid5

#: What each source is used for.
TASK_FAMILIES = {
    "salesforce_xlam_function_calling_60k": "function_calling",
    "xlam_function_calling_60k_parsed": "function_calling",
    "salesforce_apigen_mt_5k": "agent_multi_turn",
    "openthoughts_agent_v1_sft": "agent_terminal_code",
    "nvidia_opencodeinstruct": "code_instruction",
    "glint_fable_5_traces": "agent_trace",
}


def task_family(source: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in TASK_FAMILIES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, source), F.lit("sft"))


def domain(family: Column) -> Column:
    """``code`` wins over ``agent``."""
    return F.when(family.contains("code"), "code").when(family.contains("agent"), "agent").otherwise("general")


def stable_id(source: Column, row_index: Column, raw_id: Column, messages: Column) -> Column:
    """A version-5 UUID of the record's canonical JSON text, keys in order."""
    return uuid5(F.to_json(F.struct(messages.alias("messages"), raw_id.alias("raw_id"), row_index.alias("row_index"), source.alias("source_dataset"))))


def with_record_columns(df: DataFrame, quality: float = 0.8) -> DataFrame:
    """Records of rows with ``raw_object_key, raw_row_index, raw_id, messages, tools`` (and trace columns, if any)."""
    source = source_of(F.col("raw_object_key"))
    extra = {"raw_row_indexes": "array<bigint>", "raw_event_count": "bigint", "trace_index": "bigint", "cwd": "string", "model_id": "string", "thinking_level": "string", "tool_calls": "array<string>"}
    meta = F.struct(
        F.col("raw_object_key"), F.col("raw_row_index").cast("long").alias("raw_row_index"), F.col("raw_id").cast("string").alias("raw_id"), M.dedupe_key(F.col("messages")).alias("dedupe_key_sha256"),
        *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in extra.items()),
    ).cast(META)
    family = task_family(source)
    return df.select(
        stable_id(source, F.col("raw_row_index"), F.col("raw_id"), F.col("messages")).alias("id"), F.lit(VERSION).alias("schema_version"), source.alias("source_dataset"),
        family.alias("task_family"), domain(family).alias("domain"), F.col("messages"), F.col("tools"), F.lit(quality).alias("quality_score"), meta.alias("meta"),
    )


def records_of_turns(turns: DataFrame, sources: int = 4) -> DataFrame:
    """One record per conversation of a table ``conv_id, turn, role, text``; sources are dealt by the id."""
    raw = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.lit(None).cast("string").alias("name")))
    grouped = turns.groupBy("conv_id").agg(M.from_raw(raw).alias("messages"))
    key = F.concat(F.lit("raw/source=hf/dataset=set"), (F.col("conv_id") % sources).cast("string"), F.lit("/part-000000.jsonl"))
    rows = grouped.select(key.alias("raw_object_key"), F.col("conv_id").alias("raw_row_index"), F.col("conv_id").cast("string").alias("raw_id"), "messages", F.expr("cast(array() as array<string>)").alias("tools"))
    return with_record_columns(rows)
