"""The canonical conversation record and its rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .messages import MESSAGES

VERSION = "sft.v1"
META = (
    "struct<raw_object_key:string,raw_row_index:bigint,raw_id:string,dedupe_key_sha256:string,raw_row_indexes:array<bigint>,raw_event_count:bigint,"
    "trace_index:bigint,cwd:string,model_id:string,thinking_level:string,tool_calls:array<string>>"
)
#: ``tools`` holds each tool as JSON text: an object's text, or a plain string that isn't one.
RECORD = f"id string, schema_version string, source_dataset string, task_family string, domain string, messages {MESSAGES}, tools array<string>, quality_score double, meta {META}"
ROLES = ("system", "user", "assistant", "tool")


def is_object(tool: Column) -> Column:
    """Is this JSON text an object?"""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(tool)).startswith("OBJECT"), F.lit(False))


def schema_errors() -> Column:
    """The broken rules of a record, in the order of the fields; empty if it is valid."""

    def given(c: str) -> Column:
        return F.when(F.col(c).isNull() | (F.col(c) == ""), f"{c}: must be text of one character or more")

    def each(test, told: str) -> Column:
        return F.when(F.coalesce(F.exists("messages", test), F.lit(False)), told)

    rules = [
        given("domain"),
        given("id"),
        F.when(F.col("messages").isNull() | (F.size("messages") < 2), "messages: must have two items or more"),
        each(lambda m: m["content"].isNull() | (m["content"] == ""), "messages/content: must be text of one character or more"),
        each(lambda m: m["role"].isNull() | ~m["role"].isin(*ROLES), "messages/role: must be one of the four roles"),
        F.when(F.col("meta").isNull(), "meta: is required"),
        F.when(F.col("quality_score").isNull() | ~F.col("quality_score").between(0, 1), "quality_score: must be from 0 to 1"),
        F.when(F.coalesce(F.col("schema_version") != VERSION, F.lit(True)), f"schema_version: must be {VERSION}"),
        given("source_dataset"),
        given("task_family"),
        F.when(F.col("tools").isNull(), "tools: is required"),
    ]
    return F.array_compact(F.array(*rules))
