"""Training turns: conversion, repair, validation, export rows and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions.schema import is_object
from .scoring import as_calls, normalized

TURN = "struct<from:string,value:string>"
#: Role -> side of a training turn.
SIDES = {"user": "human", "assistant": "gpt", "tool": "observation"}
TOOL_CALLS = "array<struct<type:string,function:struct<name:string,arguments:string>>>"
INPUTS, MODELS = ("human", "observation"), ("gpt", "function_call")


def turns_of(messages: Column) -> Column:
    """Messages but system ones as turns; a message named ``function_call`` is one, whatever its role."""
    side = F.create_map(*(F.lit(x) for kv in SIDES.items() for x in kv))

    def turn(m: Column) -> Column:
        who = F.when(F.coalesce(m["name"] == M.CALL, F.lit(False)), M.CALL).otherwise(F.try_element_at(side, m["role"]))
        return F.struct(who.alias("from"), m["content"].alias("value"))

    return F.transform(F.filter(messages, lambda m: m["role"] != "system"), turn).cast(f"array<{TURN}>")


def system_text(messages: Column) -> Column:
    return F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"]), "\n\n")


def repair_of(turns: Column) -> tuple[Column, Column]:
    """What a repair leaves of the turns, and its tag (null: nothing was done).

    A trailing observation goes, one of them; a trailing human turn goes.
    """
    last = F.try_element_at(turns, F.lit(-1))["from"]
    short = F.slice(turns, 1, F.greatest(F.size(turns) - 1, F.lit(0)))
    tag = F.when(last == "observation", "trimmed_trailing_observation").when(last == "human", "trimmed_trailing_human_turn")
    return F.when(tag.isNull(), turns).otherwise(short), tag


def turn_error(turns: Column) -> Column:
    """The first rule that the turns break, in their order; null if they are valid."""

    def check(t: Column, i: Column) -> Column:
        before, after = F.get(turns, i - 1)["from"], F.get(turns, i + 1)["from"]
        at = F.concat(F.lit("turn "), i.cast("string"), F.lit(": "))
        return (
            F.when(F.coalesce(~t["from"].isin(*INPUTS, *MODELS), F.lit(True)), F.concat(at, F.lit("unknown side")))
            .when(F.coalesce(F.trim(F.regexp_replace(t["value"], r"(?U)\s+", " ")) == "", F.lit(True)), F.concat(at, F.lit("empty value")))
            .when((i % 2 == 0) != t["from"].isin(*INPUTS), F.concat(at, F.lit("wrong side")))
            .when((t["from"] == "observation") & F.coalesce(before != M.CALL, F.lit(True)), F.concat(at, F.lit("observation is not preceded by a function call")))
            .when((t["from"] == M.CALL) & after.isNotNull() & (after != "observation"), F.concat(at, F.lit("function call is not followed by an observation")))
        )

    first = F.try_element_at(F.array_compact(F.transform(turns, check)), F.lit(1))
    opening, closing = F.get(turns, F.lit(0))["from"], F.try_element_at(turns, F.lit(-1))["from"]
    ends = F.when(F.size(turns) == 0, "no turns").when(opening != "human", "must start with a human turn").when(~closing.isin(*MODELS), "must end with a model turn")
    return F.coalesce(F.when(F.size(turns) == 0, "no turns"), first, ends)


def export_rows(records: DataFrame) -> DataFrame:
    """``id, source_dataset, conversations, system, tools, repair, error`` of each record, plus other columns named ``split``.

    ``tools`` is a JSON list of objects, or empty text; a tool that isn't an object is an error.
    """
    repaired, tag = repair_of(F.col("__turns"))
    tools = F.coalesce(F.col("tools"), F.expr("cast(array() as array<string>)"))
    text = F.when(F.size(tools) == 0, "").otherwise(F.concat(F.lit("["), F.array_join(tools, ","), F.lit("]")))
    bad_tool = F.when(F.exists(tools, lambda t: ~is_object(t)), "a tool is not an object")
    kept = [c for c in ("split",) if c in records.columns]
    rows = records.withColumn("__turns", turns_of(F.col("messages"))).withColumn("conversations", repaired).withColumn("repair", tag)
    return rows.select("id", "source_dataset", *kept, "conversations", system_text(F.col("messages")).alias("system"), text.alias("tools"), "repair", F.coalesce(bad_tool, turn_error(F.col("conversations"))).alias("error"))


def checked(rows: DataFrame) -> DataFrame:
    """Export rows, failing the job at the first record in error."""
    told = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "id", "error")))
    return rows.withColumn("error", told.cast("string"))


def export_stats(rows: DataFrame) -> DataFrame:
    """One row: records, valid, repaired, with calls."""
    calls = F.exists("conversations", lambda t: t["from"] == M.CALL)
    return rows.agg(F.count("*").alias("records"), F.count_if(F.col("error").isNull()).alias("valid"), F.count_if(F.col("repair").isNotNull()).alias("repaired"), F.count_if(calls).alias("with_calls"))


def side_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("conversations").alias("t")).groupBy(F.col("t.from").alias("side")).agg(F.count("*").alias("n"))


def repair_counts(rows: DataFrame) -> DataFrame:
    return rows.where("repair IS NOT NULL").groupBy("repair").agg(F.count("*").alias("n"))


def _failing(wrong: Column, told: str, kind: str) -> Column:
    """Null of a type, or the end of the job where ``wrong`` holds; the message names the row."""
    return F.when(wrong, F.raise_error(F.concat(F.lit("row "), F.coalesce(F.col("id").cast("string"), F.lit("?")), F.lit(f": {told}")))).cast(kind)


def prompt_and_label(rows: DataFrame) -> DataFrame:
    """The last turn, which must be the model's, as label, and what stands before it as prompt messages, system first.

    A function call among the prompt's turns becomes an assistant's message with ``tool_calls``. A row
    that doesn't end with the model, a turn of an unknown side, and a call that isn't JSON of calls end the job.
    """
    last = F.try_element_at("conversations", F.lit(-1))
    turns = F.slice("conversations", 1, F.greatest(F.size("conversations") - 1, F.lit(0)))
    role = F.create_map(*(F.lit(x) for kv in {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "function_call": "assistant", "observation": "tool", "tool": "tool", "system": "system"}.items() for x in kv))

    def message(t: Column) -> Column:
        is_call = t["from"] == M.CALL
        calls = F.when(is_call, normalized(as_calls(F.try_parse_json(t["value"]))))
        side = F.coalesce(F.try_element_at(role, t["from"]), _failing(F.lit(True), "unknown side of a turn", "string"))
        wrapped = F.transform(calls, lambda c: F.struct(F.lit("function").alias("type"), c.alias("function")))
        told = F.coalesce(wrapped, _failing(is_call, "a function call is not JSON of calls", TOOL_CALLS)).cast(TOOL_CALLS)
        return F.struct(side.alias("role"), F.when(is_call, "").otherwise(t["value"]).alias("content"), told.alias("tool_calls"))

    chat = F.transform(turns, message)
    said = F.trim("system")
    needed = (said != "") & (F.coalesce(F.try_element_at("conversations", F.lit(1))["from"], F.lit("")) != "system")
    opening = F.when(needed, F.array(F.struct(F.lit("system").alias("role"), said.alias("content"), F.lit(None).cast(TOOL_CALLS).alias("tool_calls"))))
    prompt = F.concat(F.coalesce(opening, F.expr(f"cast(array() as array<struct<role:string,content:string,tool_calls:{TOOL_CALLS}>>)")), chat)
    ends = F.coalesce(last["from"].isin(*MODELS), F.lit(False))
    label = F.coalesce(_failing(~ends, "it does not end with the model's turn", "string"), last["value"])
    return rows.select("id", "source_dataset", prompt.alias("prompt"), label.alias("label"))
