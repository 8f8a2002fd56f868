"""Expressions over arrays of chat messages (role, content, name)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, is_blank, sha256

MESSAGE = "struct<role:string,content:string,name:string>"
MESSAGES = f"array<{MESSAGE}>"
#: Fixed values of the data model: raw role -> role, and the roles that mark a tool call or observation.
ROLES = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "system": "system", "tool": "tool", "observation": "tool", "function": "assistant", "function_call": "assistant", "tool_call": "assistant"}
CALL_ROLES = ("function", "function_call", "tool_call")
OBSERVATION_ROLES = ("observation", "tool")
CALL = "function_call"
INPUT_ROLES, MODEL_ROLE = ("user", "tool"), "assistant"


def message(role: Column, content: Column, name: Column | None = None) -> Column:
    """A message, or null when nothing is left of its content."""
    text = clean_text(content)
    named = F.lit(None).cast("string") if name is None else F.when(name != "", name)
    return F.when(text != "", F.struct(role.alias("role"), text.alias("content"), named.alias("name")).cast(MESSAGE))


def from_raw(raw: Column) -> Column:
    """Messages of raw ``struct<role, content, name>`` items.

    Items left empty are dropped first, so that an unknown role is read by its place among the kept
    ones: user if first, assistant else. An empty observation becomes ``{}``; a call's name is
    ``function_call``.
    """
    known = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))

    def filled(m: Column) -> Column:
        text = clean_text(m["content"])
        content = F.when(m["role"].isin(*OBSERVATION_ROLES) & (text == ""), "{}").otherwise(text)
        return F.struct(m["role"].alias("role"), content.alias("content"), m["name"].alias("name"))

    kept = F.filter(F.transform(raw, filled), lambda m: m["content"] != "")

    def read(m: Column, i: Column) -> Column:
        role = F.coalesce(F.try_element_at(known, F.coalesce(m["role"], F.lit(""))), F.when(i == 0, "user").otherwise("assistant"))
        name = F.when(m["role"].isin(*CALL_ROLES), CALL).otherwise(F.when(m["name"] != "", m["name"]))
        return F.struct(role.alias("role"), m["content"].alias("content"), name.alias("name"))

    return F.transform(kept, read).cast(MESSAGES)


def total_chars(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0).cast("long"), lambda a, m: a + F.coalesce(F.length(m["content"]), F.lit(0)))


def count_where(messages: Column, test) -> Column:
    return F.size(F.filter(messages, test)).cast("long")


def dedupe_key(messages: Column) -> Column:
    """SHA-256 of the lines ``role:content``; names and tools don't count."""
    return sha256(F.array_join(F.transform(messages, lambda m: F.concat_ws(":", m["role"], F.coalesce(m["content"], F.lit("")))), "\n"))


def role_sequence(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["role"]), " -> ")


def turns_alternate(messages: Column) -> Column:
    """Without system messages: input, model, input, ... ; tools count as input; an input may end it; none is invalid."""
    turns = F.filter(messages, lambda m: m["role"] != "system")
    fit = F.transform(turns, lambda m, i: F.when(i % 2 == 0, m["role"].isin(*INPUT_ROLES)).otherwise(m["role"] == MODEL_ROLE))
    return (F.size(turns) > 0) & F.forall(fit, lambda ok: ok)


def has_blank(messages: Column) -> Column:
    return F.exists(messages, lambda m: is_blank(F.coalesce(m["content"], F.lit(""))))
