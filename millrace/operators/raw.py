"""Raw rows of differing shapes to messages and tools, over VARIANT; agent traces from event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions.text import clean_text, source_of

PROMPTS = ("instruction", "prompt", "question", "input")
ANSWERS = ("output", "response", "answer", "completion", "solution")
#: The sources whose answers are tool calls, and the source of traces.
CALL_SOURCES = ("salesforce_xlam_function_calling_60k", "xlam_function_calling_60k_parsed")
ITEM = "struct<role:string,content:string,name:string>"


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def text_of(v: Column) -> Column:
    """A VARIANT as text: text as it is, null as empty, anything else as its JSON."""
    return F.when(v.isNull() | (kind(v) == "VOID"), "").when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def given(v: Column) -> Column:
    """The VARIANT if it counts as given: not null, empty text, zero, false, nor an empty list or object."""
    return F.when(v.isNotNull() & ~F.to_json(v).isin('""', "0", "0.0", "false", "null", "[]", "{}"), v)


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def has(v: Column, name: str) -> Column:
    return field(v, name).isNotNull()


def listed(v: Column) -> Column:
    return F.when(kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def raw_items(v: Column) -> Column:
    """Role, content and name of the objects of a list; other items are skipped."""

    def one(x: Column) -> Column:
        role = F.coalesce(given(field(x, "role")), given(field(x, "from")), field(x, "speaker"))
        content = F.coalesce(given(field(x, "content")), given(field(x, "value")), field(x, "text"))
        return F.struct(text_of(role).alias("role"), text_of(content).alias("content"), text_of(field(x, "name")).alias("name"))

    return F.transform(F.filter(listed(v), lambda x: kind(x).startswith("OBJECT")), one)


def _items(*parts: tuple[str, Column, Column | None]) -> Column:
    return F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content"), (F.lit("") if n is None else n).alias("name")) for r, c, n in parts))


def messages_of(row: Column, source: Column) -> Column:
    """Messages of one raw row; the first shape that fits wins, and no shape gives none."""
    system = F.when(given(field(row, "system")).isNotNull(), _items(("system", text_of(field(row, "system")), None)))
    none = F.expr(f"cast(array() as array<{ITEM}>)")
    talks = F.concat(F.coalesce(system, none), raw_items(field(row, "conversations")))
    call = F.when(source.isin(*CALL_SOURCES), M.CALL).otherwise("")
    asked = _items(("user", text_of(field(row, "query")), None), ("assistant", text_of(field(row, "answers")), call))
    out = F.when(listed(field(row, "messages")).isNotNull(), raw_items(field(row, "messages")))
    out = out.when(listed(field(row, "conversations")).isNotNull(), talks).when(has(row, "query") & has(row, "answers"), asked)
    for p in PROMPTS:
        for a in ANSWERS:
            prompt = text_of(field(row, p))
            if p != "input":
                prompt = F.when(given(field(row, "input")).isNotNull(), F.concat(prompt, F.lit("\n"), text_of(field(row, "input")))).otherwise(prompt)
            out = out.when(has(row, p) & has(row, a), _items(("user", prompt, None), ("assistant", text_of(field(row, a)), None)))
    return M.from_raw(F.coalesce(out, none))


def tools_of(v: Column) -> Column:
    """Tools as JSON texts: text is parsed or kept, one object is a list of itself, parsed lists in a list are flattened once."""

    def opened(x: Column) -> Column:
        parsed = F.when(kind(x) == "STRING", F.try_parse_json(F.try_variant_get(x, "$", "string")))
        several = F.transform(listed(parsed), lambda y: F.to_json(y))
        return F.coalesce(several, F.array(F.when(parsed.isNotNull(), F.to_json(parsed)).otherwise(text_of(x))))

    value = given(v)
    whole = F.when(kind(value) == "STRING", F.coalesce(F.try_parse_json(F.try_variant_get(value, "$", "string")), value)).otherwise(value)
    items = F.coalesce(listed(whole), F.when(whole.isNotNull(), F.array(whole)), F.expr("cast(array() as array<variant>)"))
    return F.flatten(F.transform(items, opened))


def adapt_rows(lines: DataFrame) -> DataFrame:
    """``raw_object_key, raw_row_index, raw_id, messages, tools`` of lines ``raw_object_key, raw_row_index, line``."""
    rows = lines.withColumn("__row", F.try_parse_json("line")).where(F.col("__row").isNotNull())
    row = F.col("__row")
    raw_id = F.when(has(row, "id"), text_of(field(row, "id")))
    return rows.select("raw_object_key", "raw_row_index", raw_id.alias("raw_id"), messages_of(row, source_of(F.col("raw_object_key"))).alias("messages"), tools_of(field(row, "tools")).alias("tools"))


# -- agent traces ------------------------------------------------------------------------------


def segmented(events: DataFrame, key: str, order: str, opens: Column) -> DataFrame:
    """Adds ``trace_index``: a trace starts at each row that ``opens`` one; rows before the first are trace 0."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    seen = events.withColumn("__seen", F.sum(opens.cast("int")).over(upto))
    first = F.min("__seen").over(Window.partitionBy(key))
    return seen.withColumn("trace_index", (F.col("__seen") - first).cast("long")).drop("__seen")


def part_texts(content: Column) -> Column:
    """The text of a trace message: text, or the joined texts of its parts."""

    def part(p: Column) -> Column:
        called = F.to_json(F.struct(text_of(field(p, "name")).alias("name"), F.coalesce(field(p, "arguments"), F.parse_json(F.lit("{}"))).alias("arguments")))
        what = text_of(field(p, "type"))
        return F.when(what == "text", text_of(field(p, "text"))).when(what == "thinking", text_of(field(p, "thinking"))).when(what == "toolCall", called).otherwise(F.to_json(p))

    texts = F.filter(F.transform(listed(content), part), lambda t: clean_text(t) != "")
    return F.when(kind(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise(F.coalesce(F.array_join(texts, " "), F.lit("")))


def trace_calls(content: Column) -> Column:
    """Tool calls of a trace message as JSON texts, whether or not it has text."""
    parts = F.filter(listed(content), lambda p: text_of(field(p, "type")) == "toolCall")
    return F.coalesce(F.transform(parts, lambda p: F.to_json(F.struct(text_of(field(p, "id")).alias("id"), text_of(field(p, "name")).alias("name"), F.coalesce(field(p, "arguments"), F.parse_json(F.lit("{}"))).alias("arguments")))), F.expr("cast(array() as array<string>)"))


def fold_traces(lines: DataFrame) -> DataFrame:
    """One raw row per trace of event lines ``raw_object_key, raw_row_index, line``: ordered messages, calls and the last settings.

    A trace is gathered as one row, as the data model asks; its size is that of one agent session.
    """
    events = lines.withColumn("__e", F.try_parse_json("line")).where(F.col("__e").isNotNull())
    e = F.col("__e")
    events = segmented(events.withColumn("__type", text_of(field(e, "type"))), "raw_object_key", "raw_row_index", F.col("__type") == "session")
    payload = field(e, "message")
    role = text_of(field(payload, "role"))
    fits = (F.col("__type") == "message") & F.coalesce(kind(payload).startswith("OBJECT"), F.lit(False)) & role.isin("system", "user", "assistant", "tool")
    told = F.struct(F.col("raw_row_index"), role.alias("role"), part_texts(field(payload, "content")).alias("content"), trace_calls(field(payload, "content")).alias("calls"))

    def last(what: str, name: str) -> Column:
        return F.max_by(F.struct(F.when(has(e, name), text_of(field(e, name))).alias("v")), F.when(F.col("__type") == what, F.col("raw_row_index")))["v"]

    folded = events.groupBy("raw_object_key", "trace_index").agg(
        F.min("raw_row_index").alias("raw_row_index"), F.sort_array(F.collect_list("raw_row_index")).alias("raw_row_indexes"), F.count("*").alias("raw_event_count"),
        F.sort_array(F.collect_list(F.when(fits, told))).alias("__told"), last("session", "id").alias("raw_id"), last("session", "cwd").alias("cwd"),
        last("model_change", "modelId").alias("model_id"), last("thinking_level_change", "thinkingLevel").alias("thinking_level"),
    )
    items = F.transform("__told", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.lit("").alias("name")))
    messages = F.filter(F.transform(items, lambda m: F.struct(m["role"].alias("role"), clean_text(m["content"]).alias("content"), F.lit(None).cast("string").alias("name"))), lambda m: m["content"] != "").cast(M.MESSAGES)
    return folded.withColumn("messages", messages).withColumn("tool_calls", F.flatten(F.transform("__told", lambda m: m["calls"]))).withColumn("tools", F.expr("cast(array() as array<string>)")).drop("__told")
