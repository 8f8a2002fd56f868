import json
import re
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions.text import clean_text, uuid5
from millrace.operators import audit, raw, records
from millrace.sources import scan


def adapt(spark, row, source="set"):
    df = spark.createDataFrame([(f"raw/dataset={source}/p.jsonl", 0, json.dumps(row))], "raw_object_key string, raw_row_index long, line string")
    got = raw.adapt_rows(df).first()
    return [(m.role, m.content, m.name) for m in got.messages], got.tools


def test_shapes(spark):
    assert adapt(spark, {"messages": [{"role": "human", "content": " a  b "}, {"from": "gpt", "value": "c"}]})[0] == [("user", "a b", None), ("assistant", "c", None)]
    assert adapt(spark, {"system": "s", "conversations": [{"from": "human", "value": "a"}]})[0] == [("system", "s", None), ("user", "a", None)]
    assert adapt(spark, {"query": "q", "answers": "[1]"}, "salesforce_xlam_function_calling_60k")[0] == [("user", "q", None), ("assistant", "[1]", "function_call")]
    assert adapt(spark, {"instruction": "i", "input": "x", "output": "o"})[0] == [("user", "i x", None), ("assistant", "o", None)]
    assert adapt(spark, {"else": 1})[0] == []


def test_roles_and_empty_messages(spark):
    rows = [{"role": "narrator", "content": ""}, {"role": "narrator", "content": "a"}, {"role": "narrator", "content": "b"}, {"role": "observation", "content": ""}, {"role": "tool_call", "content": "c"}]
    assert adapt(spark, {"messages": rows})[0] == [("user", "a", None), ("assistant", "b", None), ("tool", "{}", None), ("assistant", "c", "function_call")]


def test_tools(spark):
    assert adapt(spark, {"messages": [], "tools": '[{"name": "f"}]'})[1] == ['{"name":"f"}']
    assert adapt(spark, {"messages": [], "tools": [{"a": 1}, '[{"b": 2}, {"c": 3}]', "plain"]})[1] == ['{"a":1}', '{"b":2}', '{"c":3}', "plain"]
    assert adapt(spark, {"messages": [], "tools": ""})[1] == []


def test_traces(spark):
    events = [
        {"type": "message", "message": {"role": "user", "content": "before"}},
        {"type": "session", "id": "s1", "cwd": "/w"}, {"type": "model_change", "modelId": "m1"},
        {"type": "message", "message": {"role": "user", "content": [{"type": "text", "text": "hi"}, {"type": "thinking", "thinking": "hm"}]}},
        {"type": "message", "message": {"role": "assistant", "content": [{"type": "toolCall", "id": "1", "name": "ls", "arguments": {"p": "."}}]}},
        {"type": "model_change"}, {"type": "message", "message": {"role": "other", "content": "x"}}, {"type": "session"},
    ]
    df = spark.createDataFrame([("k", i, json.dumps(e)) for i, e in enumerate(events)], "raw_object_key string, raw_row_index long, line string")
    a, b, c = raw.fold_traces(df).orderBy("trace_index").collect()
    assert [m.content for m in a.messages] == ["before"] and a.raw_id is None
    assert [m.content for m in b.messages][0] == "hi hm" and b.cwd == "/w" and b.model_id is None and json.loads(b.tool_calls[0])["name"] == "ls"
    assert (c.raw_event_count, c.raw_row_indexes) == (1, [7])


def test_blank_lines_count(spark, tmp_path):
    (tmp_path / "dataset=x").mkdir()
    (tmp_path / "dataset=x" / "a.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    assert [r.raw_row_index for r in scan.numbered_lines(spark, str(tmp_path)).orderBy("raw_row_index").collect()] == [0, 2]
    large = scan.numbered_lines_large(spark, str(tmp_path / "dataset=x" / "a.jsonl"))
    assert sorted(r.raw_row_index for r in large.collect()) == [0, 2]


def test_uuid5(spark):
    names = ["", "a", "ü😀", "x" * 300]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", uuid5(F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n)) for r in got)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=20), min_size=30, max_size=30))
def test_clean_text(spark, texts):
    def model(t):
        return re.sub(r"\s+", " ", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", t)).strip()

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", clean_text(F.col("t")).alias("c")).collect()
    assert {r.i: r.c for r in rows} == {i: model(t) for i, t in enumerate(texts)}


def test_flags(spark):
    def record(i, messages, tools=(), source="s", version="sft.v1"):
        return (i, version, source, "sft", "general", [(r, c, None) for r, c in messages], list(tools), 0.8, None)

    from millrace.functions.schema import RECORD

    two = [("user", "a"), ("assistant", "b")]
    rows = [
        record("ok", two), record("blank", [("user", " "), ("assistant", "b")]), record("silent", [("user", "a"), ("user", "b")]), record("long", [("user", "a" * 24001), ("assistant", "b")]),
        record("edge", [("user", "a" * 23999), ("assistant", "b")]), record("toolong", [("user", "a" * 32001), ("assistant", "b")]), record("many", two * 33), record("tool", two, ["f"]), record("none", two, source="salesforce_apigen_mt_5k"),
    ]
    df = spark.createDataFrame(rows, RECORD).withColumn("meta", F.struct(F.lit("k").alias("raw_object_key")))
    got = {r.id: r.flags for r in audit.inspect(df).select("id", "flags").collect()}
    assert got == {
        "ok": [], "blank": ["empty_message"], "silent": ["missing_assistant", "invalid_turn_order"], "long": ["long_sample"], "edge": [], "toolong": ["too_long"], "many": ["too_many_messages"],
        "tool": ["unparsed_tool_definition"], "none": ["missing_tool_definition"],
    }


def test_sources(spark):
    df = spark.createDataFrame([("raw/dataset=nvidia_opencodeinstruct/x",), ("raw/x",)], "k string")
    source = raw.source_of(F.col("k"))
    got = [tuple(r) for r in df.select(source, records.task_family(source), records.domain(records.task_family(source))).collect()]
    assert got == [("nvidia_opencodeinstruct", "code_instruction", "code"), ("unknown", "sft", "general")]
