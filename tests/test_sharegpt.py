import pytest

from millrace.operators import sharegpt

ROLES = {"human": ("user", None), "gpt": ("assistant", None), "function_call": ("assistant", "function_call"), "observation": ("tool", None), "system": ("system", None)}


def export(spark, *sides, tools=()):
    messages = [(ROLES[s][0], f"text {i}", ROLES[s][1]) for i, s in enumerate(sides)]
    df = spark.createDataFrame([("a", "s", messages, list(tools))], "id string, source_dataset string, messages array<struct<role:string,content:string,name:string>>, tools array<string>")
    return sharegpt.export_rows(df).first()


def sides(row):
    return [t["from"] for t in row.conversations]


@pytest.mark.parametrize("turns", [("human", "function_call"), ("human", "function_call", "observation", "gpt"), ("human", "gpt")])
def test_valid_turns(spark, turns):
    row = export(spark, *turns)
    assert row.error is None and row.repair is None and sides(row) == list(turns)


def test_trailing_observation_is_trimmed(spark):
    row = export(spark, "human", "gpt", "human", "function_call", "observation")
    assert (row.repair, row.error, sides(row)[-1]) == ("trimmed_trailing_observation", None, "function_call")


def test_trailing_human_is_trimmed(spark):
    row = export(spark, "human", "gpt", "human")
    assert (row.repair, row.error, sides(row)) == ("trimmed_trailing_human_turn", None, ["human", "gpt"])


def test_orphan_observation(spark):
    assert "not preceded by a function call" in export(spark, "human", "gpt", "observation", "gpt").error


def test_call_without_observation(spark):
    assert "not followed by an observation" in export(spark, "human", "function_call", "human", "gpt").error


def test_lone_human(spark):
    assert export(spark, "human").error == "no turns"


def test_canonical_record(spark):
    row = export(spark, "system", "human", "gpt", "human", "function_call", "observation", tools=['{"name":"f"}'])
    assert row.error is None and row.system == "text 0" and row.tools == '[{"name":"f"}]' and len(row.conversations) == 4


def test_tool_must_be_an_object(spark):
    assert export(spark, "human", "gpt", tools=["f"]).error == "a tool is not an object"


def test_failing_export_stops(spark):
    messages = [("tool", "x", None), ("assistant", "y", None)]
    df = spark.createDataFrame([("a", "s", messages, [])], "id string, source_dataset string, messages array<struct<role:string,content:string,name:string>>, tools array<string>")
    with pytest.raises(Exception, match="a: "):
        sharegpt.checked(sharegpt.export_rows(df)).collect()


def exported(spark, *turns, system=""):
    df = spark.createDataFrame([("a", "s", list(turns), system)], "id string, source_dataset string, conversations array<struct<from:string,value:string>>, system string")
    return sharegpt.prompt_and_label(df).first()


def test_prompt_has_tool_calls(spark):
    calls = '[{"name":"f","arguments":{"x":1}},{"name":"g","parameters":{"y":2}},{"name":"h"}]'
    row = exported(spark, ("human", "hi"), ("function_call", calls), ("observation", "3"), ("function_call", '{"name":"f"}'), ("observation", "4"), ("gpt", "done"), system=" be brief ")
    assert row.label == "done" and [m.role for m in row.prompt] == ["system", "user", "assistant", "tool", "assistant", "tool"]
    assert row.prompt[0].content == "be brief" and row.prompt[2].content == "" and row.prompt[1].tool_calls is None
    assert [(c.type, c.function.name, c.function.arguments) for c in row.prompt[2].tool_calls] == [("function", "f", '{"x":1}'), ("function", "g", '{"y":2}'), ("function", "h", "{}")]
    assert [c.function.name for c in row.prompt[4].tool_calls] == ["f"]
    assert exported(spark, ("human", "hi"), ("function_call", calls)).label == calls


def test_prompts_that_fail(spark):
    for turns, told in (((("human", "x"),), "end with the model"), ((), "end with the model"), ((("human", "x"), ("function_call", "no json"), ("gpt", "y")), "not JSON of calls"), ((("critic", "x"), ("gpt", "y")), "unknown side")):
        with pytest.raises(Exception, match=told):
            exported(spark, *turns)
