import json

import pytest
import yaml

from millrace import cli
from millrace.operators import mixture, scoring
from millrace.operators.adapter import chain, from_record_fn
from millrace.plans import layers
from millrace.sources import sink
from millrace.sources.catalog import Catalog, latest
from millrace.streaming import incremental


def raw_files(folder, n=40):
    at = folder / "raw" / "dataset=alpha"
    at.mkdir(parents=True)
    rows = [{"messages": [{"role": "user", "content": f"question {i % 35}"}, {"role": "assistant", "content": f"answer {i % 35}"}]} for i in range(n)] + [{"other": 1}]
    (at / "part-000000.jsonl").write_text("\n".join(map(json.dumps, rows)))
    trace = folder / "raw" / "dataset=glint_fable_5_traces"
    trace.mkdir()
    events = [e for s in range(4) for e in ({"type": "session", "id": f"s{s}"}, {"type": "message", "message": {"role": "user", "content": f"do {s}"}}, {"type": "message", "message": {"role": "assistant", "content": f"done {s}"}})]
    (trace / "part-000000.jsonl").write_text("\n".join(map(json.dumps, events)))
    return str(folder / "raw")


def test_all_layers(spark, tmp_path):
    layout = layers.Layout(str(tmp_path / "lake"))
    manifest = layers.clean(spark, [raw_files(tmp_path)], layout, "r1")
    assert manifest["record_count"] == 39 and manifest["dropped"] == {"duplicate": 5, "too_few_messages": 1}
    with pytest.raises(FileExistsError):
        layers.clean(spark, [str(tmp_path / "raw")], layout, "r1")
    report = layers.audit_layer(spark, layout, "r1")
    assert report["status"] == "passed" and report["records"] == 39
    config = mixture.MixtureConfig({"alpha": 20, "glint_fable_5_traces": 2}, 0.1, 8)
    with pytest.raises(ValueError, match="review"):
        layers.gold(spark, layout, "r1", config)
    layers.gold(spark, layout, "r1", config, review_approved=True)
    gold = spark.read.parquet(layout.at("gold", "r1"))
    split = {(r.source_dataset, r.split): r["count"] for r in gold.groupBy("source_dataset", "split").count().collect()}
    assert split == {("alpha", "train"): 18, ("alpha", "validation"): 2, ("glint_fable_5_traces", "train"): 1, ("glint_fable_5_traces", "validation"): 1}
    assert gold.where("shard = 0 AND split = 'train'").count() == 8
    assert layers.export(spark, layout, "r1")["records"] == 22
    assert layers.build_holdout(spark, layout, "r1", {"alpha": 10}) == 10


def test_cli_and_manifest(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"raw": [raw_files(tmp_path)], "root": str(tmp_path / "lake"), "run_id": "x"}))
    out = cli.main(["clean", "--config", str(tmp_path / "c.yaml")])
    folder = str(tmp_path / "lake" / "silver" / "x")
    sink.verify(spark, folder, out)
    with pytest.raises(ValueError):
        sink.verify(spark, folder, {"files": []})


def test_same_result_under_other_partitions(spark, tmp_path):
    layout = layers.Layout(str(tmp_path / "lake"))
    layers.clean(spark, [raw_files(tmp_path)], layout, "r1")
    layers.audit_layer(spark, layout, "r1")
    rows = spark.read.parquet(layout.at("inspected", "r1"))
    config = mixture.MixtureConfig({"alpha": 9}, 0.3, 4)
    found = []
    for n in ("1", "4", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted((r.id, r.split, r.position) for r in mixture.shuffled_shards(mixture.gold_mixture(rows.repartition(int(n)), config), config).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2] and len(found[0]) == 9


def test_ratio_targets():
    assert mixture.ratio_targets({"a": 100, "b": 5}, {"a": 2, "b": 1}, 30) == {"a": 20, "b": 5}


def judge(spark, predict, label='{"name": "f", "arguments": {"a": 1}}'):
    df = spark.createDataFrame([("1", "s", predict, label)], "id string, source_dataset string, predict string, label string")
    r = scoring.judged(df).first()
    return r.json_valid, r.wrapper_valid, r.count_exact, r.names_exact, r.arguments_exact


def test_scoring(spark):
    yes, no = True, False
    assert judge(spark, '{"name": "f", "arguments": {"a": 1}}') == (yes, no, yes, yes, yes)
    assert judge(spark, '<tool_call>{"arguments": {"a": 1}, "name": "f"}</tool_call>') == (yes, yes, yes, yes, yes)
    assert judge(spark, '[{"name": "f", "parameters": "{\\"a\\": 1}"}]') == (yes, no, yes, yes, yes)
    assert judge(spark, '<tool_call>\n```json\n{"name": "g", "arguments": {"a": 1}}\n```\n</tool_call>') == (yes, yes, yes, no, no)
    assert judge(spark, '<tool_call>{"name": "f"}</tool_call><tool_call>oops</tool_call>') == (no, no, no, no, no)
    assert judge(spark, "[]") == (yes, no, no, no, no)
    assert judge(spark, "plain words") == (no, no, no, no, no)
    with pytest.raises(Exception, match="label is not a tool call"):
        judge(spark, "x", "not json")


def test_no_predictions(spark):
    df = spark.createDataFrame([], "id string, source_dataset string, predict string, label string")
    r = scoring.score(scoring.judged(df)).first()
    assert r.total == 0 and r.json_valid_rate is None


def test_catalog(spark, tmp_path):
    from datetime import datetime

    book = Catalog(spark, str(tmp_path))
    book.append("dataset_versions", [{"id": f"v{i}", "status": "ready", "created_at": datetime(2026, 1, i + 1)} for i in range(7)])
    book.append("dataset_files", [{"id": "f", "dataset_version_id": "v1", "size_bytes": 5}])
    book.set_status("v1", "retired", datetime(2026, 2, 1))
    book.delete_version("v2")
    assert [r.id for r in latest(book.table("dataset_versions")).collect()] == ["v6", "v5", "v4", "v3", "v1"]
    assert book.table("dataset_versions").where("id = 'v1'").first().status == "retired"
    assert book.table("pipeline_runs").count() == 0


def test_record_functions(spark):
    op = chain(from_record_fn(lambda r: r if r["n"] % 2 else None), from_record_fn(lambda r: {"m": r["n"] * 10}, "m long"))
    assert sorted(r.m for r in op(spark.range(5).withColumnRenamed("id", "n")).collect()) == [10, 30]


def test_stream(spark, tmp_path):
    raw_files(tmp_path)
    lines = incremental.raw_stream(spark, str(tmp_path / "raw" / "dataset=alpha"))
    name = "silver_stream_test"
    running = incremental.silver_stream(lines).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        running.processAllAvailable()
        assert spark.table(name).count() == 35
    finally:
        running.stop()
