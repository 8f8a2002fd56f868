"""Seeded selections against plain Python, ingest, partial files, slices, checksums and strict JSON."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import strict_json
from millrace.operators import seeded
from millrace.plans import ingest
from millrace.sources import scan, sink


def salted(seed, salt):
    return random.Random(seed + int.from_bytes(hashlib.sha256(salt.encode()).digest()[:8], "big"))


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"id{i * 37 % 500:03}", "ab"[i % 3 == 0], i) for i in range(500)]
    return data, spark.createDataFrame(data, "id string, source_dataset string, n long").repartition(7)


def test_places_in_groups(spark, rows):
    data, df = rows
    want = {r[0]: k for s in "ab" for k, r in enumerate(sorted(x for x in data if x[1] == s))}
    assert {r.id: r.nth for r in seeded.numbered(df, "source_dataset", "id").collect()} == want
    assert seeded.numbered(df.limit(0), "source_dataset", "id").count() == 0
    odd = spark.createDataFrame([("x", None), ("y", None), ("x", "s"), (None, "s")], "id string, source_dataset string")
    assert sorted((r.source_dataset or "", r.nth) for r in seeded.numbered(odd, "source_dataset", "id").collect()) == [("", 0), ("", 1), ("s", 0), ("s", 1)]


def test_sample_is_that_of_the_generator(rows):
    data, df = rows
    got = seeded.seeded_sample(df, {"a": 20, "b": 31}, 20260710, "select:{}").orderBy("drawn").collect()
    for s, n in (("a", 20), ("b", 31)):
        want = salted(20260710, f"select:{s}").sample(sorted(x for x in data if x[1] == s), n)
        assert [tuple(r)[:3] for r in got if r.source_dataset == s] == want
    with pytest.raises(ValueError, match="asked for"):
        seeded.seeded_sample(df, {"a": 501}, 1, "select:{}")
    few = seeded.seeded_sample(df, {"a": 501, "b": 2}, 1, "source:{}", order=("n",), whole=True).collect()
    assert sum(r.source_dataset == "a" for r in few) == sum(x[1] == "a" for x in data)
    assert [r.n for r in sorted(few, key=lambda r: r.drawn) if r.source_dataset == "b"] == [x[2] for x in salted(1, "source:b").sample([x for x in data if x[1] == "b"], 2)]


def test_shuffle_is_that_of_the_generator(rows):
    data, df = rows
    want = sorted(data)
    salted(5, "train:all-sources").shuffle(want)
    got = seeded.seeded_shuffle(df, 5, "train:all-sources", "id").orderBy("position").collect()
    assert [r.id for r in got] == [x[0] for x in want]
    assert seeded.seeded_shuffle(df.limit(0), 5, "x", "id").count() == 0


def test_slices(spark):
    df = spark.createDataFrame([(i,) for i in [*range(10), None]], "id long")
    assert [r.id for r in scan.id_range(df, "id", 2, 5).orderBy("id").collect()] == [2, 3, 4]
    assert [r.id for r in scan.id_list(df, "id", [3, 99, 0]).orderBy("id").collect()] == [0, 3]
    assert scan.id_list(df, "id", []).count() == 0


def test_payload_checksum():
    assert sink.payload_sha256({"b": [1, None], "a": "é"}) == hashlib.sha256('{"a":"é","b":[1,null]}'.encode()).hexdigest()


def test_strict_json(spark):
    df = spark.createDataFrame([('{"a": [1]}',), (None,)], "label string")
    assert [r.v for r in df.select(strict_json(F.col("label"), "label").cast("string").alias("v")).collect()] == ['{"a":[1]}', None]
    with pytest.raises(Exception, match="invalid JSON in label"):
        spark.createDataFrame([("{oops",)], "label string").select(strict_json(F.col("label"), "label").cast("string")).collect()


def test_published_file(spark, tmp_path):
    df = spark.createDataFrame([(f"line {i}",) for i in range(30)], "value string").repartition(5)
    target = f"{tmp_path}/deep/all.jsonl"
    facts = sink.publish_text(df.orderBy("value"), target)
    body = open(target, "rb").read()
    assert body.decode().splitlines() == sorted(f"line {i}" for i in range(30))
    assert facts == {"size_bytes": len(body), "sha256": hashlib.sha256(body).hexdigest(), "record_count": 30}
    assert sorted(p.name for p in (tmp_path / "deep").iterdir() if not p.name.endswith(".crc")) == ["all.jsonl"]
    copy = f"{tmp_path}/copy.jsonl"
    assert sink.materialize(spark, target, copy, facts["sha256"], 30) == facts and open(copy, "rb").read() == body
    for wrong in ({"sha256": "0" * 64}, {"record_count": 29}):
        with pytest.raises(ValueError, match="differs"):
            sink.materialize(spark, target, f"{tmp_path}/bad.jsonl", **wrong)
    assert not (tmp_path / "bad.jsonl").exists() and not (tmp_path / "bad.jsonl.partial").exists()


def test_ingest(spark, tmp_path):
    spark.range(50).select("id", F.lit(None).cast("string").alias("note")).write.json(f"{tmp_path}/in")
    given = {"dataset_id": "d", "source": "s", "task_family": "sft", "license": "mit", "split": "train", "raw_bucket": str(tmp_path), "raw_prefix": "raw/", "data_files": f"{tmp_path}/in", "sample_size": 20}
    with pytest.raises(ValueError, match="license, split"):
        ingest.ingest_config({k: v for k, v in given.items() if k not in ("license", "split")})
    assert (ingest.ingest_config(given).revision, ingest.ingest_config(given).shuffle, ingest.ingest_config(given).seed) == ("main", True, 42)
    manifest = ingest.ingest(spark, given, f"{tmp_path}/catalog")
    lines = [json.loads(x) for x in open(f"{tmp_path}/raw/part-000000.jsonl")]
    assert len({x["id"] for x in lines}) == 20 == manifest["actual_record_count"] == manifest["files"][0]["record_count"]
    assert json.load(open(f"{tmp_path}/raw/manifest.json"))["files"] == manifest["files"]
    versions = ingest.Catalog(spark, f"{tmp_path}/catalog").table("dataset_versions").collect()
    assert [(r.id, r.status) for r in versions] == [(manifest["dataset_version_id"], "raw")]
    with pytest.raises(FileExistsError):
        ingest.ingest(spark, given)
    ingest.ingest(spark, given, overwrite=True)
    assert [json.loads(x) for x in open(f"{tmp_path}/raw/part-000000.jsonl")] == lines
