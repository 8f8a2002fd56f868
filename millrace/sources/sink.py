"""Sinks: sharded JSON lines and Parquet, manifests, verification, overwrite guards."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.alike import cut_lineage
from .scan import path_exists


def guard(spark: SparkSession, path: str, overwrite: bool) -> None:
    if not overwrite and path_exists(spark, path):
        raise FileExistsError(f"{path} exists; ask for overwriting to replace it")


def write_shards(df: DataFrame, path: str, kind: str = "json", overwrite: bool = False, per_file: int | None = None) -> None:
    """Rows with ``split, shard`` to ``split=/shard=`` folders, one task a shard, in ``position`` order where there is one."""
    guard(df.sparkSession, path, overwrite)
    keys = ["split", "shard"]
    laid = df.repartition(*keys).sortWithinPartitions(*keys, *(["position"] if "position" in df.columns else []))
    writer = laid.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*keys)
    writer = writer.option("maxRecordsPerFile", per_file) if per_file else writer
    writer = writer.option("ignoreNullFields", False) if kind == "json" else writer.option("compression", "zstd")
    writer.format(kind).save(path)


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """``file, size_bytes, sha256, record_count`` of every file written under a path, read back as bytes."""
    return facts_of(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path))


def facts_of(files: DataFrame) -> DataFrame:
    lines = F.size(F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: F.trim(x) != "")).cast("long")
    return files.select(F.col("path").alias("file"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), lines.alias("record_count"))


def manifest_of(spark: SparkSession, path: str, facts: Mapping) -> dict:
    """A manifest of the files under a path; a row per file is what comes to the driver."""
    files = [r.asDict() for r in file_facts(spark, path).orderBy("file").collect()]
    return {**facts, "files": files, "record_count": sum(f["record_count"] for f in files), "sha256": hashlib.sha256("\n".join(f["sha256"] for f in files).encode()).hexdigest()}


def write_json(spark: SparkSession, path: str, value: Mapping) -> None:
    """One JSON document, keys in order, through whatever store the path names."""
    text = json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, default=str)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(conf).create(p, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def compact_json(value: Any) -> str:
    """JSON text without blanks, keys in order, letters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)


def payload_sha256(value: Any) -> str:
    return hashlib.sha256(compact_json(value).encode()).hexdigest()


def _store(spark: SparkSession, path: str):
    """A path's file system, a function from text to its paths, and the configuration."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(conf), at, conf


def _finish(spark: SparkSession, partial: str, target: str, sha256: str | None, record_count: int | None) -> dict:
    """Compare a partial file with what is known of it and give it its name; one that differs is deleted."""
    files, at, _ = _store(spark, target)
    facts = facts_of(spark.read.format("binaryFile").load(partial)).drop("file").first().asDict()
    want = {k: v for k, v in (("sha256", sha256), ("record_count", record_count)) if v is not None}
    if differing := {k: (facts[k], v) for k, v in want.items() if facts[k] != v}:
        files.delete(at(partial), False)
        raise ValueError(f"{target} differs from what was told (found, told): {differing}")
    files.delete(at(target), False)
    if not files.rename(at(partial), at(target)):
        raise OSError(f"{partial} could not be renamed")
    return facts


def materialize(spark: SparkSession, source: str, target: str, sha256: str | None = None, record_count: int | None = None) -> dict:
    """Copy one file under a partial name, verify bytes and lines that are not blank, then rename it; returns its facts."""
    (origin, at, conf), partial = _store(spark, source), f"{target}.partial"
    files, _, _ = _store(spark, target)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(origin, at(source), files, at(partial), False, True, conf)
    return _finish(spark, partial, target, sha256, record_count)


def publish_text(df: DataFrame, target: str) -> dict:
    """A one-column table as one text file, under a partial name until it holds as many lines as the table has; returns its facts.

    One task writes the file: for samples of a configured size. A table of one partition keeps its order.
    """
    spark, parts, partial = df.sparkSession, f"{target}.parts", f"{target}.partial"
    df = cut_lineage(df)  # counted and written alike
    df.coalesce(1).write.mode("overwrite").text(parts)
    files, at, _ = _store(spark, target)
    written = next(s.getPath() for s in files.listStatus(at(parts)) if s.getPath().getName().startswith("part-"))
    files.delete(at(partial), False)
    files.rename(written, at(partial))
    files.delete(at(parts), True)
    return _finish(spark, partial, target, None, df.where(F.trim(F.col(df.columns[0])) != "").count())


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def verify(spark: SparkSession, path: str, manifest: Mapping) -> None:
    """Fail unless the files under a path are those of the manifest, byte by byte."""
    have = {r.file.rsplit("/", 1)[-1]: (r.sha256, r.record_count) for r in file_facts(spark, path).collect()}
    want = {f["file"].rsplit("/", 1)[-1]: (f["sha256"], f["record_count"]) for f in manifest["files"]}
    if have != want:
        raise ValueError(f"files differ from the manifest: {sorted(set(have.items()) ^ set(want.items()))[:4]}")


def dataset_descriptor(names: Mapping[str, str]) -> dict:
    """How a trainer finds each exported file and its columns."""
    columns = {"messages": "conversations", "system": "system", "tools": "tools"}
    return {name: {"file_name": file, "formatting": "sharegpt", "columns": columns} for name, file in names.items()}
