"""Ingest: a bounded sample of a dataset to one raw JSON lines file, with its manifest and catalog rows."""

from __future__ import annotations

import datetime
import uuid
from dataclasses import MISSING, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scan, sink
from ..sources.catalog import Catalog


@dataclass(frozen=True)
class IngestConfig:
    dataset_id: str
    source: str
    task_family: str
    license: str
    split: str
    raw_bucket: str  # a folder, or a store's address
    raw_prefix: str
    config_name: str | None = None
    data_files: str | list[str] | None = None
    revision: str = "main"
    streaming: bool = True
    shuffle: bool = True
    sample_size: int = 1000
    seed: int = 42
    shuffle_buffer_size: int = 10_000
    shard_filename: str = "part-000000.jsonl"
    manifest_filename: str = "manifest.json"
    schema_target: str = "raw.v1"
    format: str = "json"

    @property
    def folder(self) -> str:
        return f"{self.raw_bucket.rstrip('/')}/{self.raw_prefix.strip('/')}"


def ingest_config(given: dict) -> IngestConfig:
    """A configuration with its defaults; absent required fields and unknown ones are named in the error."""
    known = {f.name for f in fields(IngestConfig)}
    absent = sorted(f.name for f in fields(IngestConfig) if f.default is MISSING and f.name not in given)
    if absent:
        raise ValueError(f"required fields are absent: {', '.join(absent)}")
    return IngestConfig(**{k: v for k, v in given.items() if k in known})


def sampled(df: DataFrame, config: IngestConfig) -> DataFrame:
    """``sample_size`` rows: in a reproducible pseudo-random order of their content, or the first in order of their JSON text."""
    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")
    lines = df.select(line)
    order = [F.xxhash64(F.lit(config.seed), "value")] if config.shuffle else []
    return lines.orderBy(*order, "value").limit(config.sample_size)


def ingest(spark: SparkSession, given: dict, catalog_folder: str | None = None, overwrite: bool = False) -> dict:
    """Read ``data_files`` (else ``dataset_id``) as ``format``, write the sample as one file and verify it; returns the manifest.

    The file is written beside its place under a partial name, compared with the rows that were meant to
    be in it, and only then renamed: a crash leaves no file that looks whole.
    """
    config = ingest_config(given)
    target, at = f"{config.folder}/{config.shard_filename}", f"{config.folder}/{config.manifest_filename}"
    sink.guard(spark, target, overwrite)
    rows = sampled(scan.read_any(spark, config.data_files or config.dataset_id, config.format), config)
    facts = sink.publish_text(rows, target)
    now, version = datetime.datetime.now(datetime.timezone.utc), str(uuid.uuid4())
    told = ("dataset_id", "config_name", "data_files", "source", "task_family", "license", "split", "revision", "streaming", "shuffle", "sample_size", "schema_target")
    manifest = {"dataset_version_id": version, **{name: getattr(config, name) for name in told}, "actual_record_count": facts["record_count"]}
    manifest |= {"raw_path": config.folder, "manifest_path": at, "created_at": now.isoformat(), "files": [{"bucket": config.raw_bucket, "object_key": target, **facts}]}
    sink.write_json(spark, at, manifest)
    if catalog_folder:
        catalog = Catalog(spark, catalog_folder)
        run = {"id": str(uuid.uuid4()), "run_type": "ingest", "status": "succeeded", "config_json": sink.compact_json(given), "started_at": now, "finished_at": datetime.datetime.now(datetime.timezone.utc)}
        shown = {name: getattr(config, name) for name in ("dataset_id", "source", "task_family", "license", "sample_size")}
        catalog.append("pipeline_runs", [run])
        catalog.append("dataset_versions", [{"id": version, **shown, "raw_path": config.folder, "manifest_path": at, "status": "raw", "created_at": now, "updated_at": now}])
        catalog.append("dataset_files", [{"id": str(uuid.uuid4()), "dataset_version_id": version, "object_key": target, "created_at": now, **facts}])
    return manifest
