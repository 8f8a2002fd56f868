"""The layers end to end: raw to bronze and silver, audit, gold, export, holdout."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, mixture, sharegpt
from ..operators.clean import CleanConfig, bronze, drop_counts, silver
from ..operators.raw import adapt_rows, fold_traces
from ..operators.records import with_record_columns
from ..sources import scan, sink

TRACE_SOURCES = ("glint_fable_5_traces",)


def raw_records(spark: SparkSession, *paths: str) -> DataFrame:
    """Canonical records of raw JSON lines: trace sources are folded, other rows adapted."""
    lines = scan.numbered_lines(spark, *paths)
    is_trace = F.col("raw_object_key").rlike("dataset=(?:" + "|".join(TRACE_SOURCES) + ")/")
    plain, traces = adapt_rows(lines.where(~is_trace)), fold_traces(lines.where(is_trace))
    return with_record_columns(plain).unionByName(with_record_columns(traces))


@dataclass(frozen=True)
class Layout:
    root: str

    def at(self, layer: str, run: str) -> str:
        return f"{self.root}/{layer}/{run}"


def clean(spark: SparkSession, raw: list[str], layout: Layout, run: str, config: CleanConfig = CleanConfig(), overwrite: bool = False) -> dict:
    """Write bronze and silver as Parquet and their manifest; the raw text is parsed once."""
    for layer in ("bronze", "silver"):
        sink.guard(spark, layout.at(layer, run), overwrite)
    mode = "overwrite" if overwrite else "errorifexists"
    records = raw_records(spark, *raw)
    staged = layout.at("staged", run)
    records.write.mode("overwrite").parquet(staged)
    records = spark.read.parquet(staged)
    bronze(records, config).write.mode(mode).parquet(layout.at("bronze", run))
    silver(spark.read.parquet(layout.at("bronze", run))).write.mode(mode).parquet(layout.at("silver", run))
    drops = {r.reason: r.n for r in drop_counts(records, config).collect()}
    manifest = sink.manifest_of(spark, layout.at("silver", run), {"run_id": run, "layer": "silver", "dropped": drops})
    manifest["record_count"] = spark.read.parquet(layout.at("silver", run)).count()
    sink.write_json(spark, f"{layout.at('manifests', run)}/silver.json", manifest)
    return manifest


def audit_layer(spark: SparkSession, layout: Layout, run: str, policy: audit.AuditPolicy = audit.AuditPolicy()) -> dict:
    """Inspect silver once, write the inspected table, and report on it."""
    audit.inspect(spark.read.parquet(layout.at("silver", run)), policy).write.mode("overwrite").parquet(layout.at("inspected", run))
    inspected = spark.read.parquet(layout.at("inspected", run))
    verdict = audit.gate(inspected, policy).first()
    profile, flags = audit.source_profile(inspected, policy).collect(), audit.flag_counts(inspected).collect()
    audit.review_rows(inspected, policy).write.mode("overwrite").json(layout.at("review", run))
    manifest = sink.read_json(spark, f"{layout.at('manifests', run)}/silver.json")
    report = {"status": verdict.status, "records": verdict.records, "blocked": verdict.blocked, "blocked_fraction": verdict.blocked_fraction, "silver_sha256": manifest["sha256"], "sources": [r.asDict() for r in profile], "flags": {r.flag: r.n for r in flags}}
    sink.write_json(spark, f"{layout.at('reports', run)}/audit.json", {**report, "markdown": audit.markdown_report(profile, flags, verdict)})
    return report


def gold(spark: SparkSession, layout: Layout, run: str, config: mixture.MixtureConfig, review_approved: bool = False, smoke: bool = False, overwrite: bool = False) -> dict:
    """Admit silver, sample, split, shuffle and shard it."""
    report = sink.read_json(spark, f"{layout.at('reports', run)}/audit.json")
    manifest = sink.read_json(spark, f"{layout.at('manifests', run)}/silver.json")
    if errors := mixture.admission_errors(report, manifest, review_approved, smoke):
        raise ValueError("; ".join(errors))
    inspected = spark.read.parquet(layout.at("inspected", run))
    mixture.check_available(inspected.where("NOT blocking"), config.targets)
    placed = mixture.shuffled_shards(mixture.gold_mixture(inspected, config), config)
    sink.write_shards(placed, layout.at("gold", run), "parquet", overwrite)
    summary = [r.asDict() for r in mixture.mixture_summary(inspected, spark.read.parquet(layout.at("gold", run))).collect()]
    out = {"run_id": run, "seed": config.seed, "sources": summary, "silver_sha256": manifest["sha256"]}
    sink.write_json(spark, f"{layout.at('manifests', run)}/gold.json", out)
    return out


def export(spark: SparkSession, layout: Layout, run: str, overwrite: bool = False) -> dict:
    """Training turns of gold as JSON lines; any record that can't be repaired fails the export before a file is written."""
    sink.guard(spark, layout.at("export", run), overwrite)
    rows = sharegpt.export_rows(spark.read.parquet(layout.at("gold", run)))
    stats = sharegpt.export_stats(rows).first()
    if stats.valid != stats.records:
        bad = rows.where("error IS NOT NULL").select("id", "error").take(3)
        raise ValueError(f"{stats.records - stats.valid} records can't be exported, such as {[tuple(r) for r in bad]}")
    written = {}
    want = {r.split: r.n for r in spark.read.parquet(layout.at("gold", run)).groupBy("split").agg(F.count("*").alias("n")).collect()}
    for split in ("train", "validation"):
        rows.where(F.col("split") == split).select("id", "source_dataset", "conversations", "system", "tools").write.mode("overwrite" if overwrite else "errorifexists").json(f"{layout.at('export', run)}/{split}")
        written[split] = spark.read.text(f"{layout.at('export', run)}/{split}").count()
    if differing := {k: (want.get(k, 0), n) for k, n in written.items() if n != want.get(k, 0)}:
        raise ValueError(f"gold and exported records by split differ: {differing}")
    out = {**stats.asDict(), "splits": written, "repairs": {r.repair: r.n for r in sharegpt.repair_counts(rows).collect()}, "descriptor": sink.dataset_descriptor({s: f"{s}.jsonl" for s in ("train", "validation")})}
    sink.write_json(spark, f"{layout.at('manifests', run)}/export.json", out)
    return out


def build_holdout(spark: SparkSession, layout: Layout, run: str, targets: Mapping[str, int], overwrite: bool = False) -> int:
    """Holdout turns from what gold left of silver, disjoint from it."""
    sink.guard(spark, layout.at("holdout", run), overwrite)
    inspected, chosen = spark.read.parquet(layout.at("inspected", run)), spark.read.parquet(layout.at("gold", run))
    held = mixture.holdout(inspected, chosen, targets)
    mixture.assert_disjoint(held, chosen)
    rows = sharegpt.checked(sharegpt.export_rows(held)).drop("error", "repair")
    rows.write.mode("overwrite" if overwrite else "errorifexists").json(layout.at("holdout", run))
    return spark.read.json(layout.at("holdout", run)).count()
