"""Stratified samples, splits, shuffles, shards, and the gold mixture."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rank_key, sha256


@dataclass(frozen=True)
class MixtureConfig:
    targets: Mapping[str, int] = field(default_factory=dict)
    validation_fraction: float = 0.05
    records_per_shard: int = 1000
    seed: int = 20260710


def targets_frame(df: DataFrame, targets: Mapping[str, int]) -> DataFrame:
    """The configured targets: as many rows as the configuration has."""
    return df.sparkSession.createDataFrame(sorted(targets.items()), "source_dataset string, target int")


def stratified_sample(df: DataFrame, targets: Mapping[str, int], seed: int, purpose: str) -> DataFrame:
    """``targets[source]`` rows of each source in a reproducible pseudo-random order; adds ``sample_rank`` and ``target``."""
    order = Window.partitionBy("source_dataset").orderBy(rank_key(seed, purpose, F.col("source_dataset"), F.col("id")), "id")
    joined = df.join(F.broadcast(targets_frame(df, targets)), "source_dataset")  # bounded by the configuration
    most = max(targets.values(), default=0)
    return joined.withColumn("sample_rank", F.row_number().over(order)).where(F.col("sample_rank") <= most).where(F.col("sample_rank") <= F.col("target"))


def check_available(df: DataFrame, targets: Mapping[str, int]) -> None:
    """Fail where a source has fewer rows than its target."""
    have = {r.source_dataset: r.n for r in df.where(F.col("source_dataset").isin(*targets)).groupBy("source_dataset").agg(F.count("*").alias("n")).collect()}
    short = {s: (have.get(s, 0), t) for s, t in targets.items() if have.get(s, 0) < t}
    if short:
        raise ValueError(f"sources with fewer rows than asked for (have, asked): {short}")


def split_selection(selected: DataFrame, config: MixtureConfig) -> DataFrame:
    """Adds ``split``: of each source's target the fraction (halves to even; one at least) is validation, the rest train.

    The sample's own order is pseudo-random, so its first ranks are the validation sample and no second
    shuffle is needed.
    """
    share = F.bround(F.col("target") * F.lit(config.validation_fraction), 0).cast("int")
    size = F.when((F.lit(config.validation_fraction) > 0) & (F.col("target") > 1), F.greatest(share, F.lit(1))).otherwise(share)
    return selected.withColumn("split", F.when(F.col("sample_rank") <= size, "validation").otherwise("train"))


def gold_mixture(inspected: DataFrame, config: MixtureConfig) -> DataFrame:
    """Eligible records, sampled by source and split."""
    eligible = inspected.where("NOT blocking").drop("metrics", "flags", "blocking", "schema_errors")
    return split_selection(stratified_sample(eligible, config.targets, config.seed, "selection"), config).drop("sample_rank", "target")


def shuffled_shards(df: DataFrame, config: MixtureConfig, chunks: int = 256) -> DataFrame:
    """Adds ``position`` (within the split, in a pseudo-random order) and ``shard`` (contiguous slices of it).

    Positions are ranks within ``chunks`` slices of the hash order, shifted by the counts before: no
    task holds a whole split.
    """
    key = rank_key(config.seed, "shuffle", F.col("split"), F.col("id"))
    keyed = df.withColumn("__key", key).withColumn("__chunk", (F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * chunks / F.lit(1 << 32)).cast("int"))
    counts = keyed.groupBy("split", "__chunk").count()
    before = counts.select("split", "__chunk", F.coalesce(F.sum("count").over(Window.partitionBy("split").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    order = Window.partitionBy("split", "__chunk").orderBy("__key", "id")
    ranked = keyed.withColumn("__nth", F.row_number().over(order) - 1).join(F.broadcast(before), ["split", "__chunk"])  # splits x chunks rows
    placed = ranked.withColumn("position", (F.col("__before") + F.col("__nth")).cast("long"))
    return placed.withColumn("shard", F.floor(F.col("position") / config.records_per_shard).cast("int")).drop("__key", "__chunk", "__before", "__nth")


def mixture_summary(inspected: DataFrame, gold: DataFrame) -> DataFrame:
    """Available, selected, train and validation rows by source."""
    have = inspected.where("NOT blocking").groupBy("source_dataset").agg(F.count("*").alias("available"))
    took = gold.groupBy("source_dataset").agg(F.count("*").alias("selected"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "validation").alias("validation"))
    return have.join(took, "source_dataset", "left").na.fill(0, ["selected", "train", "validation"])


def selection_fingerprint(df: DataFrame) -> DataFrame:
    """One row: the number of ids, the SHA-256 of the sorted ids, and an order-free fingerprint that needs no gathering.

    The first is the manifest's contract over a selection of configured size; over data of any size use
    the second, a sum of hashes.
    """
    joined = sha256(F.array_join(F.sort_array(F.collect_list("id")), "\n"))
    free = F.sum(F.conv(F.substring(sha256(F.col("id")), 1, 12), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("records"), joined.alias("sorted_sha256"), F.coalesce(free, F.lit(0)).cast("string").alias("sum_fingerprint"))


def ratio_targets(available: Mapping[str, int], weights: Mapping[str, float], total: int) -> dict[str, int]:
    """Targets in the ratio of ``weights`` (largest remainders first), never more than there is."""
    whole = sum(weights.values())
    exact = {s: total * w / whole for s, w in weights.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: total - sum(out.values())]:
        out[s] += 1
    return {s: min(n, available.get(s, 0)) for s, n in out.items()}


def admission_errors(report: Mapping, manifest: Mapping, review_approved: bool, smoke: bool = False) -> list[str]:
    """Why a silver layer may not become gold; empty if it may."""
    errors = []
    if report.get("status") == "failed":
        errors.append("the audit gate failed")
    if report.get("silver_sha256") != manifest.get("sha256"):
        errors.append("the report is of another silver layer")
    if not (review_approved or smoke):
        errors.append("the manual review isn't approved")
    return errors


def holdout(inspected: DataFrame, gold: DataFrame, targets: Mapping[str, int], seed: int = 20260712) -> DataFrame:
    """Eligible records that gold doesn't have, sampled by source."""
    rest = inspected.where("NOT blocking").join(gold.select("id"), "id", "left_anti").drop("metrics", "flags", "blocking", "schema_errors")
    return stratified_sample(rest, targets, seed, "holdout").drop("sample_rank", "target")


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids of both sides; a holdout must have none in common with gold."""
    return left.select("id").join(right.select("id"), "id", "left_semi").distinct()


def assert_disjoint(left: DataFrame, right: DataFrame) -> None:
    if met := overlap(left, right).take(5):
        raise ValueError(f"ids on both sides: {[r.id for r in met]}")
