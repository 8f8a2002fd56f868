"""Inspection, per-source profiles, gate and review queue."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions.schema import is_object, schema_errors
from ..functions.text import rank_key, sha256

FLAGS = ("schema_error", "empty_message", "missing_assistant", "invalid_turn_order", "too_long", "long_sample", "too_many_messages", "unparsed_tool_definition", "missing_tool_definition")


@dataclass(frozen=True)
class AuditPolicy:
    max_chars: int = 32_000
    long_chars: int = 24_000
    max_messages: int = 64
    tool_sources: tuple[str, ...] = ("salesforce_xlam_function_calling_60k", "salesforce_apigen_mt_5k")
    blocking: tuple[str, ...] = ("schema_error", "empty_message", "missing_assistant", "invalid_turn_order", "too_long", "too_many_messages", "unparsed_tool_definition")
    zero_tolerance: tuple[str, ...] = ("schema_error", "empty_message")
    max_blocked_fraction: float = 0.01
    seed: int = 20260710
    per_source: int = 5
    per_flag: int = 5
    top_sequences: int = 5
    quantiles: dict[str, float] = field(default_factory=lambda: {"p50": 0.5, "p90": 0.9, "p99": 0.99})


def inspect(records: DataFrame, policy: AuditPolicy = AuditPolicy()) -> DataFrame:
    """Records with ``metrics``, ``flags`` (in fixed order), ``blocking`` and the first five ``schema_errors``; no shuffle."""
    m, tools = F.col("messages"), F.coalesce(F.col("tools"), F.expr("cast(array() as array<string>)"))
    parsed = records.withColumn("__errors", schema_errors()).withColumn("__chars", M.total_chars(m))
    metrics = F.struct(
        F.col("__chars").alias("total_chars"),
        F.size(m).cast("long").alias("message_count"),
        M.count_where(m, lambda x: x["role"] == "assistant").alias("assistant_count"),
        M.count_where(m, lambda x: F.coalesce(x["name"] == M.CALL, F.lit(False))).alias("function_call_count"),
        M.count_where(m, lambda x: x["role"] == "tool").alias("observation_count"),
        F.size(tools).cast("long").alias("tool_definition_count"),
        F.size("__errors").cast("long").alias("schema_error_count"),
    )
    tests = {
        "schema_error": F.size("__errors") > 0,
        "empty_message": M.has_blank(m),
        "missing_assistant": ~F.exists(m, lambda x: x["role"] == "assistant"),
        "invalid_turn_order": ~M.turns_alternate(m),
        "too_long": F.col("__chars") > policy.max_chars,
        "long_sample": (F.col("__chars") > policy.long_chars) & (F.col("__chars") <= policy.max_chars),
        "too_many_messages": F.size(m) > policy.max_messages,
        "unparsed_tool_definition": F.exists(tools, lambda t: ~is_object(t)),
        "missing_tool_definition": F.col("source_dataset").isin(*policy.tool_sources) & (F.size(tools) == 0),
    }
    flags = F.array_compact(F.array(*(F.when(tests[f], f) for f in FLAGS)))
    out = parsed.withColumn("metrics", metrics).withColumn("flags", flags)
    return out.withColumn("blocking", F.arrays_overlap("flags", F.array(*map(F.lit, policy.blocking)))).withColumn("schema_errors", F.slice("__errors", 1, 5)).drop("__errors", "__chars")


def lower_ranks(df: DataFrame, by: str, value: Column, ranks: dict[str, float], prefix: str) -> DataFrame:
    """Nearest-rank percentiles, lower: of n sorted values the one at ``floor((n - 1) * q)``; with the least and greatest.

    Values are counted first, so that what is sorted in a group is its different values alone.
    """
    counted = df.groupBy(by, value.cast("long").alias("v")).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(by).orderBy("v")
    placed = counted.withColumn("last", F.sum("c").over(upto) - 1).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    picks = [F.min(F.when(F.col("last") >= F.floor((F.col("n") - 1) * F.lit(q)), F.col("v"))).alias(f"{prefix}_{name}") for name, q in ranks.items()]
    return placed.groupBy(by).agg(F.min("v").alias(f"{prefix}_min"), *picks, F.max("v").alias(f"{prefix}_max"))


def source_profile(inspected: DataFrame, policy: AuditPolicy = AuditPolicy()) -> DataFrame:
    """Counts and percentiles by source."""
    slim = inspected.select("source_dataset", "blocking", "metrics")
    m = "metrics"
    counts = slim.groupBy("source_dataset").agg(
        F.count("*").alias("records"),
        F.count_if(~F.col("blocking")).alias("eligible"),
        F.count_if("blocking").alias("blocked"),
        F.count_if(F.col(f"{m}.tool_definition_count") > 0).alias("with_tools"),
        F.count_if(F.col(f"{m}.function_call_count") > 0).alias("with_function_calls"),
        F.count_if(F.col(f"{m}.observation_count") > 0).alias("with_observations"),
    )
    chars = lower_ranks(slim, "source_dataset", F.col(f"{m}.total_chars"), policy.quantiles, "chars")
    sizes = lower_ranks(slim, "source_dataset", F.col(f"{m}.message_count"), {k: q for k, q in policy.quantiles.items() if k != "p99"}, "messages")
    return counts.join(chars, "source_dataset").join(sizes, "source_dataset")


def flag_counts(inspected: DataFrame) -> DataFrame:
    return inspected.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def role_sequences(records: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` commonest role sequences of each source, ties by the first place they are met."""
    at = F.struct("meta.raw_object_key", "meta.raw_row_index")
    counted = records.select("source_dataset", M.role_sequence(F.col("messages")).alias("sequence"), at.alias("at")).groupBy("source_dataset", "sequence").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    order = Window.partitionBy("source_dataset").orderBy(F.desc("n"), "at")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("source_dataset", "rank", "sequence", "n")


def gate(inspected: DataFrame, policy: AuditPolicy = AuditPolicy()) -> DataFrame:
    """One row: totals, blocked fraction (1 for no records), violations and status."""
    tolerated = [F.count_if(F.array_contains("flags", f)) for f in policy.zero_tolerance]
    totals = inspected.agg(F.count("*").alias("records"), F.count_if("blocking").alias("blocked"), F.count_if(F.size("flags") > 0).alias("flagged"), sum(tolerated, F.lit(0)).alias("violations"))
    fraction = F.coalesce(F.try_divide(F.col("blocked").cast("double"), F.col("records")), F.lit(1.0))
    status = F.when((F.col("blocked_fraction") > policy.max_blocked_fraction) | (F.col("violations") > 0), "failed").when(F.col("flagged") > 0, "passed_with_warnings").otherwise("passed")
    return totals.withColumn("blocked_fraction", fraction).withColumn("status", status)


def review_queue(inspected: DataFrame, policy: AuditPolicy = AuditPolicy()) -> DataFrame:
    """Samples by source and by flag, one row per record with the sorted reasons it was taken for."""
    slim = inspected.select("id", "source_dataset", "flags")
    reasons = F.concat(F.array(F.concat(F.lit("source:"), "source_dataset")), F.transform("flags", lambda f: F.concat(F.lit("flag:"), f)))
    spread = slim.select("id", F.explode(reasons).alias("reason"))
    order = Window.partitionBy("reason").orderBy(rank_key(policy.seed, "review", F.col("reason"), F.col("id")), "id")
    size = F.when(F.col("reason").startswith("source:"), policy.per_source).otherwise(policy.per_flag)
    most = max(policy.per_source, policy.per_flag)
    taken = spread.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).where(F.col("nth") <= size)
    return taken.groupBy("id").agg(F.sort_array(F.collect_set("reason")).alias("selection_reasons")).withColumn("review_id", sha256(F.concat(F.lit("silver-audit.v1:"), "id")))


def review_rows(inspected: DataFrame, policy: AuditPolicy = AuditPolicy()) -> DataFrame:
    """The queue with records, flags, metrics and an open review; the queue is bounded by sources and flags times the sample sizes."""
    queue = review_queue(inspected, policy)
    open_review = F.struct(F.lit("pending").alias("status"), F.expr("cast(array() as array<string>)").alias("labels"), F.lit("").alias("notes")).alias("review")
    joined = inspected.join(queue, "id")
    record = F.struct(*(c for c in inspected.columns if c not in ("metrics", "flags", "blocking", "schema_errors"))).alias("record")
    return joined.select("review_id", F.col("id").alias("record_id"), "source_dataset", "task_family", "selection_reasons", "flags", "metrics", record, open_review)


def markdown_report(profile: list, flags: list, verdict) -> str:
    """The report's text, of small collected tables."""
    head = ["# Silver audit", "", f"Gate: {verdict.status}. Records {verdict.records}, blocked {verdict.blocked} ({verdict.blocked_fraction:.4%}).", ""]
    table = ["| Source | Records | Eligible | Blocked | Chars p50 | Chars p99 |", "|---|---:|---:|---:|---:|---:|"]
    table += [f"| {r.source_dataset} | {r.records} | {r.eligible} | {r.blocked} | {r.chars_p50} | {r.chars_p99} |" for r in sorted(profile, key=lambda r: r.source_dataset)]
    return "\n".join([*head, *table, "", "## Flags", "", *(f"- {r.flag}: {r.n}" for r in sorted(flags, key=lambda r: r.flag))]) + "\n"
