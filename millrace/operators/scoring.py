"""Scoring predicted tool calls against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"
FENCE = r"(?is)^```(?:json)?\s*(.*?)\s*```$"
CALLS = "array<struct<name:string,arguments:string>>"


def decoded(text: Column) -> Column:
    """JSON text as VARIANT after one code fence, if any, is taken off; null where it doesn't parse."""
    plain = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    inside = F.regexp_extract(plain, FENCE, 1)
    return F.try_parse_json(F.when(plain.rlike(FENCE), inside).otherwise(plain))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def as_calls(v: Column) -> Column:
    """An object is one call, a list of objects is calls (an empty list none), anything else null; items are VARIANT."""
    items = F.try_variant_get(v, "$", "array<variant>")
    objects = F.forall(items, lambda x: F.coalesce(_kind(x).startswith("OBJECT"), F.lit(False)))
    return F.when(_kind(v).startswith("OBJECT"), F.array(v)).when(_kind(v).startswith("ARRAY") & objects, items)


def normalized(calls: Column) -> Column:
    """``name`` and canonical ``arguments`` text of each call: ``arguments``, else ``parameters``, else ``{}``; text arguments are parsed if they can be."""

    def one(c: Column) -> Column:
        given = F.coalesce(F.try_variant_get(c, "$.arguments", "variant"), F.try_variant_get(c, "$.parameters", "variant"), F.parse_json(F.lit("{}")))
        text = F.when(_kind(given) == "STRING", F.try_parse_json(F.try_variant_get(given, "$", "string")))
        return F.struct(F.try_variant_get(c, "$.name", "string").alias("name"), F.to_json(F.coalesce(text, given)).alias("arguments"))

    return F.transform(calls, one).cast(CALLS)


def extract_calls(text: Column) -> tuple[Column, Column]:
    """``calls`` (null if the text isn't valid) and whether they came in blocks; all blocks must parse."""
    blocks = F.regexp_extract_all(text, F.lit(BLOCK), F.lit(1))
    wrapped = F.size(blocks) > 0
    each = F.transform(blocks, lambda b: as_calls(decoded(b)))
    joined = F.when(F.forall(each, lambda c: c.isNotNull()), F.flatten(each))
    return normalized(F.when(wrapped, joined).otherwise(as_calls(decoded(text)))), wrapped


def judged(predictions: DataFrame, strict: bool = True) -> DataFrame:
    """Prediction rows with ``json_valid, wrapper_valid, count_exact, names_exact, arguments_exact``; each of the last three needs the one before.

    With ``strict`` a label that isn't valid fails the job.
    """
    p, wrapped = extract_calls(F.coalesce(F.col("predict"), F.lit("")))
    l, _ = extract_calls(F.coalesce(F.col("label"), F.lit("")))
    rows = predictions.withColumn("__p", p).withColumn("__l", l).withColumn("__w", wrapped)
    if strict:
        rows = rows.withColumn("__l", F.when(F.col("__l").isNull(), F.raise_error(F.concat(F.lit("label is not a tool call: "), F.col("id").cast("string"))).cast(CALLS)).otherwise(F.col("__l")))
    valid = F.col("__p").isNotNull()
    count = valid & F.coalesce(F.size("__p") == F.size("__l"), F.lit(False))
    names = count & F.coalesce(F.transform("__p", lambda c: c["name"]) == F.transform("__l", lambda c: c["name"]), F.lit(False))
    arguments = names & F.coalesce(F.col("__p") == F.col("__l"), F.lit(False))
    return rows.select(*predictions.columns, valid.alias("json_valid"), (valid & F.col("__w")).alias("wrapper_valid"), count.alias("count_exact"), names.alias("names_exact"), arguments.alias("arguments_exact"))


METRICS = ("json_valid", "wrapper_valid", "count_exact", "names_exact", "arguments_exact")


def score(rows: DataFrame) -> DataFrame:
    """One row: total, counts and rates to six places; no rows give null rates."""
    sums = [F.count_if(m).alias(m) for m in METRICS]
    totals = rows.agg(F.count("*").alias("total"), *sums)
    return totals.select("total", *METRICS, *(F.round(F.try_divide(F.col(m).cast("double"), F.col("total")), 6).alias(f"{m}_rate") for m in METRICS))


def failures(rows: DataFrame, order: str, k: int = 5) -> DataFrame:
    """The first ``k`` rows whose calls aren't exact."""
    return rows.where("NOT arguments_exact").orderBy(order).limit(k)


def paired_outcomes(base: DataFrame, adapter: DataFrame) -> DataFrame:
    """How two models' rows compare by id: both right, fixed, regressed, both wrong."""
    joined = base.select("id", F.col("arguments_exact").alias("b")).join(adapter.select("id", F.col("arguments_exact").alias("a")), "id")
    outcome = F.when(F.col("b") & F.col("a"), "both_right").when(F.col("a"), "fixed").when(F.col("b"), "regressed").otherwise("both_wrong")
    return joined.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def badcases(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Failures counted by the source and domain that the records have: what a next mixture would change."""
    cause = F.when(~F.col("json_valid"), "invalid_json").when(~F.col("count_exact"), "wrong_count").when(~F.col("names_exact"), "wrong_name").otherwise("wrong_arguments")
    wrong = rows.where("NOT arguments_exact").select("id", cause.alias("cause"))
    return wrong.join(facts.select("id", "source_dataset", "domain"), "id").groupBy("source_dataset", "domain", "cause").agg(F.count("*").alias("n"))


