"""``python -m millrace.cli STEP --config FILE [--overwrite]``: one step of the layers, configured by YAML."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators.audit import AuditPolicy
from .operators.clean import CleanConfig
from .operators.mixture import MixtureConfig
from .operators.scoring import judged, score
from .plans import layers
from .plans.ingest import ingest

STEPS = ("ingest", "clean", "audit", "mixture", "export", "holdout", "score")


def run_step(spark: SparkSession, step: str, config: dict, overwrite: bool) -> dict:
    if step == "ingest":
        return ingest(spark, config["dataset"], config.get("catalog"), overwrite)
    layout, run = layers.Layout(config.get("root", "")), config.get("run_id", "run")
    if step == "clean":
        return layers.clean(spark, config["raw"], layout, run, CleanConfig(**config.get("clean", {})), overwrite)
    if step == "audit":
        return layers.audit_layer(spark, layout, run, AuditPolicy(**config.get("policy", {})))
    if step == "mixture":
        return layers.gold(spark, layout, run, MixtureConfig(**config["mixture"]), config.get("review_approved", False), config.get("smoke", False), overwrite)
    if step == "export":
        return layers.export(spark, layout, run, overwrite)
    if step == "holdout":
        return {"records": layers.build_holdout(spark, layout, run, config["targets"], overwrite)}
    return score(judged(spark.read.json(config["predictions"]))).first().asDict()


def main(args: list[str] | None = None) -> dict:
    import yaml

    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("step", choices=STEPS)
    parser.add_argument("--config", required=True)
    parser.add_argument("--overwrite", action="store_true")
    told = parser.parse_args(args)
    with open(told.config, encoding="utf-8") as f:
        config = yaml.safe_load(f)
    out = run_step(SparkSession.builder.getOrCreate(), told.step, config, told.overwrite)
    print(json.dumps(out, indent=2, default=str))
    return out


if __name__ == "__main__":
    main()
