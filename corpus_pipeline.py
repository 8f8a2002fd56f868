"""The training-data pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns what the next one reads; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, line_templates, near_dedup, packing, toxicity
from millrace.llm.common import cut_lineage, read_table
from millrace.llm.queries import RANKS, TOKENIZER


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, in whatever store the path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared checkpoint folder and read again.

    A stage's input goes once its result is written; the last stage's stays, as the result is computed from it.
    """
    docs = read_table(spark, sf_dir, "documents")
    folder = spark.conf.get("spark.checkpoint.dir", None)
    at = f"{folder}/pipeline-{uuid.uuid4().hex}" if folder else None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return docs
        if at:
            docs.write.parquet(f"{at}/{k}")
            docs = spark.read.parquet(f"{at}/{k}")
            if k:
                remove(spark, f"{at}/{k - 1}")
        else:
            docs = cut_lineage(docs)
    return docs


#: The stages' models, fingerprints and tokens are beyond SQL; the tests hold them against brute force.
ORACLE_SQL = None
