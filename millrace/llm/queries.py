"""Registered queries of the training-data operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers

from . import ann, decontaminate, langid, line_templates, near_dedup, packing, pii, quality, sharding, toxicity
from .common import read_table

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def op1_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_simhash_dedup(spark, sf_dir):
    return near_dedup.simhash_digest(read_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark, sf_dir):
    return line_templates.line_digest(read_table(spark, sf_dir, "documents"))


def op4_pii(spark, sf_dir):
    return pii.pii_digest(read_table(spark, sf_dir, "documents"))


def op5_sharding(spark, sf_dir):
    return sharding.shard_digest(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity_digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_quality(spark, sf_dir):
    return quality.quality_digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_packing(spark, sf_dir):
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS))


def op9_neighbours(spark, sf_dir):
    return ann.neighbour_digest(read_table(spark, sf_dir, "embeddings"))


def op10_language(spark, sf_dir):
    return langid.language_digest(read_table(spark, sf_dir, "documents"))


_ALL = (op1_decontamination, op2_simhash_dedup, op3_line_dedup, op4_pii, op5_sharding, op6_toxicity, op7_quality, op8_packing, op9_neighbours, op10_language)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE = {"op3_line_dedup": line_templates.ORACLE, "op5_sharding": sharding.ORACLE}
