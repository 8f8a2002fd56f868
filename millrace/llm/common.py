"""Helpers shared by the training-data operators: tables, lineage cuts, streamed groups, plain features."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.alike import BROADCAST_KEYS, BROADCAST_NUMBERS, cut_lineage, join_counted, released, stream_groups  # noqa: F401


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``; Spark's reader alone opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CONTENT = ["c1", "c2"]


def content_numbers(text: Column) -> list[Column]:
    """``c1, c2``: 120 bits of the MD5 of a text, in the digest's order; copies of one text count as one text."""
    digest = F.md5(text.cast("binary"))
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(name) for at, name in zip((1, 16), CONTENT)]


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; remainder 2 is held out of every fit."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def is_held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from; a null id is held out too."""
    return F.coalesce(fold_of(doc_id) == 2, F.lit(True))


def least_by_hash(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, the first by their key's hash.

    Of many rows only those below a hash under which about 1.5 times as many lie are sorted, as every
    task would else send ``most`` rows of its own.
    """
    n = rows.count()
    if n > 2 * most:
        rows = rows.where(F.xxhash64(key) < int(-(1 << 63) + (1 << 64) * 1.5 * most / n))
    return rows.orderBy(F.xxhash64(key), key).limit(most)


def crc32_of(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(released(fn), schema)
