"""Scans: JSON lines with physical line numbers, tables, and reproducible samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def numbered_lines(spark: SparkSession, *paths: str, glob: str = "*.jsonl") -> DataFrame:
    """``raw_object_key, raw_row_index, line`` of JSON lines files; blank lines are skipped but count.

    Each file is one value, as a line's number is only known within the whole file; raw shards are
    bounded by their writer. Larger files: ``numbered_lines_large``.
    """
    files = spark.read.text(list(paths), wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True).select(F.col("value"), F.col("_metadata.file_path").alias("raw_object_key"))
    lines = files.select("raw_object_key", F.posexplode(F.split("value", "\r?\n")).alias("raw_row_index", "line"))
    return lines.where(F.trim("line") != "").select("raw_object_key", F.col("raw_row_index").cast("long").alias("raw_row_index"), "line")


def numbered_lines_large(spark: SparkSession, path: str) -> DataFrame:
    """The same for one file of any size: splits are read in order, each split's lines counted first."""
    indexed = spark.sparkContext.textFile(path).zipWithIndex().filter(lambda x: x[0].strip() != "")
    return spark.createDataFrame(indexed.map(lambda x: (path, x[1], x[0])), "raw_object_key string, raw_row_index long, line string")


def read_any(spark: SparkSession, path: str | list[str], kind: str, schema: StructType | str | None = None, **options) -> DataFrame:
    """JSON lines, Parquet, CSV, ORC or text by name; several paths are one union."""
    reader = spark.read.options(**options)
    reader = reader.schema(schema) if schema is not None else reader
    return reader.format({"jsonl": "json"}.get(kind, kind)).load(path)


def hashed_sample(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """``n`` rows in a reproducible pseudo-random order: a top-n, not a full sort."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def id_range(df: DataFrame, column: str, start: int, end: int) -> DataFrame:
    """Rows whose id is from ``start`` up to, not including, ``end``; pushed down to the scan."""
    return df.where((F.col(column) >= start) & (F.col(column) < end))


def id_list(df: DataFrame, column: str, ids: list) -> DataFrame:
    """Rows whose id is listed; the list is a configuration's."""
    return df.where(F.col(column).isin(*ids)) if ids else df.limit(0)


def ranked(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does a path exist in whatever store it names?"""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))
