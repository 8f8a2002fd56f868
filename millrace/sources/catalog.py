"""The metadata catalog: dataset versions, their files, and pipeline runs, as tables in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "dataset_versions": "id string, dataset_id string, source string, task_family string, license string, sample_size int, raw_path string, manifest_path string, status string, created_at timestamp, updated_at timestamp",
    "dataset_files": "id string, dataset_version_id string, object_key string, size_bytes long, sha256 string, record_count long, created_at timestamp",
    "pipeline_runs": "id string, run_type string, status string, config_json string, started_at timestamp, finished_at timestamp",
}


class Catalog:
    """Append, select, update and delete over Parquet; updates and deletes rewrite their small table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        from .scan import path_exists

        at = f"{self.folder}/{name}"
        return self.spark.read.schema(TABLES[name]).parquet(at) if path_exists(self.spark, at) else self.spark.createDataFrame([], TABLES[name])

    def append(self, name: str, rows: list[dict]) -> None:
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        self.spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], TABLES[name]).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")

    def _rewrite(self, name: str, df: DataFrame) -> None:
        rows = df.collect()  # catalog tables are small by nature; a folder can't be read and replaced at once
        self.spark.createDataFrame(rows, TABLES[name]).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def set_status(self, version: str, status: str, now) -> None:
        rows = self.table("dataset_versions")
        mine = F.col("id") == version
        self._rewrite("dataset_versions", rows.withColumn("status", F.when(mine, status).otherwise(F.col("status"))).withColumn("updated_at", F.when(mine, F.lit(now)).otherwise(F.col("updated_at"))))

    def delete_version(self, version: str) -> None:
        """A version and, with it, its files."""
        self._rewrite("dataset_files", self.table("dataset_files").where(F.col("dataset_version_id") != version))
        self._rewrite("dataset_versions", self.table("dataset_versions").where(F.col("id") != version))


def versions_with_files(versions: DataFrame, files: DataFrame) -> DataFrame:
    """Versions with the number, bytes and records of their files."""
    sums = files.groupBy(F.col("dataset_version_id").alias("id")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.sum("record_count").alias("records"))
    return versions.join(sums, "id", "left").na.fill(0, ["files", "bytes", "records"])


def latest(df: DataFrame, k: int = 5) -> DataFrame:
    return df.orderBy(F.desc("created_at"), "id").limit(k)
