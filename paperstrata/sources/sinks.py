"""Writes that can be repeated: content-addressed puts, partition replacement, upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versions import latest


def put_objects(spark: SparkSession, store: str, objects: DataFrame) -> DataFrame:
    """Adds objects (sha256, byte_size, content) that the store lacks; returns those that were new. The store is partitioned by
    the hash's first two digits, so a look-up reads one of 256 folders. What is new is written beside the store first and
    read from there, so it is worked out once, and a run that fails leaves the store as it was."""
    new = objects.dropDuplicates(["sha256"]).withColumn("shard", F.substring("sha256", 1, 2))
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        new = new.join(spark.read.parquet(store).select("sha256", "byte_size"), ["sha256", "byte_size"], "left_anti")
    beside = f"{store.rstrip('/')}.new-{uuid.uuid4().hex}"
    new.select("sha256", "byte_size", "content", "shard").write.parquet(beside)
    added = spark.read.parquet(beside)
    added.write.mode("append").partitionBy("shard").parquet(store)
    return added


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrites the partitions that ``df`` has and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with rows of ``new`` added or replaced by key."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    return latest(both, key, "_turn").drop("_turn")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in every file; quotes are doubled and no space is trimmed."""
    df.write.mode("overwrite").option("header", True).option("lineSep", "\n").option("escape", '"').options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
