"""Raw snapshots: content addressing and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_snapshots(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder as (source_key, content, retrieved_at)."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    return files.select(
        F.col("path").alias("source_key"), "content", F.col("modificationTime").alias("retrieved_at")
    )


def snapshot_index(snapshots: DataFrame, source_id) -> DataFrame:
    """Add sha256, byte count and the content-addressed object key."""
    body = F.col("content").cast("binary")
    sha = F.sha2(body, 256)
    key = F.concat_ws(
        "/", F.lit("raw"), source_id, F.date_format("retrieved_at", "yyyy/MM/dd"), F.substring(sha, 1, 2), sha
    )
    return snapshots.withColumns({"sha256": sha, "byte_count": F.octet_length(body), "object_key": key})


def dedupe_snapshots(new: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per (source_key, sha256) that is not stored yet."""
    keys = ["source_key", "sha256"]
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def snapshot_collisions(snapshots: DataFrame, key: str = "object_key") -> DataFrame:
    """Keys under which different bytes are recorded; must be empty."""
    merged = snapshots.groupBy(key, "sha256").agg(F.count("*").alias("_n"))
    return merged.groupBy(key).agg(F.count("*").alias("contents")).where(F.col("contents") > 1)
