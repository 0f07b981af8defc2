"""Append-only tables, published snapshots and event topics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fourclocks.operators.revisions import append_rows


def append_new(path: str, rows: DataFrame, keys: Sequence[str], partition_by: Sequence[str] = ()) -> int:
    """Append the rows whose natural key the parquet table lacks; how many were inserted.

    The count is observed while writing, so the rows are computed once. One writer per table.
    """
    spark = rows.sparkSession
    existing = spark.read.schema(rows.schema).parquet(path) if table_exists(spark, path) else rows.limit(0)
    seen = Observation("append")
    counted = append_rows(existing, rows, keys).observe(seen, F.count("*").alias("inserted"))
    counted.write.mode("append").partitionBy(*partition_by).parquet(path)
    return int(seen.get["inserted"])


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def canonical_records(df: DataFrame, key: str = "election_id", snapshot: str = "snapshot_id") -> DataFrame:
    """One canonical JSON body (sorted fields, nulls kept) and its digest per snapshot."""
    body = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.select(key, snapshot, F.sha2(body, 256).alias("digest"), body.alias("body"))


def publish(df: DataFrame, path: str, key: str = "election_id", snapshot: str = "snapshot_id", buckets: int = 256) -> None:
    """Write immutable snapshot records partitioned by election; republishing adds nothing.

    Elections lie in ``bucket=`` folders by hash, and only the buckets of the elections in ``df`` are read back, however many
    have been published.
    """
    records = canonical_records(df, key, snapshot).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    spark = df.sparkSession
    there = set(folder_names(spark, path))
    hits = [f"bucket={r[0]}" for r in records.select("bucket").distinct().collect()]  # at most ``buckets``
    folders = [f"{path}/{h}" for h in sorted(hits) if h in there]
    if folders:
        stored = spark.read.schema(records.schema).option("basePath", path).json(folders)
        records = append_rows(stored, records, [key, snapshot, "digest"])
    records.repartition("bucket").write.mode("append").partitionBy("bucket", key).json(path)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none where there is no folder."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def write_events(df: DataFrame, path: str) -> None:
    """Append envelopes to a file topic, one folder per event type."""
    df.select("type", F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").partitionBy("type").text(path)


def read_events(spark: SparkSession, path: str, schema: StructType | str, max_files: int | None = None) -> DataFrame:
    """The topic as a stream of envelopes."""
    reader = spark.readStream.format("text").schema("value string, type string").option("recursiveFileLookup", "false")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(F.from_json("value", schema).alias("e")).select("e.*")
