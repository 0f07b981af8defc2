"""Tables that micro-batches append to and read back by key.

Rows lie in ``gen=g/bucket=b/batch=n`` folders, where a bucket is a hash of the key columns. A batch reads the buckets that
its own keys hit and nothing else, whatever the length of the log, and writes its rows under its batch id, so a batch that is
replayed after a lost driver replaces its own output and is not judged against it. ``compact`` writes the next generation;
readers turn to it once it is complete.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fourclocks.sources.sinks import folder_names


class Ledger:
    """A table of ``schema`` (DDL), hashed by ``keys`` into ``buckets`` folders. One writer; null keys are keys."""

    def __init__(self, path: str, schema: str, keys: Sequence[str], buckets: int = 256) -> None:
        self.path, self.schema, self.keys, self.buckets = path, schema, list(keys), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def hits(self, df: DataFrame) -> list[int]:
        """The buckets of a batch's keys: at most ``buckets`` numbers."""
        return [r[0] for r in df.select(self.bucket().alias("b")).distinct().collect()]

    def generation(self, spark: SparkSession) -> int:
        """The last complete generation; the first one needs no compaction to be complete."""
        found = sorted((int(n[4:]) for n in folder_names(spark, self.path) if n.startswith("gen=")), reverse=True)
        return next((g for g in found if g and "_SUCCESS" in folder_names(spark, f"{self.path}/gen={g}")), 0)

    def read(self, spark: SparkSession, hits: Sequence[int] | None = None, before: int | None = None) -> DataFrame:
        """Rows with ``bucket`` and ``batch``, of some buckets and of the batches before one (default: all)."""
        root = f"{self.path}/gen={self.generation(spark)}"
        there = {int(n[7:]) for n in folder_names(spark, root) if n.startswith("bucket=")}
        folders = [f"{root}/bucket={b}" for b in sorted(there if hits is None else there & set(hits))]
        schema = f"{self.schema}, bucket int, batch long"
        if not folders:
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).option("basePath", root).parquet(*folders)
        return rows if before is None else rows.where(F.col("batch") < before)

    def write(self, df: DataFrame, batch_id: int) -> None:
        """Put a batch's rows down, in place of what the batch wrote before. One file a bucket."""
        root = f"{self.path}/gen={self.generation(df.sparkSession)}"
        self._save(df.withColumn("batch", F.lit(batch_id).cast("long")), root, dynamic=True)

    def _save(self, df: DataFrame, root: str, dynamic: bool) -> None:
        columns = [c.split()[0] for c in self.schema.split(", ")]
        rows = df.select(*columns, self.bucket().alias("bucket"), "batch").repartition("bucket")
        mode = "dynamic" if dynamic else "static"
        rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket", "batch").parquet(root)

    def compact(self, spark: SparkSession, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Write ``merge`` of all rows as the next generation, between two batches.

        ``merge`` takes and returns the schema's columns; its rows count as written by the last batch. Older generations
        stay for readers that are at work and can be deleted later.
        """
        now = self.generation(spark)
        rows = self.read(spark)
        last = rows.agg(F.max("batch")).first()[0]
        if last is not None:
            merged = merge(rows.drop("bucket", "batch")).withColumn("batch", F.lit(last).cast("long"))
            self._save(merged, f"{self.path}/gen={now + 1}", dynamic=False)
