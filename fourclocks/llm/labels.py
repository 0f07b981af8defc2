"""Labelled rows for the trained operators, from a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo; a null id has no remainder."""
    return F.crc32(F.col(id_col).cast("string")) % divisor


def labelled(docs: DataFrame, labels: DataFrame, target: str, train: Column, most: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of training rows: of each label the ``most[label]`` rows of the smallest id hashes.

    Repeated labels of one id are merged (the larger one holds); ids or labels that are null are left out. Of rows that
    share an id the one with the smallest text hash counts (then the smaller text), so rows are bounded by ``most`` like
    the ids. The ids are broadcast; texts stay in Spark.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(target).isNotNull() & train).groupBy(F.col(id_col).alias("id")).agg(F.max(target).cast("int").alias("y"))
    chosen = None
    for y in (0, 1):
        part = marks.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most[y])
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    return rows.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("y").alias("y"))


def counts(labels: DataFrame, target: str, train: Column, id_col: str = "doc_id") -> tuple[int, int]:
    """Training labels 0 and 1, for putting a balanced sample's scores back to the true shares."""
    row = labels.where(F.col(id_col).isNotNull() & train).agg(F.sum((F.col(target) == 0).cast("long")), F.sum((F.col(target) == 1).cast("long"))).first()
    return int(row[0] or 0), int(row[1] or 0)
