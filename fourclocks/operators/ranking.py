"""Top-k reports and orderings.

Per-group ranks go through ``row_number`` with a filter, which Spark applies before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leaders(df: DataFrame, keys: Sequence[str], value: str, tie: str, n: int = 2) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(value), F.col(tie))
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def rank_coalitions(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("majority_probability"), F.col("coalition_key"))
    return df.withColumn("place", F.row_number().over(w))


def calendar(
    elections: DataFrame, jurisdiction: str | None = None, n: int | None = None, per_jurisdiction: bool = False
) -> DataFrame:
    """By date, undated last; optionally one (dated first) per jurisdiction, or the first n."""
    rows = elections if jurisdiction is None else elections.where(F.col("jurisdiction_id") == jurisdiction)
    if per_jurisdiction:
        rest = [c for c in rows.columns if c != "jurisdiction_id"]
        order = F.struct(F.col("election_date").isNull(), F.col("election_date"), F.col("election_id"))
        rows = (
            rows.groupBy("jurisdiction_id")
            .agg(F.min_by(F.struct(*rest), order).alias("_e"))
            .select("jurisdiction_id", "_e.*")
            .select(*elections.columns)
        )
    rows = rows.orderBy(F.asc_nulls_last("election_date"), "election_id")
    return rows if n is None else rows.limit(n)


def history(snapshots: DataFrame, election_id=None) -> DataFrame:
    """Snapshots of an election, newest first, model family descending within a time."""
    rows = snapshots if election_id is None else snapshots.where(F.col("election_id") == election_id)
    return rows.orderBy(F.desc("published_at"), F.desc("model_family"))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    from fourclocks.operators.asof import newest

    return newest(snapshots, ["election_id"], ["published_at", "snapshot_id"])
