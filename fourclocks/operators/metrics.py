"""Scoring rules, cluster means, calibration and md5-indexed bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Calibration bins [low, high); the last one is closed. Bin 6 starts at 0.6 so that
# every probability falls in exactly one bin.
CALIBRATION_BINS = (
    (0.0, 0.1), (0.1, 0.2), (0.2, 0.30000000000000004), (0.30000000000000004, 0.4), (0.4, 0.5),
    (0.5, 0.6), (0.6, 0.7000000000000001), (0.7000000000000001, 0.8), (0.8, 0.9), (0.9, 1.0),
)


def scored(forecast: DataFrame, by: Sequence[str], value: str = "actual", index: str = "party_index") -> DataFrame:
    """Mark the winner per fold: largest actual, first index on ties. Groups are one ballot."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), F.col(index))
    return forecast.withColumn("is_winner", (F.row_number().over(w) == 1).cast("int"))


def brier(forecast: DataFrame, by: Sequence[str]) -> DataFrame:
    gap = F.col("probability") - F.col("is_winner")
    return scored(forecast, by).groupBy(*by).agg(F.sum(gap * gap).alias("brier"))


def vote_share_rmse(forecast: DataFrame, by: Sequence[str]) -> DataFrame:
    gap = F.col("predicted") - F.col("actual")
    return forecast.groupBy(*by).agg(F.sqrt(F.avg(gap * gap)).alias("rmse"))


def interval_coverage(forecast: DataFrame, by: Sequence[str]) -> DataFrame:
    inside = F.col("actual").between(F.col("low"), F.col("high")).cast("double")
    return forecast.groupBy(*by).agg(F.avg(inside).alias("coverage"))


def fold_scores(forecast: DataFrame, by: Sequence[str]) -> DataFrame:
    """Brier, RMSE and coverage of each fold in one aggregate."""
    gap = F.col("probability") - F.col("is_winner")
    miss = F.col("predicted") - F.col("actual")
    inside = F.col("actual").between(F.col("low"), F.col("high")).cast("double")
    return scored(forecast, by).groupBy(*by).agg(
        F.sum(gap * gap).alias("brier"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        F.avg(inside).alias("coverage"),
    )


def cluster_means(df: DataFrame, keys: Sequence[str], cluster: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, cluster).agg(*[F.avg(v).alias(v) for v in values])


def clustered_average(df: DataFrame, keys: Sequence[str], cluster: str, values: Sequence[str]) -> DataFrame:
    """Mean by cluster, then mean of means."""
    inner = cluster_means(df, keys, cluster, values)
    return inner.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("clusters"))


def calibration_bin(p: Column) -> Column:
    chain = F.lit(len(CALIBRATION_BINS) - 1)
    for i in range(len(CALIBRATION_BINS) - 2, -1, -1):
        chain = F.when(p < CALIBRATION_BINS[i][1], F.lit(i)).otherwise(chain)
    return chain


def calibration_error(pairs: DataFrame, keys: Sequence[str], cluster: str, p: str, y: str) -> DataFrame:
    """Share-weighted absolute gap over ten bins per cluster, averaged over clusters."""
    bins = pairs.groupBy(*keys, cluster, calibration_bin(F.col(p)).alias("_bin")).agg(
        F.count("*").alias("_n"), F.avg(p).alias("_p"), F.avg(F.col(y).cast("double")).alias("_y")
    )
    per_cluster = bins.groupBy(*keys, cluster).agg(
        (F.sum(F.col("_n") * F.abs(F.col("_p") - F.col("_y"))) / F.sum("_n")).alias("_e")
    )
    return per_cluster.groupBy(*keys).agg(
        F.avg("_e").alias("calibration_error"), F.count("*").alias("clusters")
    )


def bootstrap_means(clusters: DataFrame, keys: Sequence[str], order: str, value: str, resamples: int) -> DataFrame:
    """Resampled means of cluster values; the slot's pick is an md5-derived index.

    ``clusters`` holds one row per held-out election, so numbering it per key is bounded by the
    calendar. Each cluster explodes its own slot in every resample and meets the picked value by
    an equi join on (key, index).
    """
    per_key = Window.partitionBy(*keys)
    numbered = clusters.select(
        *keys,
        F.col(value).alias("_v"),
        (F.row_number().over(per_key.orderBy(order)) - 1).cast("long").alias("_slot"),
        F.count("*").over(per_key).alias("_n"),
    )
    slots = numbered.select(*keys, "_slot", "_n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_rep"))
    token = F.md5(F.concat_ws(":", F.col("_rep"), F.col("_slot")).cast("binary"))
    pick = F.conv(F.substring(token, 1, 8), 16, 10).cast("long") % F.col("_n")
    picked = slots.withColumn("_pick", pick).join(
        numbered.select(*keys, F.col("_slot").alias("_pick"), "_v"), [*keys, "_pick"]
    )
    return picked.groupBy(*keys, "_rep").agg(F.avg("_v").alias("mean"))


def bootstrap_ci(
    df: DataFrame, keys: Sequence[str], cluster: str, value: str, resamples: int = 5000
) -> DataFrame:
    """5 to 95 % of the resampled cluster means."""
    means = bootstrap_means(cluster_means(df, keys, cluster, [value]), keys, cluster, value, resamples)
    q = F.percentile("mean", [0.05, 0.95])
    return means.groupBy(*keys).agg(q.alias("_q")).select(
        *keys, F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high")
    )


def paired_superiority(
    df: DataFrame, keys: Sequence[str], cluster: str, challenger: str, baseline: str, resamples: int = 10000
) -> DataFrame:
    """Upper 95 % bound of the resampled mean difference; superior when below zero."""
    differences = df.withColumn("_d", F.col(challenger) - F.col(baseline))
    means = bootstrap_means(cluster_means(differences, keys, cluster, ["_d"]), keys, cluster, "_d", resamples)
    return means.groupBy(*keys).agg(F.percentile("mean", 0.95).alias("upper")).withColumn(
        "superior", F.col("upper") < 0
    )


def best_model(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Family with the least (brier, rmse) pair."""
    return metrics.groupBy(*keys).agg(
        F.min_by("model_family", F.struct("brier", "rmse", "model_family")).alias("model_family"),
        F.min("brier").alias("brier"),
    )
