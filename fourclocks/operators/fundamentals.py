"""Partially pooled ridge regression whose sums run on Spark.

Only the p x p normal equations (p = features + 1) ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourclocks.functions.shares import logit, sigmoid, total

RIDGE = 4.0
POOLING = 5.0
MIN_ROWS = 5
MIN_RESIDUAL_STD = 0.08


def training_rows(rows: DataFrame, cutoff: Column) -> DataFrame:
    return rows.where(
        (F.col("available_at") <= cutoff) & (F.col("election_date") < cutoff.cast("date"))
    )


def feature_scale(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: population mean and std per feature (a flat feature scales by one), row count."""
    columns = [F.count("*").alias("training_count")]
    for f in features:
        std = F.stddev_pop(f)
        columns += [F.avg(f).alias(f"{f}_mean"), F.when(std < 1e-8, F.lit(1.0)).otherwise(std).alias(f"{f}_std")]
    return rows.agg(*columns)


def standardised(rows: DataFrame, features: Sequence[str], scale: DataFrame) -> DataFrame:
    """Features as z-scores; the one-row scale enters as a scalar subquery, never collected."""
    s = scale.select(F.struct(*scale.columns)).scalar()
    z = {f: (F.col(f) - s.getField(f"{f}_mean")) / s.getField(f"{f}_std") for f in features}
    return rows.withColumns(z)


def gram_sums(rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One row of X'X (upper triangle) and X'y, with the intercept as the first column."""
    x = [F.lit(1.0), *[F.col(f) for f in features]]
    cells = [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return rows.agg(*cells, *[F.sum(x[i] * F.col(target)).alias(f"b{i}") for i in range(len(x))])


def pooled_offsets(rows: DataFrame, label: str, residual: str, strength: float = POOLING) -> DataFrame:
    """Mean residual per label, shrunk by n / (n + strength)."""
    n = F.count("*")
    return rows.groupBy(label).agg((F.avg(residual) * n / (n + F.lit(strength))).alias("offset"), n.alias("n"))


@dataclass(frozen=True)
class FundamentalsFit:
    features: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]
    coefficients: tuple[float, ...]
    archetype_offsets: DataFrame
    jurisdiction_offsets: DataFrame
    residual_std: float
    training_count: int


def _linear(features: Sequence[str], mean, std, beta) -> Column:
    terms = [F.lit(beta[0])]
    for i, f in enumerate(features):
        terms.append((F.col(f) - F.lit(mean[i])) / F.lit(std[i]) * F.lit(beta[i + 1]))
    return total(terms)


def fit_ridge(
    rows: DataFrame, features: Sequence[str], cutoff: Column, ridge: float = RIDGE, pooling: float = POOLING
) -> FundamentalsFit:
    if ridge <= 0 or pooling <= 0:
        raise ValueError("prior strengths must be positive")
    train = training_rows(rows, cutoff).withColumn("_y", logit(F.col("actual_share")))
    scale = feature_scale(train, features).first()
    if scale["training_count"] < MIN_ROWS:
        raise ValueError("at least five training elections are required")
    mean = tuple(float(scale[f"{f}_mean"]) for f in features)
    std = tuple(float(scale[f"{f}_std"]) for f in features)
    z = train.withColumns({f: (F.col(f) - m) / d for f, m, d in zip(features, mean, std, strict=True)})
    sums = gram_sums(z, features, "_y").first()
    p = len(features) + 1
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    penalty = np.diag([0.0] + [ridge] * len(features))
    beta = np.linalg.solve(gram + penalty, np.array([sums[f"b{i}"] for i in range(p)]))
    beta = tuple(float(b) for b in beta)

    left = train.withColumn("_r", F.col("_y") - _linear(features, mean, std, beta))
    by_archetype = pooled_offsets(left, "archetype", "_r", pooling).select(
        "archetype", F.col("offset").alias("archetype_offset")
    )
    after = left.join(by_archetype, "archetype").withColumn("_r", F.col("_r") - F.col("archetype_offset"))
    by_jurisdiction = pooled_offsets(after, "jurisdiction_id", "_r", pooling).select(
        "jurisdiction_id", F.col("offset").alias("jurisdiction_offset")
    )
    final = after.join(by_jurisdiction, "jurisdiction_id")
    spread = final.agg(F.stddev_samp(F.col("_r") - F.col("jurisdiction_offset"))).first()[0]
    return FundamentalsFit(
        tuple(features), mean, std, beta, by_archetype, by_jurisdiction,
        max(MIN_RESIDUAL_STD, float(spread)), int(scale["training_count"]),
    )


def predict_fundamentals(model: FundamentalsFit, rows: DataFrame) -> DataFrame:
    """Share with a 90 % interval, wider for labels the training rows never showed."""
    joined = rows.join(model.archetype_offsets, "archetype", "left").join(
        model.jurisdiction_offsets, "jurisdiction_id", "left"
    )
    new_a, new_j = F.col("archetype_offset").isNull(), F.col("jurisdiction_offset").isNull()
    centre = (
        _linear(model.features, model.mean, model.std, model.coefficients)
        + F.coalesce("archetype_offset", F.lit(0.0))
        + F.coalesce("jurisdiction_offset", F.lit(0.0))
    )
    widen = F.lit(1.0) + 0.20 * new_a.cast("int") + 0.15 * new_j.cast("int")
    std = F.lit(model.residual_std) * widen
    return joined.select(
        *rows.columns,
        sigmoid(centre).alias("share"),
        sigmoid(centre - 1.645 * std).alias("low"),
        sigmoid(centre + 1.645 * std).alias("high"),
        std.alias("posterior_std"),
        F.lit(model.training_count).alias("training_count"),
        new_a.alias("unseen_archetype"),
        new_j.alias("unseen_jurisdiction"),
    )
