"""Poll aggregation: weighted means, covariance, window means, recent means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fourclocks.functions.shares import (
    entries,
    half_life,
    mode_quality,
    normalise_vector,
    total,
)


def to_vector(results: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "shares") -> DataFrame:
    """Long shares to one dense vector per key, positions by ``order``, missing = 0.

    Conditional sums keep it a single map-side combined aggregate.
    """
    cells = [
        F.coalesce(F.sum(F.when(F.col("contestant_id") == c, F.col("share"))), F.lit(0.0))
        for c in order
    ]
    return results.groupBy(*keys).agg(F.array(*cells).alias(name))


def adjusted_polls(
    polls: DataFrame,
    size: int,
    cutoff: Column,
    half_life_days: float = 21.0,
    house_effects: DataFrame | None = None,
) -> DataFrame:
    """Per poll: adjusted shares x0..xk, weight, decayed sample and eligibility at the cutoff.

    ``polls``: election_id, pollster, mode, fieldwork_end date, available_at timestamp,
    sample_size, shares array. ``house_effects``: pollster, effect array.
    """
    if half_life_days <= 0:
        raise ValueError("half-life must be positive")
    if house_effects is not None:
        polls = polls.join(house_effects, "pollster", "left")
        effect = [F.coalesce(e, F.lit(0.0)) for e in entries("effect", size)]
    else:
        effect = [F.lit(0.0)] * size
    shares = normalise_vector([s - e for s, e in zip(entries("shares", size), effect, strict=True)])
    age = F.greatest(F.lit(0), F.datediff(cutoff.cast("date"), "fieldwork_end"))
    decay = half_life(age, half_life_days)
    ok = (F.col("available_at") <= cutoff) & (F.col("fieldwork_end") <= cutoff.cast("date"))
    return polls.select(
        "election_id",
        "available_at",
        "sample_size",
        F.coalesce(ok, F.lit(False)).alias("ok"),
        (F.sqrt(F.col("sample_size").cast("double")) * decay * mode_quality(F.col("mode"))).alias("w"),
        (F.col("sample_size") * decay).alias("n_eff"),
        *[s.alias(f"x{i}") for i, s in enumerate(shares)],
    )


def poll_moments(adjusted: DataFrame, size: int, keys: Sequence[str] = ("election_id",)) -> DataFrame:
    """All weighted first and second moments of one election in a single aggregate."""
    ok = F.col("ok")
    w = F.when(ok, F.col("w"))
    first = [F.sum(w * F.col(f"x{i}")).alias(f"s{i}") for i in range(size)]
    second = [
        F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}")
        for i in range(size)
        for j in range(i, size)
    ]
    return adjusted.groupBy(*keys).agg(
        F.sum(w).alias("sw"),
        F.count_if(ok).alias("poll_count"),
        F.count_if(~ok).alias("omitted"),
        F.sum(F.when(ok, F.col("n_eff"))).alias("effective_n"),
        F.max(F.when(ok, F.col("available_at"))).alias("latest_available_at"),
        F.max(F.when(ok, F.col("sample_size"))).alias("largest_sample"),
        *first,
        *second,
    )


def mean_columns(size: int) -> list[Column]:
    return [F.col(f"s{i}") / F.col("sw") for i in range(size)]


def covariance_columns(size: int) -> list[list[Column]]:
    """Weighted covariance; sampling variance for a single poll; 1e-6 on the diagonal."""
    mean = mean_columns(size)
    out: list[list[Column]] = []
    for i in range(size):
        row = []
        for j in range(size):
            a, b = min(i, j), max(i, j)
            spread = F.col(f"s{a}_{b}") / F.col("sw") - mean[a] * mean[b]
            single = mean[i] * (F.lit(1.0) - mean[i]) / F.col("largest_sample") if i == j else F.lit(0.0)
            cell = F.when(F.col("poll_count") > 1, spread).otherwise(single)
            row.append(cell + F.lit(1e-6) if i == j else cell)
        out.append(row)
    return out


def aggregate_polls(
    polls: DataFrame,
    contestants: Sequence[str],
    cutoff: Column,
    half_life_days: float = 21.0,
    house_effects: DataFrame | None = None,
) -> DataFrame:
    """Weighted mean share per election and contestant; elections without eligible polls drop out."""
    size = len(contestants)
    moments = poll_moments(adjusted_polls(polls, size, cutoff, half_life_days, house_effects), size)
    return moments.where(F.col("poll_count") > 0).select(
        "election_id",
        "poll_count",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("contestant_id"), m.alias("share"))
                    for c, m in zip(contestants, mean_columns(size), strict=True)
                ]
            )
        ).alias("_o"),
    ).select("election_id", "_o.contestant_id", "_o.share", "poll_count")


def poll_covariance(polls: DataFrame, contestants: Sequence[str], cutoff: Column, **options) -> DataFrame:
    size = len(contestants)
    moments = poll_moments(adjusted_polls(polls, size, cutoff, **options), size)
    matrix = covariance_columns(size)
    cells = [
        F.struct(F.lit(a).alias("row_id"), F.lit(b).alias("col_id"), matrix[i][j].alias("covariance"))
        for i, a in enumerate(contestants)
        for j, b in enumerate(contestants)
    ]
    return (
        moments.where(F.col("poll_count") > 0)
        .select("election_id", F.explode(F.array(*cells)).alias("_c"))
        .select("election_id", "_c.*")
    )


def poll_effective_n(polls: DataFrame, size: int, cutoff: Column, **options) -> DataFrame:
    moments = poll_moments(adjusted_polls(polls, size, cutoff, **options), size)
    return moments.select(
        "election_id", "poll_count", "omitted", "effective_n", "latest_available_at"
    )


def window_mean(polls: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """Mean of the normalised vectors whose day lies in a closed window, renormalised.

    Polls shrink to one row per election and day before they meet the windows, and each window
    meets them through its days, so the join is an equi join on small inputs.
    """
    from fourclocks.operators.asof import window_days

    v = normalise_vector(entries("shares", size), floor=None)
    daily = polls.groupBy("election_id", F.col("fieldwork_end").alias("day")).agg(
        F.count("*").alias("_n"), *[F.sum(x).alias(f"_x{i}") for i, x in enumerate(v)]
    )
    matched = window_days(windows, "window_start", "window_end").join(daily, ["election_id", "day"])
    keys = ["election_id", "window_start", "window_end"]
    sums = matched.groupBy(*keys).agg(
        F.sum("_n").alias("poll_count"),
        F.min("day").alias("observed_at"),
        *[F.sum(f"_x{i}").alias(f"_m{i}") for i in range(size)],
    )
    scaled = [F.col(f"_m{i}") / total([F.col(f"_m{j}") for j in range(size)]) for i in range(size)]
    return sums.select(*keys, "poll_count", "observed_at", F.array(*scaled).alias("shares"))


def recent_mean(polls: DataFrame, size: int, newest: int = 5, keys: Sequence[str] = ("election_id",)) -> DataFrame:
    """Mean vector of the newest complete rows, renormalised.

    The rank filter is pushed below the shuffle: each task keeps ``newest`` rows per key.
    """
    complete = polls.where(
        F.least(*entries("shares", size)) > 0 if size > 1 else F.col("shares")[0] > 0
    )
    w = Window.partitionBy(*keys).orderBy(F.desc("fieldwork_end"), F.desc("poll_id"))
    kept = complete.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= newest)
    means = kept.groupBy(*keys).agg(
        F.count("*").alias("poll_count"),
        *[F.avg(x).alias(f"_m{i}") for i, x in enumerate(entries("shares", size))],
    )
    scaled = [F.col(f"_m{i}") / total([F.col(f"_m{j}") for j in range(size)]) for i in range(size)]
    return means.select(*keys, "poll_count", F.array(*scaled).alias("shares"))
