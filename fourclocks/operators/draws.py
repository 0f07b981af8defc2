"""Summaries of simulated-outcome tables: one row per draw, vectors kept as arrays.

Draw tables: keys..., shares array<double>, seats array<int>, turnout double. Means and
probabilities come from one map-side combined aggregate. Share quantiles are exact and use the
histogram ranks of ``quantiles``; seat quantiles aggregate (seats, count) rows, which are bounded
by the chamber size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fourclocks.functions.shares import argmax_position, entries, member_subsets, total
from fourclocks.operators.quantiles import quantiles

SHARE_BIN = 1e-3


def _long(df: DataFrame, keys: Sequence[str], contestants: Sequence[str], **vectors: str) -> DataFrame:
    cells = [
        F.struct(F.lit(c).alias("contestant_id"), *[F.col(v)[i].alias(n) for n, v in vectors.items()])
        for i, c in enumerate(contestants)
    ]
    return df.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.*")


def outcome_moments(draws: DataFrame, keys: Sequence[str], contestants: Sequence[str]) -> DataFrame:
    """Win probability, mean share and mean seats per contestant; one aggregate per key."""
    size = len(contestants)
    shares, seats = entries("shares", size), entries("seats", size)
    winner = argmax_position(seats)
    sums = draws.groupBy(*keys).agg(
        F.count("*").alias("draws"),
        *[F.count_if(winner == i).alias(f"_w{i}") for i in range(size)],
        *[F.sum(s).alias(f"_s{i}") for i, s in enumerate(shares)],
        *[F.sum(s).alias(f"_t{i}") for i, s in enumerate(seats)],
    )
    cells = [
        F.struct(
            F.lit(c).alias("contestant_id"),
            (F.col(f"_w{i}") / F.col("draws")).alias("win_probability"),
            (F.col(f"_s{i}") / F.col("draws")).alias("projected_share"),
            F.bround(F.col(f"_t{i}") / F.col("draws"), 0).cast("int").alias("projected_seats"),
        )
        for i, c in enumerate(contestants)
    ]
    return sums.select(*keys, "draws", F.explode(F.array(*cells)).alias("_c")).select(
        *keys, "draws", "_c.*"
    )


def seat_quantiles(draws: DataFrame, keys: Sequence[str], contestants: Sequence[str]) -> DataFrame:
    counted = (
        _long(draws, keys, contestants, seats="seats")
        .groupBy(*keys, "contestant_id", "seats")
        .agg(F.count("*").alias("_n"))
    )
    q = F.percentile("seats", [0.05, 0.95], F.col("_n"))
    return counted.groupBy(*keys, "contestant_id").agg(q.alias("_q")).select(
        *keys,
        "contestant_id",
        F.bround(F.col("_q")[0], 0).cast("int").alias("seats_low"),
        F.bround(F.col("_q")[1], 0).cast("int").alias("seats_high"),
    )


def summarise_draws(draws: DataFrame, keys: Sequence[str], contestants: Sequence[str]) -> DataFrame:
    """Full outcome row per key and contestant; add the scenario to ``keys`` for conditionals."""
    by = [*keys, "contestant_id"]
    long = _long(draws, keys, contestants, share="shares")
    spread = quantiles(long, by, "share", {"share_low": 0.05, "share_high": 0.95}, SHARE_BIN)
    return (
        outcome_moments(draws, keys, contestants)
        .join(spread, by)
        .join(seat_quantiles(draws, keys, contestants), by)
    )


def majority_probability(draws: DataFrame, keys: Sequence[str], size: int, majority: str) -> DataFrame:
    """Share of draws whose largest party reaches the majority, and the median turnout."""
    top = F.greatest(*entries("seats", size))
    chance = draws.groupBy(*keys).agg(
        F.count("*").alias("draws"),
        (F.count_if(top >= F.col(majority)) / F.count("*")).alias("majority_probability"),
    )
    median = quantiles(draws, keys, "turnout", {"turnout_median": 0.5}, SHARE_BIN)
    return chance.join(median, list(keys))


def missing_scenarios(draws: DataFrame, scenarios: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Declared scenarios that received no draw; must be empty."""
    return scenarios.select(*keys).distinct().join(draws.select(*keys), list(keys), "left_anti")


def coalitions(
    draws: DataFrame, keys: Sequence[str], contestants: Sequence[str], majority: str
) -> DataFrame:
    """Every member set of two to all-but-one parties: majority chance and seat quantiles.

    Equal seat vectors are merged first, so subsets multiply distinct vectors, not draws.
    """
    size = len(contestants)
    seats = entries("seats", size)
    merged = draws.groupBy(*keys, majority, "seats").agg(F.count("*").alias("_n"))
    cells = [
        F.struct(
            F.lit("+".join(sorted(contestants[i] for i in members))).alias("coalition_key"),
            total([seats[i] for i in members]).alias("held"),
        )
        for members in member_subsets(size)
    ]
    held = (
        merged.select(*keys, majority, "_n", F.explode(F.array(*cells)).alias("_c"))
        .groupBy(*keys, majority, "_c.coalition_key", "_c.held")
        .agg(F.sum("_n").alias("_n"))
    )
    wins = F.sum(F.when(F.col("held") >= F.col(majority), F.col("_n")).otherwise(0))
    q = F.percentile("held", [0.05, 0.5, 0.95], F.col("_n"))
    return held.groupBy(*keys, "coalition_key").agg(
        (wins / F.sum("_n")).alias("majority_probability"), q.alias("_q")
    ).select(
        *keys,
        "coalition_key",
        "majority_probability",
        F.bround(F.col("_q")[0], 0).cast("int").alias("seats_low"),
        F.bround(F.col("_q")[1], 0).cast("int").alias("seats_median"),
        F.bround(F.col("_q")[2], 0).cast("int").alias("seats_high"),
    )
