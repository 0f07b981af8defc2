"""Seat apportionment over long vote tables.

Every window here sees one row per contestant of a contest: callers aggregate votes first, so a
group is bounded by the ballot, whatever the number of votes behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def largest_remainder(
    votes: DataFrame, by: Sequence[str], value: str = "votes", seats: str = "seats", index: str = "party_index"
) -> DataFrame:
    """floor(quota) plus one seat each by descending remainder, ties by index; a contest without votes gives no seats."""
    group = Window.partitionBy(*by)
    total = F.sum(value).over(group)
    quota = F.when(total > 0, F.col(value) / F.when(total > 0, total) * F.col(seats)).otherwise(F.lit(0.0))
    staged = votes.withColumn("_quota", quota).withColumn("_floor", F.floor("_quota").cast("long"))
    staged = staged.withColumn("_left", F.col(seats) - F.sum("_floor").over(group)).withColumn(
        "_rank",
        F.row_number().over(group.orderBy(F.desc(F.col("_quota") - F.col("_floor")), F.col(index))),
    )
    voted = F.sum("_quota").over(group) > 0
    extra = F.when((F.col("_rank") <= F.col("_left")) & voted, 1).otherwise(0)
    return staged.withColumn("allocated", (F.col("_floor") + extra).cast("long")).drop(
        "_quota", "_floor", "_left", "_rank"
    )


def divisor_seats(
    votes: DataFrame,
    by: Sequence[str],
    method: str = "dhondt",
    value: str = "votes",
    seats: str = "seats",
    index: str = "party_index",
) -> DataFrame:
    """D'Hondt or Sainte-Lague: the ``seats`` highest quotients, ties to the earlier party."""
    if method not in ("dhondt", "sainte_lague"):
        raise ValueError(f"unsupported divisor method: {method}")
    n = F.col("_n")
    divisor = n if method == "dhondt" else 2 * n - 1
    places = F.sequence(F.lit(1), F.greatest(F.col(seats).cast("int"), F.lit(1)))  # without seats nothing ranks in
    quotients = votes.withColumn("_n", F.explode(places)).withColumn(
        "_quotient", F.col(value) / divisor.cast("double")
    )
    w = Window.partitionBy(*by).orderBy(F.desc("_quotient"), F.col(index), F.col("_n"))
    ranked = quotients.withColumn("_rank", F.row_number().over(w))
    return ranked.groupBy(*votes.columns).agg(
        F.count_if(F.col("_rank") <= F.col(seats)).alias("allocated")
    )


def passing_votes(by: Sequence[str], threshold: float, value: str = "votes", power: int = 1) -> Column:
    """Votes of parties at or above the threshold share; all of them where none passes."""
    if not 0 <= threshold < 1:
        raise ValueError("threshold must be in [0, 1)")
    group = Window.partitionBy(*by)
    total = F.sum(value).over(group)
    share = F.when(total > 0, F.col(value) / F.when(total > 0, total)).otherwise(F.lit(0.0))
    none_pass = F.max(F.when(share >= threshold, 1).otherwise(0)).over(group) == 0
    kept = F.when((share >= threshold) | none_pass, share).otherwise(F.lit(0.0))
    return F.pow(kept, F.lit(power)) if power > 1 else kept


def proportional_seats(votes: DataFrame, by: Sequence[str], threshold: float, power: int = 1) -> DataFrame:
    """Threshold (and, for proxies, a power) applied to shares, then largest remainder."""
    staged = votes.withColumn("_eligible", passing_votes(by, threshold, power=power))
    return largest_remainder(staged, by, value="_eligible").drop("_eligible")


def plurality_seats(unit_votes: DataFrame, unit: Sequence[str], contest: Sequence[str]) -> DataFrame:
    """The first of each unit takes all of its seats, summed per contest and party."""
    winners = unit_votes.groupBy(*contest, *unit).agg(
        F.max_by(
            F.struct("party", "party_index", "seats"), F.struct("votes", -F.col("party_index"))
        ).alias("_w")
    )
    won = winners.groupBy(*contest, F.col("_w.party").alias("party")).agg(
        F.sum("_w.seats").cast("long").alias("allocated")
    )
    parties = unit_votes.select(*contest, "party").distinct()
    return parties.join(won, [*contest, "party"], "left").withColumn(
        "allocated", F.coalesce("allocated", F.lit(0).cast("long"))
    )


def mixed_member(votes: DataFrame, by: Sequence[str], threshold: float, district: str = "district_seats") -> DataFrame:
    """Proportional entitlement of a fixed-size chamber, with district totals checked."""
    staged = proportional_seats(votes, by, threshold)
    group = Window.partitionBy(*by)
    bad = (F.min(district).over(group) < 0) | (F.sum(district).over(group) > F.col("seats"))
    return staged.withColumn("district_violation", bad)


def runoff(shares: DataFrame, by: Sequence[str], value: str = "share", index: str = "party_index") -> DataFrame:
    """Second-round shares: two finalists split the eliminated share in proportion to their own."""
    group = Window.partitionBy(*by)
    ranked = shares.withColumn("_rank", F.row_number().over(group.orderBy(F.desc(value), F.col(index))))
    final = F.when(F.col("_rank") <= 2, F.col(value)).otherwise(F.lit(0.0))
    staged = ranked.withColumn("_final", final).withColumn("_pair", F.sum("_final").over(group))
    everyone = F.sum(value).over(group)
    return staged.withColumn("_all", everyone).withColumn(
        "runoff_share", F.col("_final") + (F.col("_all") - F.col("_pair")) * F.coalesce(F.try_divide("_final", "_pair"), F.lit(0.0))
    ).withColumn("finalist", F.col("_rank") <= 2).drop("_rank", "_final", "_pair", "_all")


def argmax_first(df: DataFrame, keys: Sequence[str], value: str, index: str, pick: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.max_by(pick, F.struct(F.col(value), -F.col(index))).alias(pick), F.max(value).alias(value)
    )


def project_seats(votes: DataFrame, by: Sequence[str], threshold: float, system: str = "system") -> DataFrame:
    """Seats by each contest's declared system: threshold, the system's power, largest remainder."""
    passing = passing_votes(by, threshold)
    weight = (
        F.when(F.col(system) == "fptp", F.pow("_pass", F.lit(3)))
        .when(F.col(system) == "electoral_college", F.pow("_pass", F.lit(4)))
        .otherwise(F.col("_pass"))
    )
    staged = votes.withColumn("_pass", passing).withColumn("_weight", weight)
    return largest_remainder(staged, by, value="_weight").drop("_pass", "_weight")
