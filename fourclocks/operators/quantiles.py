"""Exact order statistics without gathering a group in one task.

Values fall into bins of a given width; a histogram (map-side combined) tells which bin holds each wanted rank. Those
bins are cut into parts and counted again, and only the rows of the parts that hold a rank are ordered, after equal values
have been merged. The width has to keep the bins of a key to some thousands, as they are summed up in order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fourclocks.session import cut_lineage

#: Parts of a bin that holds a wanted rank.
PARTS = 1024


def _holding(cells: DataFrame, wanted: DataFrame, within: Sequence[str], step: str) -> DataFrame:
    """``wanted`` with the cell of ``within`` that holds its rank; ``_before`` grows by the rows in front of that cell."""
    ordered = Window.partitionBy(*within).orderBy(step)
    summed = cells.select(*within, step, "_m", F.sum("_m").over(ordered).alias("_end"))
    local = F.col("rank") - F.col("_before")
    return (
        wanted.join(summed, list(within))
        .where((local >= F.col("_end") - F.col("_m")) & (local < F.col("_end")))
        .withColumn("_before", F.col("_before") + F.col("_end") - F.col("_m"))
        .drop("_m", "_end")
    )


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, Column],
    width: float,
) -> DataFrame:
    """Values at 0-based ``ranks`` (name -> expression over ``_total``), one row per key and name."""
    place = (F.col(value) / F.lit(width)).cast("double")
    part = F.floor((place - F.floor(place)) * PARTS).cast("int")
    # bins, parts and values read these rows in turn: what they come from is computed once
    binned = cut_lineage(
        df.where(F.col(value).isNotNull()).select(
            *keys, F.col(value).alias("_v"), F.floor(place).cast("long").alias("_bin"), part.alias("_part")
        )
    )
    per_key = Window.partitionBy(*keys)
    histogram = (
        binned.groupBy(*keys, "_bin")
        .agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(per_key.orderBy("_bin")))
        .withColumn("_total", F.sum("_n").over(per_key))
    )
    wanted = histogram.select(
        *keys,
        "_bin",
        (F.col("_upto") - F.col("_n")).alias("_before"),
        "_upto",
        "_total",
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("stat"), r.cast("long").alias("rank")) for n, r in ranks.items()])
        ).alias("_w"),
    ).select("*", "_w.stat", "_w.rank")
    wanted = wanted.where((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_upto")))
    wanted = wanted.select(*keys, "_bin", "_before", "stat", "rank", F.col("_total").alias("total"))
    in_bin, in_part = [*keys, "_bin"], [*keys, "_bin", "_part"]
    inside = binned.join(wanted.select(*in_bin).distinct(), in_bin, "left_semi")
    parts = _holding(inside.groupBy(*in_part).agg(F.count("*").alias("_m")), wanted, in_bin, "_part")
    values = inside.join(parts.select(*in_part).distinct(), in_part, "left_semi")
    found = _holding(values.groupBy(*in_part, "_v").agg(F.count("*").alias("_m")), parts, in_part, "_v")
    return found.select(*keys, "stat", "rank", "total", F.col("_v").alias("value"))


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], width: float
) -> DataFrame:
    """One row per key with linearly interpolated quantiles (name -> probability)."""
    ranks: dict[str, Column] = {}
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("_total") - 1)
        ranks[f"{name}|lo"] = F.floor(position)
        ranks[f"{name}|hi"] = F.ceil(position)
    stats = order_statistics(df, keys, value, ranks, width)
    columns = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.first("total") - 1)
        low = F.max(F.when(F.col("stat") == f"{name}|lo", F.col("value")))
        high = F.max(F.when(F.col("stat") == f"{name}|hi", F.col("value")))
        columns.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return stats.groupBy(*keys).agg(*columns)


def counted_quantiles(value: Column, probs: Sequence[float], weight: Column) -> Column:
    """Quantiles of values that were already merged to few (value, count) rows."""
    return F.percentile(value, [float(p) for p in probs], weight)
