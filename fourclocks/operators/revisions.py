"""Revision numbering, idempotent appends and other keyed-set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fourclocks.operators.segments import previous_values, running_totals
from fourclocks.session import stored


def number_revisions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    hash_column: str,
    segment: Column,
    mode: str = "latest",
) -> DataFrame:
    """Add ``revision``.

    latest: a new number whenever the hash differs from the row before (A, B, A gives 0, 1, 2).
    any: a new number only for a hash the key never showed (A, B, A gives 0, 1, 0).
    """
    if mode == "latest":
        # a row's segment is looked up once; both passes and their summaries read it
        cut = stored(df.withColumn("_cut", segment))
        seen = previous_values(cut, keys, order, {"_before": hash_column}, F.col("_cut"))
        is_new = F.when(F.col("_before").eqNullSafe(F.col(hash_column)), 0).otherwise(1)
        counted = running_totals(seen, keys, order, {"_steps": is_new}, F.col("_cut"))
        return counted.withColumn("revision", (F.col("_steps") - 1).cast("long")).select(
            *df.columns, "revision"
        )
    if mode != "any":
        raise ValueError("mode must be 'latest' or 'any'")
    marked = df.withColumn("_seg0", segment)
    first = marked.groupBy(*keys, hash_column).agg(
        F.min(F.struct(*order)).alias("_first"), F.min("_seg0").alias("_seg0")
    ).select(*keys, hash_column, "_seg0", "_first.*")
    numbered = running_totals(first, keys, order, {"_steps": F.lit(1)}, F.col("_seg0"))
    numbers = numbered.select(*keys, hash_column, (F.col("_steps") - 1).cast("long").alias("revision"))
    return df.join(numbers, [*keys, hash_column])


def append_rows(existing: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows an idempotent append would insert: unseen natural keys, the smallest row of each (as JSON text)."""
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    single = rows.groupBy(*keys).agg(F.min_by(rest, F.to_json(rest)).alias("_row")) if len(rows.columns) > len(keys) else rows.distinct()
    if "_row" in single.columns:
        single = single.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in rows.columns])
    return single.join(existing.select(*keys), list(keys), "left_anti")


def resolve_ids(new: DataFrame, existing: DataFrame, keys: Sequence[str], id_column: str) -> DataFrame:
    """Id per natural key: the stored one if there is any, else the one just inserted."""
    both = existing.select(*keys, id_column, F.lit(0).alias("_p")).unionByName(
        new.select(*keys, id_column, F.lit(1).alias("_p"))
    )
    return both.groupBy(*keys).agg(
        F.min_by(id_column, F.struct("_p", id_column)).alias(id_column),
        (F.min("_p") == 1).alias("inserted"),
    )


def union_batches(*batches: DataFrame) -> DataFrame:
    out = batches[0]
    for batch in batches[1:]:
        out = out.unionByName(batch)
    return out


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys), list(keys), "left_anti")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def is_subset(required: Column, declared: Column) -> Column:
    return F.size(F.array_except(required, declared)) == 0


def match_member_set(df: DataFrame, column: str, members: Sequence[str]) -> DataFrame:
    wanted = F.array(*[F.lit(m) for m in sorted(members)])
    return df.where(F.sort_array(F.col(column)) == wanted)


def movement(df: DataFrame, keys: Sequence[str], order: str, value: str, eps: float = 0.003) -> DataFrame:
    """Movement state between consecutive snapshots of calendar-bounded series."""
    from fourclocks.functions.shares import movement_state

    w = Window.partitionBy(*keys).orderBy(order)
    return (
        df.withColumn("previous", F.lag(value).over(w))
        .where(F.col("previous").isNotNull())
        .withColumn("state", movement_state(F.col("previous"), F.col(value), eps))
    )


def monotonic_violations(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    votes: str = "votes",
    fraction: str = "reporting_fraction",
    reported: str = "reported_at",
) -> DataFrame:
    """Rows that fall behind their predecessor, with the reason."""
    held = {"_votes": votes, "_fraction": fraction, "_reported": reported}
    seen = previous_values(df, keys, order, held, segment)
    same_time = F.col(reported) == F.col("_reported")
    differs = (F.col(votes) != F.col("_votes")) | (F.col(fraction) != F.col("_fraction"))
    reason = (
        F.when(F.col(reported) < F.col("_reported"), "time_regressed")
        .when(F.col(votes) < F.col("_votes"), "votes_regressed")
        .when(F.col(fraction) < F.col("_fraction"), "fraction_regressed")
        .when(same_time & differs, "conflicting_same_time")
    )
    return (
        seen.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .drop("_fraction", "_reported")
        .withColumnRenamed("_votes", "previous_votes")
    )
