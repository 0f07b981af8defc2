"""Counts and status tables for operations and publication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourclocks.operators.quantiles import order_statistics
from fourclocks.operators.segments import running_totals

# Event classes counted as conflict, and latency bounds in seconds.
CONFLICT_CLASSES = (3, 4)
LATENCY_BOUNDS = (0.05, 0.1, 0.25, 0.3, 0.5, 1.0, 2.5, 5.0)


def security_aggregates(events: DataFrame) -> DataFrame:
    """Per country: events, conflict events, mentions, mean tone and mean score; blanks dropped."""
    rows = events.where(F.trim(F.coalesce("country", F.lit(""))) != "")
    return rows.groupBy("country").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("event_class").isin(*CONFLICT_CLASSES)).alias("conflicts"),
        F.sum("mentions").alias("mentions"),
        F.avg("tone").alias("tone"),
        F.avg("score").alias("score"),
    )


def run_health(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Failures and last success (epoch seconds) per key."""
    failed, ok = F.col("status") == "failure", F.col("status") == "success"
    return runs.groupBy(*keys).agg(
        F.count_if(failed).alias("failures"),
        (F.unix_micros(F.max(F.when(ok, F.col("occurred_at")))) / 1e6).alias("last_success"),
    )


def catalog_status(df: DataFrame) -> DataFrame:
    status = F.col("coverage_status")
    return df.agg(
        F.count("*").alias("jurisdictions"),
        F.count_if(status == "forecast").alias("forecast"),
        F.count_if(status == "calendar_only").alias("calendar_only"),
        F.count_if(status == "mechanics_blocked").alias("mechanics_blocked"),
    )


def feature_column(specs: Mapping[str, Sequence[str]], metric: str = "metric") -> Column:
    """The feature a metric feeds, null for metrics outside the specs."""
    chain = F.lit(None).cast("string")
    for feature, metrics in specs.items():
        chain = F.when(F.col(metric).isin(*metrics), feature).otherwise(chain)
    return chain


def completeness(observed: DataFrame, keys: Sequence[str], specs: Mapping[str, Sequence[str]]) -> DataFrame:
    """Features present out of the required ones, and the sorted names of the missing."""
    seen = {f: F.max(F.when(F.col("metric").isin(*m), 1).otherwise(0)) for f, m in specs.items()}
    wide = observed.groupBy(*keys).agg(*[c.alias(f"_{f}") for f, c in seen.items()])
    present = sum((F.col(f"_{f}") for f in specs), F.lit(0))
    absent = F.array_compact(F.array(*[F.when(F.col(f"_{f}") == 0, f) for f in sorted(specs)]))
    return wide.select(
        *keys,
        present.alias("present"),
        F.lit(len(specs)).alias("required"),
        (present / F.lit(len(specs))).alias("completeness"),
        absent.alias("missing"),
    )


def provenance(df: DataFrame, keys: Sequence[str], source: Sequence[str], order: str, segment: Column) -> DataFrame:
    """Distinct sources per key as rows, numbered in first-seen order.

    ``segment`` is an expression over ``first_seen`` that never falls as it rises. Sources are numbered inside a segment and
    one row per segment carries the count on, so that no task orders all sources of a key.
    """
    first = df.groupBy(*keys, *source).agg(F.min(order).alias("first_seen"))
    numbered = running_totals(first, keys, ["first_seen", *source], {"position": F.lit(1)}, segment)
    return numbered.select(*keys, *source, "first_seen", F.col("position").cast("int").alias("position"))


def status_rollup(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Certified only when every row is; the furthest fraction and time; parser versions joined.

    Parser versions are a handful per source, so their set is small whatever the row count.
    """
    return df.groupBy(*keys).agg(
        F.when(F.bool_and("is_certified"), "certified").otherwise("live").alias("status"),
        F.max("reporting_fraction").alias("reporting_fraction"),
        F.max("reported_at").alias("reported_at"),
        F.array_join(F.sort_array(F.collect_set("parser_version")), "+").alias("parser_version"),
    )


def latency_histogram(df: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative bucket counts with +Inf, sum and count, one row per key and bound."""
    counts = df.groupBy(*keys).agg(
        *[F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count("*").alias("total"),
        F.sum(value).alias("total_seconds"),
    )
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("hits")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("hits")))
    return counts.select(*keys, "total", "total_seconds", F.explode(F.array(*cells)).alias("_c")).select(
        *keys, "_c.le", "_c.hits", "total", "total_seconds"
    )


def latency_p95(df: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """The sorted value at index floor(0.95 n) - 1, exactly."""
    rank = F.greatest(F.floor(F.lit(0.95) * F.col("_total")) - 1, F.lit(0))
    found = order_statistics(df, keys, value, {"p95": rank}, width)
    return found.select(*keys, F.col("value").alias("p95"))


def freshness(df: DataFrame, keys: Sequence[str], published: str, now: Column) -> DataFrame:
    """Seconds since the latest publication, never negative."""
    age = now.cast("timestamp").cast("double") - F.max(F.col(published).cast("timestamp")).cast("double")
    return df.groupBy(*keys).agg(F.greatest(age, F.lit(0.0)).alias("age_seconds"))


def batch_counts(df: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """Records received and distinct contents to insert per batch.

    Two-step distinct: contents collapse on (batch, content) before they are counted.
    """
    merged = df.groupBy(*keys, content).agg(F.count("*").alias("_n"))
    return merged.groupBy(*keys).agg(F.sum("_n").alias("records"), F.count("*").alias("inserted"))
