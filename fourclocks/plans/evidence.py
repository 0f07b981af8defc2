"""From point-in-time observations and polls to the inputs of a forecast, all elections at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourclocks.functions.shares import blend, effective_volatility, entries, horizon_scale
from fourclocks.functions.text import content_hash, missing_drivers
from fourclocks.operators.asof import asof_filter, lineage_verified, newest, polls_asof
from fourclocks.operators.contracts import quality_grade
from fourclocks.operators.polls import adjusted_polls, covariance_columns, mean_columns, poll_moments
from fourclocks.operators.reporting import feature_column

FEATURE_ORDER = ("available_at", "observed_at", "revision", "metric")


def selected_features(observations: DataFrame, cutoffs: DataFrame, specs: Mapping[str, Sequence[str]]) -> DataFrame:
    """Newest eligible observation per election and feature among the feature's metrics.

    observations: jurisdiction_id, metric, value, revision, revision_id and the clocks.
    cutoffs: election_id, jurisdiction_id, as_of. Metrics outside the specs go before the join.
    """
    known = [m for metrics in specs.values() for m in metrics]
    wanted = observations.where(F.col("metric").isin(*known)).withColumn("feature", feature_column(specs))
    timely = asof_filter(wanted.join(cutoffs, "jurisdiction_id"), F.col("as_of"), ("available_at", "observed_at"))
    keep = ["election_id", "as_of", "feature", "metric", "value", "revision", "revision_id", "observed_at", "available_at"]
    return newest(timely.select(*keep), ["election_id", "as_of", "feature"], FEATURE_ORDER)


def feature_snapshots(observations: DataFrame, cutoffs: DataFrame, specs: Mapping[str, Sequence[str]]) -> DataFrame:
    """One snapshot per election and cutoff: features, gaps, completeness, revisions and hash.

    The lists hold at most one entry per feature spec. Elections without any eligible
    observation keep a row with every feature missing.
    """
    chosen = selected_features(observations, cutoffs, specs)
    grouped = chosen.groupBy("election_id", "as_of").agg(
        F.array_sort(F.collect_list(F.struct("feature", "metric", "value", "revision_id"))).alias("features"),
        F.array_sort(F.collect_set("revision_id")).alias("source_revision_ids"),
    )
    empty_features = F.array().cast(grouped.schema["features"].dataType)
    empty_ids = F.array().cast(grouped.schema["source_revision_ids"].dataType)
    names = F.array(*[F.lit(f) for f in sorted(specs)])
    staged = cutoffs.select("election_id", "as_of").join(grouped, ["election_id", "as_of"], "left").withColumns(
        {
            "features": F.coalesce("features", empty_features),
            "source_revision_ids": F.coalesce("source_revision_ids", empty_ids),
        }
    )
    present = F.transform("features", lambda f: f["feature"])
    text = F.array_join(
        F.transform("features", lambda f: F.concat_ws(":", f["feature"], f["metric"], f["value"].cast("string"), f["revision_id"].cast("string"))),
        ",",
    )
    return staged.withColumns(
        {
            "missing_features": F.array_except(names, present),
            "completeness": F.size("features") / F.lit(float(len(specs))),
            "content_sha256": content_hash(F.col("election_id"), text),
        }
    )


def model_evidence(
    snapshots: DataFrame, polls: DataFrame, known_revisions: DataFrame, size: int, half_life_days: float = 21.0
) -> DataFrame:
    """Latest feature snapshot per election with its polls as of the same cutoff, lineage checked.

    polls: election_id, poll_key, revision, pollster, mode, fieldwork_end, available_at,
    sample_size, shares. known_revisions: revision.
    """
    latest = newest(snapshots, ["election_id"], ["as_of", "content_sha256"])
    cutoffs = latest.select("election_id", "as_of")
    chosen = polls_asof(polls, cutoffs)
    moments = poll_moments(adjusted_polls_at(chosen, size, half_life_days), size)
    matrix = covariance_columns(size)
    aggregates = moments.where(F.col("poll_count") > 0).select(
        "election_id",
        "poll_count",
        "effective_n",
        "latest_available_at",
        F.array(*mean_columns(size)).alias("poll_shares"),
        F.greatest(*[matrix[i][i] for i in range(size)]).alias("poll_variance"),
    )
    lineage = lineage_verified(chosen, known_revisions, ["election_id"], "revision")
    joined = latest.join(aggregates, "election_id", "left").join(lineage, "election_id", "left")
    return joined.withColumn(
        "evidence_sha256",
        content_hash(F.col("content_sha256"), F.col("poll_count"), F.col("requested"), F.col("found")),
    )


def adjusted_polls_at(polls: DataFrame, size: int, half_life_days: float) -> DataFrame:
    """Poll weights at each row's own ``as_of``."""
    return adjusted_polls(polls, size, F.col("as_of"), half_life_days)


def forecast_inputs(packs: DataFrame, evidence: DataFrame, size: int, poll_weight: Column) -> DataFrame:
    """Blended base shares, scaled volatility, grade, freshness text and report gaps per election.

    packs: election_id, election_date, base_shares, volatility, reference_days,
    configured_quality, drivers (array<struct<label, confidence>>).
    """
    joined = packs.join(evidence, "election_id", "left")
    has_poll = F.col("poll_shares").isNotNull()
    mixed = blend(entries("base_shares", size), entries("poll_shares", size), poll_weight)
    horizon = F.greatest(F.lit(0), F.datediff("election_date", F.col("as_of").cast("date")))
    age = F.greatest(F.lit(0), F.datediff(F.col("as_of").cast("date"), F.col("latest_available_at").cast("date")))
    none = F.lit(None).cast("double")
    staged = joined.withColumns(
        {
            "horizon_days": horizon,
            "poll_age_days": F.when(has_poll, age),
            "blended_shares": F.when(has_poll, F.array(*mixed)).otherwise(F.col("base_shares")),
            "effective_volatility": effective_volatility(
                F.col("volatility"),
                horizon_scale(horizon, 90.0),
                F.when(has_poll, F.col("poll_variance")).otherwise(none),
            ),
            "has_inputs": F.size("source_revision_ids") > 0,
            "campaign_steps": F.greatest(F.lit(1), F.least(F.lit(24), F.ceil(horizon / 7))).cast("int"),
        }
    )
    graded = quality_grade(staged)
    return graded.withColumn(
        "missing_drivers",
        missing_drivers(F.col("drivers"), F.col("missing_features"), F.col("poll_age_days"), F.col("configured_quality")),
    )
