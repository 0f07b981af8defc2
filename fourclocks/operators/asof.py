"""As-of selection, revision choice, lineage and interval joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fourclocks.session import stored

CLOCKS = ("observed_at", "available_at", "retrieved_at")


def eligible(clocks: Sequence[str], cutoff: Column) -> Column:
    """True when every clock is at or before the cutoff."""
    test = F.lit(True)
    for clock in clocks:
        test = test & (F.col(clock) <= cutoff)
    return test


def asof_filter(df: DataFrame, cutoff: Column, clocks: Sequence[str] = CLOCKS) -> DataFrame:
    return df.where(eligible(clocks, cutoff))


def omitted_counts(
    df: DataFrame, keys: Sequence[str], cutoff: Column, clocks: Sequence[str] = CLOCKS
) -> DataFrame:
    """Rows kept and rows left out by the cutoff, per key."""
    ok = F.coalesce(eligible(clocks, cutoff), F.lit(False))
    return df.groupBy(*keys).agg(
        F.count_if(ok).alias("eligible"), F.count_if(~ok).alias("omitted")
    )


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` tuple per key; partial maxima before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def asof_latest(
    df: DataFrame,
    keys: Sequence[str],
    cutoff: Column,
    order: Sequence[str] = ("available_at", "observed_at", "revision", "metric"),
    clocks: Sequence[str] = CLOCKS,
) -> DataFrame:
    return newest(asof_filter(df, cutoff, clocks), keys, order)


def polls_asof(
    polls: DataFrame,
    cutoffs: DataFrame,
    key: Sequence[str] = ("election_id", "poll_key"),
    revision: str = "revision",
) -> DataFrame:
    """Clocks first, then the highest revision per poll. ``cutoffs``: (election_id, as_of)."""
    timely = polls.join(cutoffs, "election_id").where(
        (F.col("available_at") <= F.col("as_of")) & (F.col("fieldwork_end") <= F.col("as_of"))
    )
    return newest(timely, key, [revision, "available_at"])


def with_lineage(facts: DataFrame, revisions: DataFrame, sources: DataFrame, revision_id: str, source_id: str) -> DataFrame:
    """fact -> revision -> source, inner on both steps."""
    return facts.join(revisions, revision_id).join(sources, source_id)


def walk_forward_pairs(records: DataFrame, series: str = "series_id") -> DataFrame:
    """(test origin, usable training origin): earlier election, result out by the test cutoff.

    Equi join on the series; the residual condition prunes. An election history has at most one
    election per date, so the pairs are bounded by the calendar, not by the size of the raw data.
    """
    test = records.select(
        series,
        F.col("election_id").alias("test_election_id"),
        F.col("election_date").alias("test_date"),
        F.col("forecast_as_of").alias("test_as_of"),
    )
    return test.join(records, series).where(
        (F.col("election_date") < F.col("test_date"))
        & (F.col("result_available_at") <= F.col("test_as_of"))
    )


def nearest_origin(pairs: DataFrame, tolerance) -> DataFrame:
    """Per test origin and prior election the origin with the closest horizon, if comparable."""
    target = F.datediff("test_date", "test_as_of")
    horizon = F.datediff("election_date", "forecast_as_of")
    scored = pairs.withColumn("_gap", F.abs(horizon - target)).withColumn("_target", target)
    keys = ["series_id", "test_election_id", "test_date", "test_as_of", "election_id"]
    rest = [c for c in scored.columns if c not in keys]
    best = (
        scored.groupBy(*keys)
        .agg(
            F.min_by(
                F.struct(*rest), F.struct("_gap", -F.unix_date("forecast_as_of"))
            ).alias("_row")
        )
        .select(*keys, "_row.*")
    )
    return (
        best.where(F.col("_gap") <= tolerance(F.col("_target")))
        .withColumnRenamed("_gap", "horizon_gap")
        .drop("_target")
    )


def window_days(windows: DataFrame, start: str, end: str, day: str = "day") -> DataFrame:
    """One row per day of each closed window, so that an interval join becomes an equi join."""
    return windows.withColumn(day, F.explode(F.sequence(F.col(start), F.col(end))))


def map_with_default(
    df: DataFrame, column: str, mapping: Mapping[str, object], default: object, name: str
) -> DataFrame:
    """Lookup in a small literal mapping, with a default for unknown keys."""
    flat = [F.lit(x) for pair in mapping.items() for x in pair]
    found = F.try_element_at(F.create_map(*flat), F.col(column))
    return df.withColumn(name, F.coalesce(found, F.lit(default)))


def lookup_join(df: DataFrame, dim: DataFrame, key: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """Left lookup in a table, with defaults for the looked-up columns."""
    joined = df.join(dim, list(key), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def override(base: DataFrame, latest: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Replace base columns by the latest revision where there is one, flagging changes."""
    renamed = latest.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(renamed, list(keys), "left")
    changed = F.lit(False)
    for c in columns:
        changed = changed | (F.col(f"_new_{c}").isNotNull() & ~F.col(f"_new_{c}").eqNullSafe(F.col(c)))
    out = joined.withColumn("changed", changed)
    out = out.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns})
    return out.drop(*[f"_new_{c}" for c in columns])


def unknown_refs(df: DataFrame, dim: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct references without a target; a null reference has none.

    Both sides shrink to distinct references in one aggregate, before and after its shuffle: repeats are not sorted for a join.
    """
    whole = reduce(and_, [F.col(c).isNotNull() for c in key])
    used = df.select(*key, F.lit(True).alias("_used"), F.lit(False).alias("_known"))
    known = dim.select(*key).where(whole).select(*key, F.lit(False).alias("_used"), F.lit(True).alias("_known"))
    seen = used.unionByName(known).groupBy(*key).agg(F.bool_or("_used").alias("_used"), F.bool_or("_known").alias("_known"))
    return seen.where(F.col("_used") & ~F.col("_known")).select(*[F.col(c).cast(df.schema[c].dataType) for c in key])


def lineage_verified(wanted: DataFrame, known: DataFrame, owner: Sequence[str], ref: str) -> DataFrame:
    """Per owner: distinct revisions asked for, how many are known, and whether all are."""
    asked = wanted.select(*owner, ref).distinct()
    hits = asked.join(known.select(ref).distinct().withColumn("_known", F.lit(1)), ref, "left")
    return (
        hits.groupBy(*owner)
        .agg(F.count("*").alias("requested"), F.count("_known").alias("found"))
        .withColumn("verified", F.col("requested") == F.col("found"))
    )


def origin_grid(elections: DataFrame, horizons: Sequence[int], offsets: Sequence[int] = (0,)) -> DataFrame:
    """Every election at every horizon and snapshot offset (days); both lists are literals."""
    return (
        elections.withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons])))
        .withColumn("offset_days", F.explode(F.array(*[F.lit(o) for o in offsets])))
        .withColumn("forecast_as_of", F.date_sub("election_date", F.col("horizon_days")))
        .withColumn("snapshot_date", F.date_sub("forecast_as_of", F.col("offset_days")))
    )


def merge_catalog(left: DataFrame, right: DataFrame, key: str, fallbacks: Sequence[str]) -> DataFrame:
    """Full outer merge: left values first, right as fallback, with where each row came from."""
    a = left.select(key, *[F.col(c).alias(f"_l_{c}") for c in fallbacks], F.lit(True).alias("_in_left"))
    b = right.select(key, *[F.col(c).alias(f"_r_{c}") for c in fallbacks], F.lit(True).alias("_in_right"))
    both = a.join(b, key, "full")
    origin = (
        F.when(F.col("_in_left") & F.col("_in_right"), "both")
        .when(F.col("_in_left"), "catalog-only")
        .otherwise("eligible-only")
    )
    return both.select(
        key,
        *[F.coalesce(F.col(f"_l_{c}"), F.col(f"_r_{c}")).alias(c) for c in fallbacks],
        origin.alias("origin"),
    )


def unit_levels(units: DataFrame) -> DataFrame:
    """Depth of each unit below its root, however deep; status tells why there is none.

    ``ok``, ``missing_parent`` (the unit's own parent is unknown), ``missing_ancestor`` (one further up is) or
    ``unreachable`` (no root, as the chain is a cycle).
    Pointer doubling over the units that are somebody's parent: every round doubles the climbed steps of the pointers that
    have not ended, so a chain of n units takes log2(n) joins. A chain has a unit at each distance from its end; once a round
    ends no pointer, those that are left are on cycles or lead into one.
    """
    units = stored(units)
    base = units.select("unit_id", "parent_id")
    parents = base.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("unit_id")).distinct()
    inner = stored(base.join(parents, "unit_id", "left_semi").select("unit_id", F.col("parent_id").alias("_up")))
    known = inner.select(F.col("unit_id").alias("_up"), F.lit(True).alias("_hit"))
    # tops need no join, in which their null keys would meet in one task
    tops = inner.where(F.col("_up").isNull()).withColumn("_hit", F.lit(None).cast("boolean"))
    climbing = inner.where(F.col("_up").isNotNull()).join(known, "_up", "left").select("unit_id", "_up", "_hit")
    jumps = stored(
        climbing.unionByName(tops).select(
            "unit_id",
            F.when(F.col("_hit"), F.col("_up")).alias("_up"),
            F.when(F.col("_hit"), 1).otherwise(0).cast("long").alias("_steps"),
            (F.col("_up").isNotNull() & F.col("_hit").isNull()).alias("_lost"),
        )
    )
    at_end = jumps.where(F.col("_up").isNull())
    while True:
        open_ = jumps.where(F.col("_up").isNotNull())
        n_ended, n_open = jumps.agg(F.count_if(F.col("_up").isNull()), F.count("_up")).first()
        if not n_open or not n_ended:
            break
        onward = at_end.unionByName(open_).select(
            F.col("unit_id").alias("_up"), F.col("_up").alias("_to"), F.col("_steps").alias("_more"), F.col("_lost").alias("_gone")
        )
        jumps = stored(
            open_.join(onward, "_up").select(
                "unit_id",
                F.col("_to").alias("_up"),
                (F.col("_steps") + F.col("_more")).alias("_steps"),
                (F.col("_lost") | F.col("_gone")).alias("_lost"),
            )
        )
        at_end = at_end.unionByName(jumps.where(F.col("_up").isNull()))
    climbed = at_end.unionByName(open_)
    found = climbed.select(F.col("unit_id").alias("parent_id"), F.col("_up").isNotNull().alias("_round"), "_steps", "_lost")
    status = (
        F.when(F.col("_steps").isNull(), "missing_parent")
        .when(F.col("_round"), "unreachable")
        .when(F.col("_lost"), "missing_ancestor")
        .otherwise("ok")
    )
    depth = F.when(status == "ok", F.col("_steps") + 1).otherwise(-1)
    roots = units.where(F.col("parent_id").isNull()).select("*", F.lit(0).alias("depth"), F.lit("ok").alias("status"))
    below = units.where(F.col("parent_id").isNotNull()).join(found, "parent_id", "left")
    return roots.unionByName(below.select(*units.columns, depth.cast("int").alias("depth"), status.alias("status")))


def interval_join(points: DataFrame, windows: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Points whose day lies in a closed window of the same key, through the window's days."""
    spread = window_days(windows, "window_start", "window_end", day)
    return points.join(spread, [*keys, day])


def nest(df: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    """Ordered array of structs per parent. Children must be bounded by a declared dimension."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def published_forecasts(
    runs: DataFrame, elections: DataFrame, outcomes: DataFrame, coalitions: DataFrame
) -> DataFrame:
    """Validated runs with their election and two ordered nested collections, empty when absent."""
    kept = runs.where(F.col("status") == "validated").join(elections, "election_id")
    return (
        kept.join(outcomes, "snapshot_id", "left")
        .join(coalitions, "snapshot_id", "left")
        .withColumn("outcomes", F.coalesce("outcomes", F.array().cast(outcomes.schema["outcomes"].dataType)))
        .withColumn("coalitions", F.coalesce("coalitions", F.array().cast(coalitions.schema["coalitions"].dataType)))
    )


def official_snapshot(feed: DataFrame, units: DataFrame, contestants: DataFrame, sources: DataFrame) -> DataFrame:
    """Latest row per unit and contestant with its unit, contestant and source."""
    latest = newest(feed, ["unit_id", "contestant_id"], ["reported_at", "event_id"])
    return latest.join(units, "unit_id").join(contestants, "contestant_id").join(sources, "source_id")


def scope(df: DataFrame, allow: DataFrame, key: str, managed: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows of allow-listed keys, managed fields taking precedence over their own."""
    kept = df.join(allow.select(key), key, "left_semi")
    return override(kept, managed, [key], fields)


def run_manifest(elections: DataFrame, evidence: DataFrame, simulations: int = 1_000_000) -> DataFrame:
    """Enabled elections with their evidence, input count and the constant run settings."""
    joined = elections.where("forecast_enabled").join(evidence, "election_id", "left")
    return joined.withColumns(
        {
            "input_count": F.coalesce("input_count", F.lit(0).cast("long")),
            "simulation_count": F.lit(simulations),
            "model_family": F.lit("baseline_ensemble"),
        }
    )


def replay_after(df: DataFrame, order: Sequence[str], id_column: str, last_id) -> DataFrame:
    """Rows after a given id in publish order; an unknown id replays everything."""
    position = F.struct(*order)
    marker = df.where(F.col(id_column) == F.lit(last_id)).agg(F.max(position).alias("m"))
    return df.where(F.coalesce(position > marker.scalar(), F.lit(True)))
