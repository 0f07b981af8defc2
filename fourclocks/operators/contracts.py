"""Data contracts: each returns violations or flagged rows, nothing raises inside a plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Allowed names and limits of the published contracts.
SIMULATIONS = 1_000_000
SEATED_SYSTEMS = ("fptp", "proportional", "mixed_member", "electoral_college")
UNRESOLVED_STATES = ("mechanics_blocked", "exploratory_proxy")
DISABLED_COVERAGE = ("calendar_only", "mechanics_blocked")
DEFAULT_BLOCKING = "Forecast publication requirements remain unresolved"
MAX_POLL_AGE_DAYS = 45
HEX64 = "^[0-9a-f]{64}$"


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def rule_rows(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """(keys, rule, ok) for every row and rule; an undecidable rule counts as broken."""
    cells = [F.struct(F.lit(name).alias("rule"), flag(ok).alias("ok")) for name, ok in rules.items()]
    return df.select(*keys, F.explode(F.array(*cells)).alias("_r")).select(*keys, "_r.rule", "_r.ok")


def violations(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    return rule_rows(df, keys, rules).where(~F.col("ok")).drop("ok")


def parse_confidence(df: DataFrame, keys: Sequence[str], valid: Column, minimum: float) -> DataFrame:
    """Valid share of the parsed rows per key, and whether it reaches the gate."""
    out = df.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(valid).alias("valid"))
    out = out.withColumn("confidence", F.col("valid") / F.col("total"))
    return out.withColumn("passes", F.col("confidence") >= minimum)


def missing_fields(df: DataFrame, required: Sequence[str], name: str = "missing") -> DataFrame:
    """Names of the required fields a record lacks, in the declared order."""
    return df.withColumn(
        name, F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    )


def chronology_violations(df: DataFrame, keys: Sequence[str], clocks: Sequence[str]) -> DataFrame:
    """Neighbouring clocks that are out of order."""
    pairs = zip(clocks[:-1], clocks[1:], strict=True)
    return violations(df, keys, {f"{a}<={b}": F.col(a) <= F.col(b) for a, b in pairs})


def share_violations(shares: DataFrame, keys: Sequence[str], dimension: int) -> DataFrame:
    """Vectors with an entry outside [0, 1], a sum off one by over 0.001, or a wrong size."""
    sums = shares.groupBy(*keys).agg(
        F.sum("share").alias("_sum"), F.min("share").alias("_min"), F.max("share").alias("_max"),
        F.count("*").alias("_n"),
    )
    return violations(
        sums,
        keys,
        {
            "entries_in_unit_interval": (F.col("_min") >= 0) & (F.col("_max") <= 1),
            "sum_is_one": F.abs(F.col("_sum") - 1) <= 0.001,
            "dimension": F.col("_n") == dimension,
        },
    )


def publication_gate(
    forecasts: DataFrame, outcomes: DataFrame, features: DataFrame, comparison: DataFrame
) -> DataFrame:
    """(forecast_id, rule, ok) of every publication rule.

    forecasts: forecast_id, election_id, model_family, data_quality, simulation_count, provenance,
    input_revision_ids, input_source_ids (arrays). outcomes: forecast_id, win_probability,
    projected_share. features: election_id, missing_features, source_revision_ids, source_ids
    (arrays, bounded by the feature list). comparison: election_id, winner, fold_count,
    held_out, draws_per_fold, vintage_verified, dataset_sha256.
    """
    sums = outcomes.groupBy("forecast_id").agg(
        F.sum("win_probability").alias("_win"), F.sum("projected_share").alias("_share")
    )
    wide = (
        forecasts.join(sums, "forecast_id", "left")
        .join(features, "election_id", "left")
        .join(comparison, "election_id", "left")
    )
    graded = F.col("data_quality") != "D"
    has_revisions, has_sources = F.size("input_revision_ids") > 0, F.size("input_source_ids") > 0
    no_features = F.col("source_revision_ids").isNull()
    crowned = F.col("winner").isNotNull()
    production = (
        (F.col("draws_per_fold") == SIMULATIONS)
        & (F.col("fold_count") >= 8)
        & (F.col("held_out") >= 3)
        & F.col("vintage_verified")
        & (F.length("dataset_sha256") > 0)
    )
    rules = {
        "simulation_count": F.col("simulation_count") == SIMULATIONS,
        "provenance": F.size("provenance") > 0,
        "graded_has_evidence": ~graded | (has_revisions & has_sources),
        "evidence_declared_together": has_revisions == has_sources,
        "features_complete": ~graded | no_features | (F.size("missing_features") == 0),
        "feature_revisions_declared": ~graded
        | no_features
        | (F.size(F.array_except("source_revision_ids", "input_revision_ids")) == 0),
        "feature_sources_declared": ~graded
        | no_features
        | (F.size(F.array_except("source_ids", "input_source_ids")) == 0),
        "probabilities_sum": F.abs(F.col("_win") - 1) <= 1e-6,
        "shares_sum": F.abs(F.col("_share") - 1) <= 1e-3,
        "champion_matches": F.when(crowned, F.col("model_family") == F.col("winner")).otherwise(
            F.col("model_family") == "baseline_ensemble"
        ),
        "champion_evidence": ~crowned | production,
    }
    return rule_rows(wide, ["forecast_id"], rules)


def election_rule_violations(packs: DataFrame) -> DataFrame:
    """Election rules of a pack table against its declared system.

    packs: election_id, system, seats_total, engine, declared_seats, rounds,
    first_round_threshold, winner_rule, validation_status, forecast_mode, calendar_only,
    exploratory_scenario.
    """
    system = F.col("system")
    proxy = F.col("validation_status") == "exploratory_proxy"
    rules = {
        "engine": F.col("engine") == system,
        "unresolved_state": (system != "unresolved") | flag(F.col("validation_status").isin(*UNRESOLVED_STATES)),
        "proxy_scenario": (system != "unresolved")
        | ~flag(proxy)
        | flag(F.col("forecast_mode") == "national_control_scenario"),
        "seat_total": ~system.isin(*SEATED_SYSTEMS) | flag(F.col("declared_seats") == F.col("seats_total")),
        "runoff": (system != "presidential_runoff")
        | flag((F.col("rounds") == 2) & F.col("first_round_threshold").between(0.5, 1.0)),
        "plurality": (system != "presidential_plurality") | flag(F.col("winner_rule") == "plurality"),
        "institutional": (system != "institutional") | flag(F.col("calendar_only")) | flag(F.col("exploratory_scenario")),
    }
    return violations(packs, ["election_id"], rules)


def source_rule_violations(packs: DataFrame, adapters: DataFrame, citations: DataFrame, registry: DataFrame) -> DataFrame:
    """Adapters and citations of packs against the source registry.

    packs: election_id. adapters: election_id, source_id, status. citations: election_id,
    source_id, license, url. registry: source_id, approved, license_id.
    """
    reference_only = F.col("status") == "reference_only_no_ingestion"
    known = adapters.join(registry, "source_id", "left")
    adapter_rules = violations(
        known,
        ["election_id", "source_id"],
        {
            "adapter_source_known": reference_only | F.col("approved").isNotNull(),
            "adapter_status": reference_only
            | F.col("approved").isNull()
            | ((F.col("status") == "approved") == F.col("approved")),
        },
    )
    cited = citations.join(adapters, ["election_id", "source_id"], "left").join(registry, "source_id", "left")
    backed = F.col("status").isNotNull()
    citation_rules = violations(
        cited,
        ["election_id", "source_id"],
        {
            "citation_backed": backed,
            "citation_reference_only": ~backed
            | ~reference_only
            | ((F.col("license") == "LINK-ONLY-NO-INGESTION") & F.col("url").startswith("https://")),
            "citation_license": ~backed | reference_only | flag(F.col("license") == F.col("license_id")),
        },
    )
    uncited = packs.join(citations, "election_id", "left_anti").select(
        "election_id", F.lit("").alias("source_id"), F.lit("has_citation").alias("rule")
    )
    return adapter_rules.unionByName(citation_rules).unionByName(uncited)


def apply_source_policy(rows: DataFrame, registry: DataFrame, license_column: str = "license") -> DataFrame:
    """Decision per row: accepted, duplicate_source, unknown_source, unapproved or license_mismatch.

    A source that the registry lists more than once decides nothing; its rows stay single.
    """
    entries = registry.groupBy("source_id").agg(
        F.max("approved").alias("approved"), F.max("license_id").alias("license_id"), (F.count("*") > 1).alias("_twice")
    )
    joined = rows.join(entries, "source_id", "left")
    decided = joined.withColumn(
        "decision",
        F.when(F.col("_twice"), "duplicate_source")
        .when(F.col("approved").isNull(), "unknown_source")
        .when(~F.col("approved"), "unapproved")
        .when(~F.col(license_column).eqNullSafe(F.col("license_id")), "license_mismatch")
        .otherwise("accepted"),
    )
    return decided.drop("_twice")


def active_feeds(feeds: DataFrame, now: Column, keys: Sequence[str]) -> DataFrame:
    """Configured feeds and feeds whose window contains now, both ends included, per key."""
    inside = now.between(F.col("opens_at"), F.col("closes_at"))
    return feeds.groupBy(*keys).agg(F.count("*").alias("configured"), F.count_if(inside).alias("active"))


def coverage(df: DataFrame) -> DataFrame:
    """Coverage status and blocking reasons from the forecast flag."""
    on = F.col("forecast_enabled")
    none = F.array().cast("array<string>")
    declared = F.coalesce(F.col("coverage_status"), F.lit("mechanics_blocked"))
    reasons = F.coalesce(F.col("blocking_reasons"), F.array(F.lit(DEFAULT_BLOCKING)))
    status = F.when(on, "forecast").otherwise(declared)
    return df.withColumns(
        {"coverage_status": status, "blocking_reasons": F.when(status == "forecast", none).otherwise(reasons)}
    )


def quality_grade(df: DataFrame) -> DataFrame:
    """Configured grade for complete, fresh evidence; D otherwise; and the freshness text.

    Needs configured_quality, has_inputs, missing_features (array), poll_count, poll_age_days.
    """
    fresh = flag(F.col("poll_age_days") <= MAX_POLL_AGE_DAYS)
    complete = flag(F.col("has_inputs")) & flag(F.size("missing_features") == 0) & fresh
    text = (
        F.when(
            complete,
            F.format_string("%d source-vintage polls; latest is %d days old", "poll_count", "poll_age_days"),
        )
        .when(
            flag(F.col("has_inputs")) & F.col("poll_age_days").isNotNull(),
            F.format_string(
                "source-vintage inputs incomplete or stale; latest poll is %d days old", "poll_age_days"
            ),
        )
        .otherwise("structural-only; no source-vintage feature snapshot")
    )
    return df.withColumns(
        {"data_quality": F.when(complete, F.col("configured_quality")).otherwise("D"), "freshness": text}
    )


def search(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows whose concatenated columns contain the text, case folded."""
    return df.where(F.lower(F.concat_ws(" ", *columns)).contains(text.strip().lower()))


def report_violations(reports: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Stored reports whose hashes, target horizon or draw count disagree with what is expected."""
    e = expected.select(
        key, F.col("dataset_sha256").alias("_hash"), F.col("target_horizon_days").alias("_horizon")
    )
    return violations(
        reports.join(e, key, "left"),
        [key],
        {
            "report_hash": F.sha2(F.col("body"), 256) == F.col("report_sha256"),
            "dataset_hash": F.col("dataset_sha256") == F.col("_hash"),
            "target_horizon": F.col("target_horizon_days") == F.col("_horizon"),
            "draw_count": F.col("simulation_count") == SIMULATIONS,
        },
    )


def latest_year_codes(
    df: DataFrame, labels: Mapping[object, str], year: str, code: str, name: str
) -> DataFrame:
    """Rows of the latest year whose code is listed, labelled and sorted by name."""
    missing = {year, code, name} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    latest = df.agg(F.max(year)).scalar()
    label = F.lit(None).cast("string")
    for key, text in labels.items():
        label = F.when(F.col(code) == key, text).otherwise(label)
    return df.where((F.col(year) == latest) & F.col(code).isin(*labels)).withColumn("label", label).orderBy(name)


def hash_violations(df: DataFrame, keys: Sequence[str], content: str, recorded: str) -> DataFrame:
    return violations(
        df,
        keys,
        {
            "well_formed": F.col(recorded).rlike(HEX64),
            "matches_content": F.sha2(F.col(content), 256) == F.col(recorded),
        },
    )


VIEWS = {
    "simulation": ("snapshot_id", "election_id", "model_family", "simulation_count"),
    "sources": ("snapshot_id", "election_id", "source_ids"),
    "drivers": ("snapshot_id", "election_id", "drivers"),
    "map": ("snapshot_id", "election_id", "jurisdiction_id"),
    "mechanics": ("election_id", "system", "seats_total"),
    "comparison": ("election_id", "model_family", "brier", "rmse"),
    "catalog": ("election_id", "jurisdiction_id", "coverage_status"),
}


def snapshot_view(snapshots: DataFrame, kind: str) -> DataFrame:
    """A column projection of snapshots, or the event envelope announcing each."""
    if kind == "event":
        return snapshots.select(
            F.concat(F.lit("forecast:"), F.col("snapshot_id").cast("string")).alias("id"),
            F.lit("forecast_publication").alias("type"),
            F.col("published_at").alias("as_of"),
            "published_at",
            F.col("model_family").alias("model_version"),
            "data_quality",
            "freshness",
        )
    absent = [c for c in VIEWS[kind] if c not in snapshots.columns]
    if absent:
        raise ValueError(f"view {kind} needs columns that are absent: {absent}")
    return snapshots.select(*VIEWS[kind])
