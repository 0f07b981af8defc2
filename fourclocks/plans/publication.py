"""Nested forecast documents and packs to tables; public result views; live ingestion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourclocks.functions.text import json_hash, uuid5
from fourclocks.operators.asof import official_snapshot, unknown_refs
from fourclocks.operators.reporting import status_rollup
from fourclocks.operators.revisions import append_rows, monotonic_violations
from fourclocks.operators.segments import balanced_segments
from fourclocks.session import cut_lineage
from fourclocks.sources.sinks import table_exists

OUTCOME = (
    "struct<contestant_id:string,win_probability:double,projected_share:double,share_low:double,share_high:double,"
    "projected_seats:int,seats_low:int,seats_high:int>"
)
COALITION = "struct<member_ids:array<string>,majority_probability:double,seats_median:int,seats_low:int,seats_high:int>"
BUNDLE = (
    "id string, election_id string, as_of string, published_at string, model_version string, model_family string, "
    "simulation_count int, seed long, data_quality string, freshness string, headline string, majority_probability double, "
    "turnout_median double, selection_status string, regional_forecast_supported boolean, "
    "drivers array<struct<label:string,confidence:double>>, missing_drivers array<string>, "
    "input_revision_ids array<string>, input_provenance array<struct<source_id:string>>, "
    f"outcomes array<{OUTCOME}>, coalition_outcomes array<{COALITION}>"
)
BUNDLE_TABLES = ("model_versions", "feature_snapshots", "simulation_runs", "forecast_snapshots", "forecast_outcomes", "forecast_coalitions", "feature_revisions", "duplicates")
#: How bundles are written: identifiers and digests are hexadecimal text, and several files are open in a task.
BUNDLE_FILES = {"compression": "zstd", "parquet.block.size": str(16 << 20)}


def derived_id(kind: str, *parts: Column) -> Column:
    """Content-derived identifier of a row of one kind."""
    return uuid5(F.concat_ws(":", F.lit(kind), *[p.cast("string") for p in parts]))


def tagged_bundles(raw: DataFrame) -> DataFrame:
    """Forecast documents (``content`` JSON) as rows of all tables: ``entity`` and one struct column per table, null but for
    the row's own. Each document is parsed once.

    The columns of a table are those of its struct. A document without an id is unreadable and has one row, of entity
    ``unreadable``, with its content.
    """
    doc = raw.select(F.col("content").cast("string").alias("content"), F.from_json(F.col("content").cast("string"), BUNDLE).alias("d"))
    d = F.col("d")
    ids = F.coalesce(d["input_revision_ids"], F.array().cast("array<string>"))
    features = {"drivers": d["drivers"], "missing_drivers": d["missing_drivers"], "input_revision_ids": d["input_revision_ids"], "input_provenance": d["input_provenance"]}
    staged = doc.withColumns(
        {
            "model_id": derived_id("model", d["model_version"], d["model_family"]),
            "snapshot_id": derived_id("snapshot", d["id"]),
            "run_id": derived_id("run", d["id"], d["model_family"]),
            "feature_sha256": json_hash(**features),
            "output_sha256": F.sha2(F.to_json(d, {"ignoreNullFields": "false"}), 256),
        }
    ).withColumn("feature_id", derived_id("feature", d["id"], F.col("feature_sha256")))
    sources = F.array_sort(F.array_distinct(F.coalesce(d["input_provenance"]["source_id"], F.array().cast("array<string>"))))
    of_document = [d["election_id"].alias("election_id"), d["as_of"].alias("as_of"), d["published_at"].alias("published_at")]
    tables = {
        "model_versions": F.struct("model_id", d["model_version"].alias("model_version"), d["model_family"].alias("model_family"), d["as_of"].alias("trained_through"), d["published_at"].alias("promoted_at")),
        "feature_snapshots": F.struct("feature_id", "snapshot_id", *of_document[:2], F.struct(*[v.alias(k) for k, v in features.items()]).alias("values"), ids.alias("source_revision_ids"), F.col("feature_sha256").alias("content_sha256")),
        "simulation_runs": F.struct(
            "run_id", "snapshot_id", "model_id", "feature_id", *of_document, d["simulation_count"].alias("simulation_count"), d["seed"].alias("seed"),
            F.col("feature_sha256").alias("input_sha256"), "output_sha256", d["selection_status"].alias("selection_status"),
            d["regional_forecast_supported"].alias("regional_forecast_supported"),
        ),
        "forecast_snapshots": F.struct(
            "snapshot_id", d["id"].alias("document_id"), "model_id", "run_id", *of_document,
            *[d[c].alias(c) for c in ("simulation_count", "seed", "data_quality", "freshness", "headline", "majority_probability", "turnout_median")], sources.alias("source_ids"),
        ),
    }
    outcome = lambda o: F.struct(F.col("snapshot_id"), d["election_id"].alias("election_id"), *[o[c].alias(c) for c in ("contestant_id", "win_probability", "projected_share", "share_low", "share_high", "projected_seats", "seats_low", "seats_high")])

    def coalition(c):
        members = F.array_sort(c["member_ids"])
        rest = [c[n].alias(n) for n in ("majority_probability", "seats_median", "seats_low", "seats_high")]
        return F.struct(F.col("snapshot_id"), d["election_id"].alias("election_id"), F.array_join(members, "+").alias("coalition_key"), members.alias("member_ids"), *rest)

    def citation(r):
        return F.struct(F.col("snapshot_id"), r.alias("revision_id"), d["as_of"].alias("as_of"), sources.alias("source_ids"))

    lists = {
        "forecast_outcomes": F.transform(d["outcomes"], outcome),
        "forecast_coalitions": F.transform(d["coalition_outcomes"], coalition),
        "feature_revisions": F.transform(F.array_distinct(ids), citation),
        "duplicates": F.when(F.size(ids) != F.size(F.array_distinct(ids)), F.array(F.struct("snapshot_id"))),
        "unreadable": F.when(d["id"].isNull(), F.array(F.struct("content"))),
    }
    readable = {n: F.when(d["id"].isNotNull(), F.array(row)) for n, row in tables.items()}
    readable |= {n: F.when(d["id"].isNotNull() | F.lit(n == "unreadable"), rows) for n, rows in lists.items()}
    # one list of rows per document, each row with its own table's struct only
    wide = staged.select(*[rows.alias(n) for n, rows in readable.items()])
    kinds = {n: wide.schema[n].dataType.elementType.simpleString() for n in readable}

    def tagged(name: str):
        def row(x):
            return F.struct(F.lit(name).alias("entity"), *[(x if n == name else F.lit(None).cast(k)).alias(n) for n, k in kinds.items()])

        return F.coalesce(F.transform(name, row), F.array().cast(f"array<struct<entity:string,{','.join(f'{n}:{k}' for n, k in kinds.items())}>>"))

    return wide.select(F.explode(F.concat(*[tagged(n) for n in kinds])).alias("row")).select("row.*")


def bundle_table(tagged: DataFrame, name: str) -> DataFrame:
    """The rows of one table; model versions repeat over documents and count once."""
    rows = tagged.where(F.col("entity") == name).select(f"{name}.*")
    return rows.groupBy("model_id", "model_version", "model_family").agg(F.min("trained_through").alias("trained_through"), F.min("promoted_at").alias("promoted_at")) if name == "model_versions" else rows


def normalise_bundles(raw: DataFrame) -> dict[str, DataFrame]:
    """The tables of forecast documents by name. For more than one of them write ``tagged_bundles`` first (``load_bundles``)."""
    tagged = tagged_bundles(raw)
    return {name: bundle_table(tagged, name) for name in BUNDLE_TABLES}


def load_bundles(raw: DataFrame, path: str) -> DataFrame:
    """Parse once, write the rows of all tables into a folder per entity, and return them; a table then reads its folder.

    A task holds a file of each entity open (there are nine, each with a bounded block), so that the wide rows of all tables
    are not sorted by entity, and spilled, before they are written.
    """
    spark, writers = raw.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    tagged, before = tagged_bundles(raw), spark.conf.get(writers, "0")
    spark.conf.set(writers, max(len(BUNDLE_TABLES) + 1, int(before)))
    try:
        tagged.write.mode("overwrite").partitionBy("entity").options(**BUNDLE_FILES).parquet(path)
    finally:
        spark.conf.set(writers, before)
    return spark.read.schema(tagged.schema).parquet(path)


def verify_bundles(tagged: DataFrame, revisions: DataFrame) -> DataFrame:
    """Per snapshot: revisions declared, how many are sound, and status (``verified``, ``duplicate_revisions`` or
    ``unverified``); a load takes verified ones only.

    A declared revision is sound if it is known, its source is one of the document's, and both were there by its cut-off.
    revisions: id, source_id, available_at, retrieved_at (timestamps).
    """
    cited = bundle_table(tagged, "feature_revisions").withColumn("_cut", F.try_to_timestamp("as_of"))
    known = revisions.select(F.col("id").alias("revision_id"), "source_id", "available_at", "retrieved_at")
    sound = F.array_contains("source_ids", F.col("source_id")) & (F.col("available_at") <= F.col("_cut")) & (F.col("retrieved_at") <= F.col("_cut"))
    counted = cited.join(known, "revision_id", "left").groupBy("snapshot_id", "revision_id").agg(F.bool_or(F.coalesce(sound, F.lit(False))).alias("sound"))
    checked = counted.groupBy("snapshot_id").agg(F.count("*").alias("declared"), F.count_if("sound").alias("sound"))
    every = bundle_table(tagged, "forecast_snapshots").select("snapshot_id", "document_id").join(checked, "snapshot_id", "left").na.fill(0, ["declared", "sound"])
    twice = bundle_table(tagged, "duplicates").distinct().withColumn("_twice", F.lit(True))
    status = F.when(F.col("_twice"), "duplicate_revisions").when(F.col("sound") < F.col("declared"), "unverified").otherwise("verified")
    return every.join(twice, "snapshot_id", "left").select("snapshot_id", "document_id", "declared", "sound", status.alias("status"))


def normalise_packs(packs: DataFrame, contestant_fields: Sequence[str] = ("id", "name", "party")) -> dict[str, DataFrame]:
    """Packs (``pack`` struct) to jurisdictions, elections, contestants and reporting units.

    Contestant keys outside the declared fields stay together in a map.
    """
    jurisdictions = packs.select("pack.jurisdiction.*").dropDuplicates(["id"])
    elections = packs.select(
        F.col("pack.election.id").alias("election_id"),
        F.col("pack.jurisdiction.id").alias("jurisdiction_id"),
        "pack.election.name", "pack.election.system", "pack.election.seats_total",
        F.col("pack.election.election_date").try_cast("date").alias("election_date"),
    )
    each = packs.select(
        F.col("pack.election.id").alias("election_id"), F.posexplode("pack.election.contestants").alias("position", "_c")
    )
    extra = F.map_filter("_c", lambda k, _: ~k.isin(*contestant_fields))
    contestants = each.select(
        "election_id", "position", *[F.col("_c")[f].alias(f) for f in contestant_fields], extra.alias("attributes")
    )
    units = packs.select(F.col("pack.election.id").alias("election_id"), F.explode("pack.reporting_units").alias("_u")).select(
        "election_id", F.col("_u.id").alias("unit_id"), "_u.name", "_u.parent_id", "_u.level", "_u.seats"
    )
    return {"jurisdictions": jurisdictions, "elections": elections, "contestants": contestants, "reporting_units": units}


def official_view(
    feed: DataFrame, units: DataFrame, contestants: DataFrame, sources: DataFrame, by: Sequence[str]
) -> DataFrame:
    """Public status per key with the number of distinct sources behind it."""
    rows = official_snapshot(feed, units, contestants, sources)
    status = status_rollup(rows, by)
    proof = rows.groupBy(*by, "source_id", "parser_version").agg(F.count("*").alias("_n")).groupBy(*by).agg(
        F.count("*").alias("sources")
    )
    counted = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.sum("votes").alias("votes"))
    return status.join(proof, list(by)).join(counted, list(by))


def live_ingest(rows: DataFrame, windows: DataFrame, units: DataFrame, known_contestants: Sequence[str]) -> DataFrame:
    """Decision per live row: outside_window, unknown_unit, unknown_contestant, regressed or accepted.

    rows: event_id, unit_id, contestant_id, votes, reporting_fraction, reported_at.
    windows: unit_id, opens_at, closes_at. units: unit_id.
    """
    keys = ["unit_id", "contestant_id"]
    open_rows = rows.join(windows, "unit_id", "left")
    inside = F.coalesce(F.col("reported_at").between(F.col("opens_at"), F.col("closes_at")), F.lit(False))
    strangers = unknown_refs(rows, units, ["unit_id"]).withColumn("_stranger", F.lit(True))
    staged = open_rows.join(strangers, "unit_id", "left").withColumn(
        "decision",
        F.when(~inside, "outside_window")
        .when(F.col("_stranger"), "unknown_unit")
        .when(~F.col("contestant_id").isin(*known_contestants), "unknown_contestant")
        .otherwise("accepted"),
    ).select(*rows.columns, "decision")
    accepted = staged.where(F.col("decision") == "accepted").drop("decision")
    order = ["reported_at", "event_id"]
    bad = monotonic_violations(accepted, keys, order, balanced_segments(rows, order))
    flagged = bad.select("event_id", F.lit("regressed").alias("_worse"))
    return staged.join(flagged, "event_id", "left").withColumn("decision", F.coalesce("_worse", "decision")).drop("_worse")


def publish_live(decisions: DataFrame, results: str, events: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Append the accepted rows of decided live rows that the results lack, and write one event per unit that got new ones.

    Returns the results table and the events of this call. Rows are known by event_id; repeated calls append and announce
    nothing twice, as an event's id follows from what was appended.
    """
    spark = decisions.sparkSession
    accepted = decisions.where(F.col("decision") == "accepted")
    known = spark.read.parquet(results).select("event_id") if table_exists(spark, results) else accepted.select("event_id").limit(0)
    fresh = cut_lineage(append_rows(known, accepted, ["event_id"]))
    update_events(fresh, ["unit_id"], as_of).write.mode("append").parquet(events)
    fresh.drop("decision").write.mode("append").parquet(results)
    return spark.read.parquet(results), spark.read.parquet(events)


def update_events(decisions: DataFrame, by: Sequence[str], as_of: Column) -> DataFrame:
    """One content-derived update event per key with accepted rows."""
    kept = decisions.where(F.col("decision") == "accepted").groupBy(*by).agg(
        F.count("*").alias("rows"), F.max("reported_at").alias("latest")
    )
    return kept.select(
        derived_id("official_result_update", *[F.col(b) for b in by], F.col("rows")).alias("id"),
        F.lit("official_result_update").alias("type"),
        as_of.alias("as_of"),
        *by,
        "rows",
        "latest",
    )
