"""Contract checks, gates, policies and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from fourclocks.bindings import CONTESTANTS, EVENT_CUTOFF, POLL_CUTOFF, Tables, ts
from fourclocks.functions.text import missing_labels
from fourclocks.operators import asof, contracts, draws as draw_ops
from fourclocks.registry import day_text, query, rnd, with_ctes
from fourclocks.registry.ctes import DRAWS, OBS, POLLS, RESULTS


@query("valid_rows_confidence", """
SELECT event_type, count(*) AS total, count(*) FILTER (value >= 5) AS valid,
       round(count(*) FILTER (value >= 5) / CAST(count(*) AS DOUBLE), 9) AS confidence,
       count(*) FILTER (value >= 5) / CAST(count(*) AS DOUBLE) >= 0.9 AS passes FROM events GROUP BY 1""")
def _(t: Tables):
    out = contracts.parse_confidence(t.events, ["event_type"], F.col("value") >= 5, 0.90)
    return out.withColumn("confidence", rnd("confidence"))


@query("required_fields", """
SELECT event_id, CASE WHEN value < 5 THEN 'value' ELSE '' END || CASE WHEN value < 5 AND event_type = 'error' THEN ',' ELSE '' END
       || CASE WHEN event_type = 'error' THEN 'label' ELSE '' END AS missing
FROM events WHERE value < 5 OR event_type = 'error'""")
def _(t: Tables):
    records = t.events.select(
        "event_id", "user_id", F.when(F.col("value") >= 5, F.col("value")).alias("value"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("label"))
    out = contracts.missing_fields(records, ["user_id", "value", "label"]).where(F.size("missing") > 0)
    return out.select("event_id", F.array_join("missing", ",").alias("missing"))


@query("chronology_check", """
SELECT l_orderkey, l_linenumber, 'ordered<=shipped' AS rule FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate""")
def _(t: Tables):
    ordered = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("ordered"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("shipped")).join(ordered, "l_orderkey")
    return contracts.chronology_violations(lines, ["l_orderkey", "l_linenumber"], ["ordered", "shipped"])


@query("share_vector_check", with_ctes("""
SELECT poll_id, 'dimension' AS rule FROM poll_results GROUP BY 1 HAVING count(*) <> 3
UNION ALL SELECT poll_id, 'sum_is_one' FROM poll_results GROUP BY 1 HAVING abs(sum(share) - 1) > 0.001
UNION ALL SELECT poll_id, 'entries_in_unit_interval' FROM poll_results GROUP BY 1 HAVING min(share) < 0 OR max(share) > 1""", RESULTS))
def _(t: Tables):
    return contracts.share_violations(t.poll_results, ["poll_id"], 3)


def forecast_tables(t: Tables):
    """Forecast per nation from its draws, with evidence declared by its suppliers and customers."""
    outcomes = draw_ops.outcome_moments(t.draws, ["election_id"], CONTESTANTS).withColumnRenamed("election_id", "forecast_id")
    evidence = t.customer.groupBy(F.col("c_nationkey").alias("election_id")).agg(
        F.array_sort(F.collect_set("c_mktsegment")).alias("source_revision_ids"), F.avg("c_acctbal").alias("balance"))
    features = evidence.select(
        "election_id", "source_revision_ids", F.array(F.lit("crm")).alias("source_ids"),
        F.when(F.col("balance") < 4400, F.array(F.lit("inflation"))).otherwise(F.array().cast("array<string>")).alias("missing_features"))
    declared = t.poll_headers.groupBy("election_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("fieldwork_end") < F.lit("1995-02-01").cast("date"), F.col("sponsor")))).alias("input_revision_ids"),
        F.max("pollster").alias("top"))
    forecasts = declared.select(
        F.col("election_id").alias("forecast_id"), "election_id", "input_revision_ids", F.array(F.lit("crm")).alias("input_source_ids"),
        F.lit("baseline_ensemble").alias("model_family"), F.lit(1_000_000).alias("simulation_count"),
        F.array(F.lit("crm")).alias("provenance"), F.when(F.col("top") % 2 == 0, "B").otherwise("D").alias("data_quality"))
    comparison = forecasts.select(
        "election_id", F.lit(None).cast("string").alias("winner"), F.lit(0).alias("fold_count"), F.lit(0).alias("held_out"),
        F.lit(0).alias("draws_per_fold"), F.lit(False).alias("vintage_verified"), F.lit("").alias("dataset_sha256"))
    return forecasts, outcomes, features, comparison


RULES = (
    "simulation_count", "provenance", "graded_has_evidence", "evidence_declared_together", "features_complete", "feature_revisions_declared",
    "feature_sources_declared", "probabilities_sum", "shares_sum", "champion_matches", "champion_evidence")


@query("forecast_gate", with_ctes("""
SELECT election_id AS forecast_id, rule, CASE rule WHEN 'graded_has_evidence' THEN NOT graded OR ids > 0 WHEN 'evidence_declared_together' THEN ids > 0
       WHEN 'features_complete' THEN NOT graded OR NOT balance < 4400 WHEN 'feature_revisions_declared' THEN NOT graded OR absent = 0 ELSE TRUE END AS ok
FROM (SELECT election_id, max(pollster) % 2 = 0 AS graded, count(DISTINCT sponsor) FILTER (fieldwork_end < DATE '1995-02-01') AS ids FROM poll_headers GROUP BY 1)
JOIN (SELECT c_nationkey AS election_id, avg(c_acctbal) AS balance FROM customer GROUP BY 1) USING (election_id)
JOIN (SELECT c.c_nationkey AS election_id, count(*) FILTER (h.sponsor IS NULL) AS absent FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) c
      LEFT JOIN (SELECT DISTINCT election_id, sponsor FROM poll_headers WHERE fieldwork_end < DATE '1995-02-01') h ON h.election_id = c.c_nationkey AND h.sponsor = c.c_mktsegment GROUP BY 1) USING (election_id)
CROSS JOIN (VALUES """ + ", ".join(f"('{r}')" for r in RULES) + ") v(rule)", POLLS))
def _(t: Tables):
    return contracts.publication_gate(*forecast_tables(t))


@query("forecast_gate_sums", with_ctes("""
SELECT election_id AS forecast_id, abs(sum(p) - 1) <= 1e-6 AS probabilities_ok, abs(sum(s) - 1) <= 1e-3 AS shares_ok
FROM (SELECT election_id, contestant_id, avg(CAST(is_win AS INTEGER)) AS p, avg(share) AS s FROM won GROUP BY 1, 2) GROUP BY 1""", DRAWS))
def _(t: Tables):
    gate = contracts.publication_gate(*forecast_tables(t))
    return gate.groupBy("forecast_id").agg(
        F.bool_and(F.when(F.col("rule") == "probabilities_sum", F.col("ok"))).alias("probabilities_ok"),
        F.bool_and(F.when(F.col("rule") == "shares_sum", F.col("ok"))).alias("shares_ok"))


PACKS = """
packs AS (
  SELECT c_nationkey AS election_id, count(*) AS seats_total, count(DISTINCT c_mktsegment) AS rounds, avg(c_acctbal) AS balance,
         CASE c_nationkey % 6 WHEN 0 THEN 'fptp' WHEN 1 THEN 'proportional' WHEN 2 THEN 'presidential_runoff'
              WHEN 3 THEN 'presidential_plurality' WHEN 4 THEN 'unresolved' ELSE 'institutional' END AS system,
         count(*) FILTER (c_acctbal > -950) AS declared_seats
  FROM customer GROUP BY 1)"""


def packs(t: Tables):
    """Nations as election packs; what they declare depends on their customers."""
    nation = F.col("c_nationkey")
    system = F.lit("institutional")
    for i, name in enumerate(["fptp", "proportional", "presidential_runoff", "presidential_plurality", "unresolved"]):
        system = F.when(nation % 6 == i, name).otherwise(system)
    return t.customer.groupBy(nation.alias("election_id"), system.alias("system")).agg(
        F.count("*").alias("seats_total"), F.count_distinct("c_mktsegment").alias("rounds"),
        F.avg("c_acctbal").alias("balance"), F.count_if(F.col("c_acctbal") > -950).alias("declared_seats"),
    ).withColumns({
        "engine": F.when(F.col("balance") > 4700, "legacy").otherwise(F.col("system")),
        "first_round_threshold": F.lit(0.5),
        "winner_rule": F.when(F.col("balance") > 4500, "plurality"),
        "validation_status": F.when(F.col("balance") > 4500, "mechanics_blocked").otherwise("exploratory_proxy"),
        "forecast_mode": F.lit(None).cast("string"),
        "calendar_only": F.col("balance") > 4500,
        "exploratory_scenario": F.lit(False),
    })


@query("rule_contracts", with_ctes("""
SELECT election_id, 'engine' AS rule FROM packs WHERE balance > 4700
UNION ALL SELECT election_id, 'seat_total' FROM packs WHERE system IN ('fptp', 'proportional') AND declared_seats <> seats_total
UNION ALL SELECT election_id, 'runoff' FROM packs WHERE system = 'presidential_runoff' AND rounds <> 2
UNION ALL SELECT election_id, 'plurality' FROM packs WHERE system = 'presidential_plurality' AND NOT balance > 4500
UNION ALL SELECT election_id, 'proxy_scenario' FROM packs WHERE system = 'unresolved' AND NOT balance > 4500
UNION ALL SELECT election_id, 'institutional' FROM packs WHERE system = 'institutional' AND NOT balance > 4500""", PACKS))
def _(t: Tables):
    return contracts.election_rule_violations(packs(t))


REGISTRY = """
registry AS (SELECT source AS source_id, avg(n_chars) > 1500 AS approved, max(lang) AS license_id FROM documents GROUP BY 1)"""


def source_registry(t: Tables):
    return t.documents.groupBy(F.col("source").alias("source_id")).agg(
        (F.avg("n_chars") > 1500).alias("approved"), F.max("lang").alias("license_id"))


@query("source_policy", with_ctes("""
SELECT doc_id, CASE WHEN approved IS NULL THEN 'unknown_source' WHEN NOT approved THEN 'unapproved'
       WHEN lang <> license_id THEN 'license_mismatch' ELSE 'accepted' END AS decision
FROM documents LEFT JOIN registry ON source_id = source""", REGISTRY))
def _(t: Tables):
    rows = t.documents.select("doc_id", F.col("source").alias("source_id"), F.col("lang").alias("license"))
    return contracts.apply_source_policy(rows, source_registry(t)).select("doc_id", "decision")


@query("source_contracts", with_ctes("""
SELECT election_id, source_id, rule FROM (
  SELECT c.election_id, c.source_id, CASE WHEN a.status IS NULL THEN 'citation_backed' WHEN c.license <> r.license_id THEN 'citation_license' END AS rule
  FROM citations c LEFT JOIN adapters a USING (election_id, source_id) LEFT JOIN registry r ON r.source_id = c.source_id
  UNION ALL SELECT election_id, source_id, CASE WHEN (status = 'approved') <> approved THEN 'adapter_status' END
  FROM adapters JOIN registry USING (source_id)
  UNION ALL SELECT DISTINCT lang, '', CASE WHEN lang NOT IN (SELECT election_id FROM citations) THEN 'has_citation' END FROM documents)
WHERE rule IS NOT NULL""", REGISTRY,
"adapters AS (SELECT lang AS election_id, source AS source_id, CASE WHEN avg(n_chars) > 1500 THEN 'approved' ELSE 'pending' END AS status FROM documents GROUP BY 1, 2)",
"citations AS (SELECT lang AS election_id, source AS source_id, min(lang) AS license FROM documents WHERE n_chars > 100 GROUP BY 1, 2)"))
def _(t: Tables):
    pair = [F.col("lang").alias("election_id"), F.col("source").alias("source_id")]
    adapters = t.documents.groupBy(*pair).agg(F.when(F.avg("n_chars") > 1500, "approved").otherwise("pending").alias("status"))
    citations = t.documents.where(F.col("n_chars") > 100).groupBy(*pair).agg(F.min("lang").alias("license")).withColumn("url", F.lit("https://example.org"))
    owners = t.documents.select(F.col("lang").alias("election_id")).distinct()
    return contracts.source_rule_violations(owners, adapters, citations, source_registry(t))


@query("live_window", f"""
SELECT event_type, count(*) AS configured,
       count(*) FILTER (TIMESTAMP '{EVENT_CUTOFF}' BETWEEN opens_at AND closes_at) AS active
FROM (SELECT user_id, event_type, min(ts) FILTER (value > 50) AS opens_at, max(ts) FILTER (value > 50) AS closes_at FROM events GROUP BY 1, 2) GROUP BY 1""")
def _(t: Tables):
    clock = F.when(F.col("value") > 50, F.col("ts").cast("timestamp"))
    feeds = t.events.groupBy("user_id", "event_type").agg(F.min(clock).alias("opens_at"), F.max(clock).alias("closes_at"))
    return contracts.active_feeds(feeds, ts(EVENT_CUTOFF), ["event_type"])


@query("coverage_status", """
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'forecast' WHEN c_mktsegment = 'BUILDING' THEN 'calendar_only' ELSE 'mechanics_blocked' END AS coverage_status,
       CASE WHEN c_acctbal > 0 THEN '' ELSE 'Forecast publication requirements remain unresolved' END AS reasons FROM customer""")
def _(t: Tables):
    rows = t.customer.select(
        "c_custkey", (F.col("c_acctbal") > 0).alias("forecast_enabled"),
        F.when(F.col("c_mktsegment") == "BUILDING", "calendar_only").alias("coverage_status"),
        F.lit(None).cast("array<string>").alias("blocking_reasons"))
    out = contracts.coverage(rows)
    return out.select("c_custkey", "coverage_status", F.array_join("blocking_reasons", "; ").alias("reasons"))


@query("quality_grade", with_ctes(f"""
SELECT pollster, CASE WHEN age <= 45 THEN 'B' ELSE 'D' END AS data_quality,
       CASE WHEN age <= 45 THEN n || ' source-vintage polls; latest is ' || age || ' days old'
            ELSE 'source-vintage inputs incomplete or stale; latest poll is ' || age || ' days old' END AS freshness
FROM (SELECT pollster, count(*) AS n, greatest(0, DATE '{POLL_CUTOFF[:10]}' - CAST(max(available_at) AS DATE)) AS age FROM polls
      WHERE available_at <= TIMESTAMP '{POLL_CUTOFF}' AND fieldwork_end <= DATE '{POLL_CUTOFF[:10]}' GROUP BY 1)""", POLLS))
def _(t: Tables):
    timely = asof.asof_filter(t.polls, ts(POLL_CUTOFF), ["available_at", "fieldwork_end"])
    age = F.datediff(ts(POLL_CUTOFF).cast("date"), F.max("available_at").cast("date"))
    evidence = timely.groupBy("pollster").agg(
        F.count("*").alias("poll_count"), F.greatest(F.lit(0), age).alias("poll_age_days"),
    ).withColumns({"has_inputs": F.lit(True), "configured_quality": F.lit("B"),
                   "missing_features": missing_labels((F.lit(False), F.lit("none")))})
    return contracts.quality_grade(evidence).select("pollster", "data_quality", "freshness")


@query("text_search", """
SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', lang, source, text)), 'license')""")
def _(t: Tables):
    return contracts.search(t.documents, ["lang", "source", "text"], " License ").select("doc_id")


@query("report_contract", """
SELECT doc_id, 'report_hash' AS rule FROM documents WHERE lang = 'de'
UNION ALL SELECT doc_id, 'dataset_hash' FROM documents d JOIN (SELECT source, min(doc_id) AS m FROM documents GROUP BY 1) USING (source) WHERE source <> 'src1' AND doc_id <> m
UNION ALL SELECT doc_id, 'target_horizon' FROM documents WHERE n_chars < 500
UNION ALL SELECT doc_id, 'draw_count' FROM documents WHERE n_chars < 100""")
def _(t: Tables):
    first = t.documents.groupBy("source").agg(F.min("doc_id").alias("m"))
    docs = t.documents.join(first, "source")
    own = F.sha2(F.col("doc_id").cast("string"), 256)
    reports = docs.select(
        "doc_id", F.col("text").alias("body"),
        F.when(F.col("lang") == "de", F.lit("stale")).otherwise(F.sha2("text", 256)).alias("report_sha256"),
        own.alias("dataset_sha256"), F.lit(28).alias("target_horizon_days"),
        F.when(F.col("n_chars") < 100, 1000).otherwise(1_000_000).alias("simulation_count"))
    lead = F.when(F.col("source") == "src1", F.col("doc_id")).otherwise(F.col("m"))
    expected = docs.select(
        "doc_id", F.sha2(lead.cast("string"), 256).alias("dataset_sha256"),
        F.when(F.col("n_chars") < 500, 14).otherwise(28).alias("target_horizon_days"))
    return contracts.report_violations(reports, expected, "doc_id")


@query("proj_snapshot_views", with_ctes("""
SELECT 'forecast:' || poll_id AS id, 'forecast_publication' AS type, CAST(fieldwork_end AS VARCHAR) AS as_of, CAST(fieldwork_end AS VARCHAR) AS published_at,
       scenario_id AS model_version, 'B' AS data_quality, mode AS freshness, coalesce(n_name, '') AS jurisdiction
FROM (SELECT *, row_number() OVER (PARTITION BY election_id ORDER BY fieldwork_end DESC, poll_id DESC) AS rn FROM poll_headers)
RIGHT JOIN nation ON n_nationkey = election_id AND rn = 1""", POLLS))
def _(t: Tables):
    snapshots = t.poll_headers.select(
        "election_id", F.col("poll_id").alias("snapshot_id"), F.col("fieldwork_end").alias("published_at"),
        F.col("scenario_id").alias("model_family"), F.col("mode").alias("freshness"), F.lit("B").alias("data_quality"))
    latest = asof.newest(snapshots, ["election_id"], ["published_at", "snapshot_id"])
    named = t.nation.select(F.col("n_nationkey").alias("election_id"), F.col("n_name").alias("jurisdiction")).join(latest, "election_id", "left")
    ids = F.concat(F.lit("forecast:"), F.col("snapshot_id").cast("string"))
    view = contracts.snapshot_view(latest, "event").join(named.select(ids.alias("id"), "jurisdiction"), "id")
    return view.withColumns({"as_of": day_text("as_of"), "published_at": day_text("published_at")})


def view_sql(kind: str, *columns: str) -> str:
    return f"SELECT '{kind}' AS kind, {' || chr(124) || '.join(f'CAST({c} AS VARCHAR)' for c in columns)} AS row FROM v"


@query("proj_snapshot_kinds", "WITH v AS (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey)\n" + "\nUNION ALL ".join((
    view_sql("simulation", "o_orderkey", "c_nationkey", "o_orderpriority", "o_custkey"), view_sql("sources", "o_orderkey", "c_nationkey", "c_name"),
    view_sql("drivers", "o_orderkey", "c_nationkey", "c_mktsegment"), view_sql("map", "o_orderkey", "c_nationkey", "c_custkey"), view_sql("mechanics", "c_nationkey", "o_orderstatus", "c_custkey"),
    view_sql("comparison", "c_nationkey", "o_orderpriority", "c_custkey", "o_orderkey"), view_sql("catalog", "c_nationkey", "c_custkey", "o_orderstatus"))))
def _(t: Tables):
    snapshots = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_orderkey").alias("snapshot_id"), F.col("c_nationkey").alias("election_id"), F.col("o_orderpriority").alias("model_family"), F.col("o_custkey").alias("simulation_count"),
        F.col("c_name").alias("source_ids"), F.col("c_mktsegment").alias("drivers"), F.col("c_custkey").alias("jurisdiction_id"), F.col("o_orderstatus").alias("system"),
        F.col("c_custkey").alias("seats_total"), F.col("c_custkey").alias("brier"), F.col("o_orderkey").alias("rmse"), F.col("o_orderstatus").alias("coverage_status"))
    out = None
    for kind in contracts.VIEWS:
        view = contracts.snapshot_view(snapshots, kind)
        part = view.select(F.lit(kind).alias("kind"), F.concat_ws("|", *[F.col(c).cast("string") for c in view.columns]).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out


@query("flt_latest_year_codes", """
SELECT o_orderkey, year(o_orderdate) AS year, CASE o_orderpriority WHEN '1-URGENT' THEN 'electoral-democracy' ELSE 'liberal-democracy' END AS label
FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) AND o_orderpriority IN ('1-URGENT', '2-HIGH')""".replace("year(o_orderdate) AS year", "CAST(year(o_orderdate) AS INTEGER) AS year"))
def _(t: Tables):
    rows = t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"), "o_orderpriority")
    labels = {"1-URGENT": "electoral-democracy", "2-HIGH": "liberal-democracy"}
    return contracts.latest_year_codes(rows, labels, "year", "o_orderpriority", "o_orderkey").select("o_orderkey", "year", "label")


@query("hash_integrity", """
SELECT doc_id, 'well_formed' AS rule FROM documents WHERE lang = 'de'
UNION ALL SELECT doc_id, 'matches_content' FROM documents WHERE lang = 'de' OR (lang = 'fr' AND trim(text) <> text)""")
def _(t: Tables):
    recorded = (
        F.when(F.col("lang") == "de", F.upper(F.sha2("text", 256)))
        .when(F.col("lang") == "fr", F.sha2(F.trim("text"), 256))
        .otherwise(F.sha2("text", 256)))
    return contracts.hash_violations(t.documents.withColumn("recorded", recorded), ["doc_id"], "text", "recorded")
