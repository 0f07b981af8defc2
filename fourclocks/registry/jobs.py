"""End-to-end jobs built from the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fourclocks.bindings import CONTESTANTS, EVENT_CUTOFF, MODES, Tables, ts
from fourclocks.operators import asof, seats
from fourclocks.plans import evidence, publication
from fourclocks.registry import clock_text, day_text, query, rnd, with_ctes
from fourclocks.registry.aggregates import SPECS
from fourclocks.registry.ctes import FEED, OBS, POLLS, VOTES
from fourclocks.registry.seats import ELIGIBLE, REMAINDER
from fourclocks.registry.sources import scratch

K = len(CONTESTANTS)


def jurisdiction_cutoffs(t: Tables):
    """Every jurisdiction seen in the events, each with its own cutoff day."""
    day = F.date_add(F.lit("2024-01-02").cast("date"), (F.col("jurisdiction_id") % 20).cast("int"))
    seen = t.events.select(F.col("user_id").alias("jurisdiction_id")).distinct()
    return seen.select(F.col("jurisdiction_id").alias("election_id"), "jurisdiction_id", day.cast("timestamp").alias("as_of"))


@query("job_feature_snapshot", with_ctes("""
SELECT c.election_id, strftime(c.as_of, '%Y-%m-%d') AS as_of, coalesce(n, 0) AS features, coalesce(ids, '') AS revision_ids, round(coalesce(n, 0) / 5.0, 9) AS completeness,
       array_to_string(list_sort(list_filter(['conversion', 'engagement', 'faults', 'growth', 'returns'], lambda f: NOT list_contains(coalesce(names, CAST([] AS VARCHAR[])), f))), ',') AS missing,
       sha256(c.election_id || '|' || coalesce(body, '')) AS content_sha256
FROM (SELECT DISTINCT user_id AS election_id, CAST(DATE '2024-01-02' + CAST(user_id % 20 AS INTEGER) AS TIMESTAMP) AS as_of FROM events) c
LEFT JOIN (
  SELECT jurisdiction_id, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(revision_id AS VARCHAR), ',' ORDER BY revision_id) AS ids, list(feature) AS names,
         string_agg(feature || ':' || metric || ':' || value || ':' || revision_id, ',' ORDER BY feature) AS body
  FROM (SELECT *, row_number() OVER (PARTITION BY jurisdiction_id, feature ORDER BY available_at DESC, observed_at DESC, revision DESC, metric DESC) AS rn
        FROM (SELECT *, CASE metric WHEN 'click' THEN 'engagement' WHEN 'view' THEN 'engagement' WHEN 'purchase' THEN 'conversion' WHEN 'signup' THEN 'growth' WHEN 'error' THEN 'faults' END AS feature
              FROM observations WHERE available_at <= DATE '2024-01-02' + CAST(jurisdiction_id % 20 AS INTEGER) AND observed_at <= DATE '2024-01-02' + CAST(jurisdiction_id % 20 AS INTEGER)))
  WHERE rn = 1 GROUP BY 1) s ON s.jurisdiction_id = c.election_id""", OBS))
def _(t: Tables):
    snap = evidence.feature_snapshots(t.observations, jurisdiction_cutoffs(t), SPECS)
    return snap.select(
        "election_id", day_text("as_of").alias("as_of"), F.size("features").alias("features"),
        F.array_join(F.transform("source_revision_ids", lambda i: i.cast("string")), ",").alias("revision_ids"),
        rnd("completeness").alias("completeness"), F.array_join("missing_features", ",").alias("missing"), "content_sha256")


def nation_snapshots(t: Tables):
    """Feature snapshots of nations: balances and order volume, known at a nation-specific cutoff."""
    cutoffs = t.nation.select(
        F.col("n_nationkey").alias("election_id"), F.col("n_nationkey").alias("jurisdiction_id"),
        F.date_add(F.lit("1998-01-01").cast("date"), F.col("n_nationkey") * 30).cast("timestamp").alias("as_of"))
    observations = t.poll_headers.select(
        F.col("election_id").alias("jurisdiction_id"), F.col("sponsor").alias("metric"), F.col("pollster").cast("double").alias("value"),
        F.lit(0).alias("revision"), F.col("poll_id").alias("revision_id"), F.col("fieldwork_end").cast("timestamp").alias("observed_at"), "available_at")
    return evidence.feature_snapshots(observations, cutoffs, {"industry": ("AUTOMOBILE", "MACHINERY"), "housing": ("BUILDING", "HOUSEHOLD"), "arts": ("PAINTING",)})


def nation_evidence(t: Tables):
    polls = t.polls.select(
        "election_id", F.col("pollster").alias("poll_key"), F.col("poll_id").alias("revision"), "pollster", "mode",
        "fieldwork_end", "available_at", "sample_size", "shares")
    known = t.orders.select(F.col("o_orderkey").alias("revision"))
    return evidence.model_evidence(nation_snapshots(t), polls, known, K)


EVIDENCE = """
chosen AS (
  SELECT * FROM (SELECT p.*, n_nationkey, DATE '1998-01-01' + n_nationkey * 30 AS as_of, row_number() OVER (PARTITION BY election_id, pollster ORDER BY poll_id DESC) AS rn
    FROM polls p JOIN nation ON n_nationkey = election_id
    WHERE available_at <= DATE '1998-01-01' + n_nationkey * 30 AND fieldwork_end <= DATE '1998-01-01' + n_nationkey * 30) WHERE rn = 1),
weighed AS (
  SELECT *, exp(-ln(2) * greatest(0, as_of - fieldwork_end) / 21.0) AS decay, greatest(sa, 0.001) AS a, greatest(sn, 0.001) AS n, greatest(sr, 0.001) AS r,
         CASE mode WHEN 'live_phone' THEN 1.0 WHEN 'mixed' THEN 0.95 WHEN 'online' THEN 0.9 WHEN 'ivr' THEN 0.82 ELSE 0.85 END AS quality FROM chosen),
vec AS (SELECT *, sqrt(sample_size) * decay * quality AS w, a / (a + n + r) AS x0, n / (a + n + r) AS x1, r / (a + n + r) AS x2 FROM weighed),
agg AS (
  SELECT election_id, as_of, count(*) AS poll_count, sum(sample_size * decay) AS effective_n, max(available_at) AS latest,
         sum(w * x0) / sum(w) AS m0, sum(w * x1) / sum(w) AS m1, sum(w * x2) / sum(w) AS m2,
         greatest(sum(w * x0 * x0) / sum(w) - (sum(w * x0) / sum(w)) ** 2, sum(w * x1 * x1) / sum(w) - (sum(w * x1) / sum(w)) ** 2, sum(w * x2 * x2) / sum(w) - (sum(w * x2) / sum(w)) ** 2) + 1e-6 AS variance
  FROM vec GROUP BY 1, 2)"""


@query("job_model_evidence", with_ctes("""
SELECT election_id, CAST(as_of AS VARCHAR) AS as_of, poll_count, round(effective_n, 5) AS effective_n, strftime(latest, '%Y-%m-%d') AS latest,
       round(m0, 9) AS m0, round(m1, 9) AS m1, round(m2, 9) AS m2, round(variance, 9) AS variance, TRUE AS verified FROM agg""", POLLS, EVIDENCE))
def _(t: Tables):
    found = nation_evidence(t)
    return found.select(
        "election_id", day_text("as_of").alias("as_of"), "poll_count", rnd("effective_n", 5).alias("effective_n"), day_text("latest_available_at").alias("latest"),
        *[rnd(F.col("poll_shares")[i]).alias(f"m{i}") for i in range(K)], rnd("poll_variance").alias("variance"), "verified")


@query("job_forecast_inputs", with_ctes("""
SELECT election_id, CAST(greatest(0, DATE '2000-11-07' - as_of) AS INTEGER) AS horizon_days, round((0.4 * 0.5 + 0.6 * m0) / (0.4 + 0.6 * (m0 + m1 + m2)), 9) AS b0,
       round(least(0.18, greatest(0.05 * least(1.6, greatest(0.75, pow(greatest(DATE '2000-11-07' - as_of, 7) / 90.0, 0.18))), sqrt(variance))), 9) AS volatility,
       'D' AS data_quality, 'source-vintage inputs incomplete or stale; latest poll is ' || greatest(0, as_of - CAST(latest AS DATE)) || ' days old' AS freshness,
       'turnout;Macro: arts' || CASE WHEN as_of - CAST(latest AS DATE) <= 45 THEN '' ELSE ';Source-vintage polling' END || ';Validated historical release-vintage backtest;Subnational model' AS gaps
FROM agg""", POLLS, EVIDENCE))
def _(t: Tables):
    packs = t.nation.select(
        F.col("n_nationkey").alias("election_id"), F.lit("2000-11-07").cast("date").alias("election_date"),
        F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)).alias("base_shares"), F.lit(0.05).alias("volatility"), F.lit("B").alias("configured_quality"),
        F.array(F.struct(F.lit("turnout").alias("label"), F.lit(0.1).alias("confidence")), F.struct(F.lit("economy").alias("label"), F.lit(0.9).alias("confidence"))).alias("drivers"))
    out = evidence.forecast_inputs(packs, nation_evidence(t), K, F.lit(0.6))
    return out.select(
        "election_id", "horizon_days", rnd(F.col("blended_shares")[0]).alias("b0"), rnd("effective_volatility").alias("volatility"), "data_quality", "freshness",
        F.array_join("missing_drivers", ";").alias("gaps"))


@query("job_official_snapshot", with_ctes("""
SELECT n_name AS source_name, CASE WHEN bool_and(votes < 300) THEN 'certified' ELSE 'live' END AS status, max(k) / 100.0 AS reporting_fraction,
       strftime(max(reported_at), '%Y-%m-%d %H:%M:%S') AS reported_at, string_agg(DISTINCT 'v' || (k % 3), '+' ORDER BY 'v' || (k % 3)) AS parser_version,
       count(DISTINCT k % 3) AS sources, count(*) AS rows, CAST(sum(votes) AS BIGINT) AS votes
FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, contestant_id ORDER BY reported_at DESC, event_id DESC) AS rn FROM feed)
JOIN customer ON c_custkey = unit_id JOIN nation ON n_nationkey = c_nationkey WHERE rn = 1 GROUP BY 1""", FEED))
def _(t: Tables):
    feed = t.feed.select(
        "event_id", "unit_id", "contestant_id", "votes", (F.col("votes") < 300).alias("is_certified"), (F.col("k") / 100.0).alias("reporting_fraction"), "reported_at",
        F.concat(F.lit("v"), (F.col("k") % 3).cast("string")).alias("parser_version"))
    units = t.customer.select(F.col("c_custkey").alias("unit_id"), F.col("c_nationkey").alias("source_id"))
    contestants = t.feed.select("contestant_id").distinct()
    sources = t.nation.select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("source_name"))
    out = publication.official_view(feed, units, contestants, sources, ["source_name"])
    return out.withColumn("reported_at", clock_text("reported_at"))


@query("job_seat_projection", with_ctes(REMAINDER.format(value="e", source="eligible"), VOTES,
    ELIGIBLE.format(threshold="0.18", power="CASE contest_id % 3 WHEN 0 THEN pow(s, 3) WHEN 1 THEN pow(s, 4) ELSE s END")))
def _(t: Tables):
    systems = F.when(F.col("contest_id") % 3 == 0, "fptp").when(F.col("contest_id") % 3 == 1, "electoral_college").otherwise("proportional")
    out = seats.project_seats(t.votes.withColumn("system", systems), ["contest_id"], 0.18)
    return out.select("contest_id", "party", "allocated")


def derived(kind: str, parts: str) -> str:
    """SQL of the version-5 identifier of ``kind:parts`` in the URL namespace."""
    digest = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('{kind}:' || {parts}))"
    variant = f"substr('89ab89ab89ab89ab', CAST('0x' || substr({digest}, 17, 1) AS INTEGER) + 1, 1)"
    return (f"substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-5' || substr({digest}, 14, 3) || '-' || {variant} || substr({digest}, 18, 3) || '-' || substr({digest}, 21, 12)")


FEATURES = """'{"drivers":[],"input_provenance":[{"source_id":"' || mode || '"}],"input_revision_ids":["' || pollster || '","' || election_id || '"],"missing_drivers":null}'"""


def bundle_documents(t: Tables):
    """Polls as forecast documents: each cites the revisions of its pollster and of its election."""
    text = {c: F.col(c).cast("string") for c in ("poll_id", "election_id", "pollster")}

    def member(i):
        share = F.col("shares")[i]
        seats = F.floor(share * 100).cast("int")
        return F.struct(
            F.lit(CONTESTANTS[i]).alias("contestant_id"), F.lit(0.5).alias("win_probability"), share.alias("projected_share"), (share - 0.1).alias("share_low"), (share + 0.1).alias("share_high"),
            seats.alias("projected_seats"), (seats - 3).alias("seats_low"), (seats + 3).alias("seats_high"))

    def pair(*ids):
        return F.struct(F.array(*[F.lit(i) for i in ids]).alias("member_ids"), F.lit(0.5).alias("majority_probability"), F.lit(50).alias("seats_median"), F.lit(40).alias("seats_low"), F.lit(60).alias("seats_high"))

    document = F.struct(
        text["poll_id"].alias("id"), text["election_id"].alias("election_id"), day_text("fieldwork_end").alias("as_of"), F.lit("v1").alias("model_version"),
        F.col("mode").alias("model_family"), F.array(text["pollster"], text["election_id"]).alias("input_revision_ids"),
        F.array(F.struct(F.col("mode").alias("source_id"))).alias("input_provenance"), F.array().cast("array<struct<label:string,confidence:double>>").alias("drivers"),
        F.array(*[member(i) for i in range(K)]).alias("outcomes"), F.array(pair("R", "A"), pair("A", "N")).alias("coalition_outcomes"))
    return t.polls.select(F.to_json(document).alias("content"))


@query("job_bundle_normalise", with_ctes(f"""
SELECT 'model_versions' AS entity, {derived('model', "'v1:' || mode")} AS id, mode AS detail FROM polls GROUP BY mode
UNION ALL SELECT 'forecast_snapshots', {derived('snapshot', 'poll_id')}, CAST(election_id AS VARCHAR) FROM polls
UNION ALL SELECT 'simulation_runs', {derived('run', "poll_id || ':' || mode")}, {derived('model', "'v1:' || mode")} FROM polls
UNION ALL SELECT 'feature_snapshots', {derived('feature', f"poll_id || ':' || sha256({FEATURES})")}, sha256({FEATURES}) FROM polls
UNION ALL SELECT 'forecast_outcomes', {derived('snapshot', 'poll_id')}, c FROM polls CROSS JOIN (VALUES ('A'), ('N'), ('R')) v(c)
UNION ALL SELECT 'forecast_coalitions', {derived('snapshot', 'poll_id')}, c FROM polls CROSS JOIN (VALUES ('A+R'), ('A+N')) v(c)
UNION ALL SELECT 'duplicates', {derived('snapshot', 'poll_id')}, '' FROM polls WHERE pollster = election_id""", POLLS))
def _(t: Tables):
    picks = {
        "model_versions": ("model_id", "model_family"), "forecast_snapshots": ("snapshot_id", "election_id"), "simulation_runs": ("run_id", "model_id"),
        "feature_snapshots": ("feature_id", "content_sha256"), "forecast_outcomes": ("snapshot_id", "contestant_id"), "forecast_coalitions": ("snapshot_id", "coalition_key"), "duplicates": ("snapshot_id", None)}
    tagged = publication.tagged_bundles(bundle_documents(t)).where(F.col("entity").isin(*picks))
    ident, detail = F.lit(None).cast("string"), F.lit("")
    for name, (first, second) in picks.items():
        own = F.col("entity") == name
        ident = F.when(own, F.col(f"{name}.{first}")).otherwise(ident)
        detail = F.when(own, F.col(f"{name}.{second}")).otherwise(detail) if second else detail
    # documents share model versions; all other rows differ
    return tagged.select("entity", ident.alias("id"), detail.alias("detail")).distinct()


@query("job_bundle_fields", with_ctes("""
SELECT poll_id, c AS contestant_id, round(s, 9) AS projected_share, round(s - 0.1, 9) AS share_low, round(s + 0.1, 9) AS share_high, CAST(floor(s * 100) AS INTEGER) AS projected_seats,
       CAST(floor(s * 100) AS INTEGER) - 3 AS seats_low, CAST(floor(s * 100) AS INTEGER) + 3 AS seats_high
FROM (SELECT poll_id, unnest(['A', 'N', 'R']) AS c, unnest([sa, sn, sr]) AS s FROM polls)""", POLLS))
def _(t: Tables):
    tagged = publication.load_bundles(bundle_documents(t), scratch(t, "bundles"))
    snapshots = publication.bundle_table(tagged, "forecast_snapshots").select("snapshot_id", F.col("document_id").cast("long").alias("poll_id"))
    outcomes = publication.bundle_table(tagged, "forecast_outcomes").join(snapshots, "snapshot_id")
    return outcomes.select("poll_id", "contestant_id", *[rnd(c).alias(c) for c in ("projected_share", "share_low", "share_high")], "projected_seats", "seats_low", "seats_high")


@query("job_bundle_verify", with_ctes("""
SELECT poll_id AS document_id, CASE WHEN pollster = election_id THEN 'duplicate_revisions' WHEN c_mktsegment = 'BUILDING' OR (e.c_custkey IS NULL) OR e_late OR p_late THEN 'unverified' ELSE 'verified' END AS status
FROM (SELECT p.poll_id, p.pollster, p.election_id, a.c_mktsegment, e.c_custkey, p.pollster % 7 = 3 AND p.fieldwork_end < DATE '1995-01-01' AS p_late,
             (e.c_mktsegment = 'BUILDING') OR (p.election_id % 7 = 3 AND p.fieldwork_end < DATE '1995-01-01') AS e_late
      FROM polls p JOIN customer a ON a.c_custkey = p.pollster LEFT JOIN customer e ON e.c_custkey = p.election_id) AS e""", POLLS))
def _(t: Tables):
    # a revision for each customer, under every mode as its source; those of one segment come from elsewhere, some are late
    there = F.when(F.col("c_custkey") % 7 == 3, F.lit("1995-01-01")).otherwise(F.lit("1970-01-01")).cast("timestamp")
    modes = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("elsewhere"))).otherwise(F.array(*[F.lit(m) for m in (*sorted(set(MODES.values())), "unknown")]))
    revisions = t.customer.select(F.col("c_custkey").cast("string").alias("id"), F.explode(modes).alias("source_id"), there.alias("available_at"), there.alias("retrieved_at"))
    out = publication.verify_bundles(publication.load_bundles(bundle_documents(t), scratch(t, "bundles")), revisions)
    return out.select(F.col("document_id").cast("long").alias("document_id"), "status")


@query("job_pack_normalise", """
SELECT 'jurisdictions' AS entity, 'n' || n_nationkey AS id, n_name AS detail FROM nation
UNION ALL SELECT 'elections', 'e' || n_nationkey, 'n' || n_nationkey FROM nation
UNION ALL SELECT 'contestants', 'e' || c_nationkey, c_mktsegment || '/' || count(*) FROM customer GROUP BY c_nationkey, c_mktsegment
UNION ALL SELECT 'reporting_units', 'u' || n_nationkey, 'r' || n_regionkey FROM nation
UNION ALL SELECT 'reporting_units', 'r' || n_regionkey, '' FROM nation""")
def _(t: Tables):
    key, region = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    segments = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.count("*").alias("n"))
    contestant = F.create_map(
        F.lit("id"), F.col("c_mktsegment"), F.lit("name"), F.lower("c_mktsegment"), F.lit("party"), F.col("c_mktsegment"), F.lit("members"), F.col("n").cast("string"))
    fields = segments.groupBy("n_nationkey").agg(F.collect_list(contestant).alias("contestants"))
    none = F.lit(None).cast("string")

    def unit(ident, parent, level):
        return F.struct(ident.alias("id"), ident.alias("name"), parent.alias("parent_id"), F.lit(level).alias("level"), F.lit(1).alias("seats"))

    pack = F.struct(
        F.struct(F.concat(F.lit("n"), key).alias("id"), F.col("n_name").alias("name")).alias("jurisdiction"),
        F.struct(F.concat(F.lit("e"), key).alias("id"), F.col("n_name").alias("name"), F.lit("fptp").alias("system"), F.lit("2027-05-02").alias("election_date"), "contestants").alias("election"),
        F.array(unit(F.concat(F.lit("r"), region), none, "region"), unit(F.concat(F.lit("u"), key), F.concat(F.lit("r"), region), "unit")).alias("reporting_units"))
    from fourclocks.sources.documents import PACK

    packs = t.nation.join(fields, "n_nationkey", "left").select(F.from_json(F.to_json(pack), PACK).alias("pack"))
    tables = publication.normalise_packs(packs)
    empty = F.lit("")
    parts = [
        tables["jurisdictions"].select(F.lit("jurisdictions").alias("entity"), "id", F.col("name").alias("detail")),
        tables["elections"].select(F.lit("elections").alias("entity"), F.col("election_id").alias("id"), F.col("jurisdiction_id").alias("detail")),
        tables["contestants"].select(F.lit("contestants").alias("entity"), F.col("election_id").alias("id"), F.concat_ws("/", "id", F.col("attributes")["members"]).alias("detail")),
        tables["reporting_units"].select(F.lit("reporting_units").alias("entity"), F.col("unit_id").alias("id"), F.coalesce("parent_id", empty).alias("detail"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


LIVE = """
  SELECT event_id, unit_id, contestant_id, CASE WHEN decision = 'accepted' AND (votes < lag(votes) OVER w OR k < lag(k) OVER w) THEN 'regressed' ELSE decision END AS decision
  FROM (SELECT f.*, CASE WHEN NOT reported_at BETWEEN opens_at AND closes_at THEN 'outside_window' WHEN c_custkey IS NULL THEN 'unknown_unit'
               WHEN contestant_id NOT IN ('click', 'view', 'purchase') THEN 'unknown_contestant' ELSE 'accepted' END AS decision
        FROM feed f JOIN (SELECT user_id, min(ts) FILTER (value > 50) AS opens_at, max(ts) FILTER (value > 50) AS closes_at FROM events GROUP BY 1) ON user_id = unit_id
        LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = unit_id)
  WINDOW w AS (PARTITION BY unit_id, contestant_id, decision ORDER BY reported_at, event_id)"""


def live_decisions(t: Tables):
    clock = F.when(F.col("value") > 50, F.col("ts").cast("timestamp"))
    windows = t.events.groupBy(F.col("user_id").alias("unit_id")).agg(F.min(clock).alias("opens_at"), F.max(clock).alias("closes_at"))
    units = t.customer.where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("unit_id"))
    rows = t.feed.withColumn("reporting_fraction", F.col("k") / 100.0).drop("k")
    return publication.live_ingest(rows, windows, units, ("click", "view", "purchase"))


@query("job_live_results", with_ctes(f"SELECT unit_id, decision, count(*) AS n FROM ({LIVE}) GROUP BY 1, 2", FEED))
def _(t: Tables):
    return live_decisions(t).groupBy("unit_id", "decision").agg(F.count("*").alias("n"))


@query("job_live_published", with_ctes(f"""
SELECT {derived('official_result_update', "unit_id || ':' || n")} AS id, unit_id, n AS rows, stored FROM (
  SELECT unit_id, count(*) AS n, count(DISTINCT contestant_id) AS stored FROM ({LIVE}) WHERE decision = 'accepted' GROUP BY 1)""", FEED))
def _(t: Tables):
    base = scratch(t, "live")
    # decided once, then appended, served and announced from what was stored
    table, events = publication.publish_live(live_decisions(t), base + "/results", base + "/events", ts(EVENT_CUTOFF))
    again, _ = publication.publish_live(live_decisions(t).limit(50), base + "/results", base + "/again", ts(EVENT_CUTOFF))  # known rows add nothing
    served = asof.newest(again, ["unit_id", "contestant_id"], ["reported_at", "event_id"]).groupBy("unit_id").agg(F.count("*").alias("stored"))
    return events.select("id", "unit_id", "rows").join(served, "unit_id")


@query("job_live_events", with_ctes(f"""
SELECT {derived('official_result_update', "unit_id || ':' || n")} AS id, unit_id, n AS rows FROM (
  SELECT unit_id, count(*) AS n FROM feed WHERE reported_at <= TIMESTAMP '{EVENT_CUTOFF}' GROUP BY 1)""", FEED))
def _(t: Tables):
    timely = t.feed.where(F.col("reported_at") <= ts(EVENT_CUTOFF)).withColumn("decision", F.lit("accepted"))
    return publication.update_events(timely, ["unit_id"], ts(EVENT_CUTOFF)).select("id", "unit_id", "rows")
