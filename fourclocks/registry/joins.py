"""As-of selections and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fourclocks.bindings import CONTESTANTS, EVENT_CUTOFF, POLL_CUTOFF, Tables, ts
from fourclocks.functions.shares import MODE_QUALITY, OTHER_MODE_QUALITY
from fourclocks.operators import asof
from fourclocks.registry import clock_text, day_text, query, rnd, with_ctes
from fourclocks.registry.ctes import AMOUNTS, FEED, OBS, POLLS, RESULTS

TIMELY = f"""observed_at <= TIMESTAMP '{EVENT_CUTOFF}' AND available_at <= TIMESTAMP '{EVENT_CUTOFF}'
       AND retrieved_at <= TIMESTAMP '{EVENT_CUTOFF}'"""


@query("asof_filter", with_ctes(f"SELECT revision_id, jurisdiction_id, metric, value FROM observations WHERE {TIMELY}", OBS))
def _(t: Tables):
    kept = asof.asof_filter(t.observations, ts(EVENT_CUTOFF))
    return kept.select("revision_id", "jurisdiction_id", "metric", "value")


@query("asof_filter_omitted", with_ctes(f"""
SELECT election_id, count(*) FILTER (fieldwork_end <= DATE '{POLL_CUTOFF[:10]}' AND available_at <= TIMESTAMP '{POLL_CUTOFF}') AS eligible,
       count(*) FILTER (NOT (fieldwork_end <= DATE '{POLL_CUTOFF[:10]}' AND available_at <= TIMESTAMP '{POLL_CUTOFF}')) AS omitted
FROM polls GROUP BY 1""", POLLS))
def _(t: Tables):
    return asof.omitted_counts(t.polls, ["election_id"], ts(POLL_CUTOFF), ["fieldwork_end", "available_at"])


@query("join_lineage", """
SELECT n_nationkey, n_name, l_returnflag, count(*) AS facts, sum(l_quantity) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3""")
def _(t: Tables):
    facts = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_quantity")
    revisions = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    sources = t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    lined = asof.with_lineage(facts, revisions, sources, "o_orderkey", "c_custkey")
    sums = lined.groupBy("n_nationkey", "l_returnflag").agg(
        F.count("*").alias("facts"), F.sum("l_quantity").alias("quantity")
    )
    return sums.join(t.nation.select("n_nationkey", "n_name"), "n_nationkey")


@query("join_asof_latest", with_ctes(f"""
SELECT jurisdiction_id, metric, value, revision, revision_id FROM (
  SELECT *, row_number() OVER (PARTITION BY jurisdiction_id, metric
           ORDER BY available_at DESC, observed_at DESC, revision DESC, revision_id DESC) AS rn
  FROM observations WHERE {TIMELY}) WHERE rn = 1""", OBS))
def _(t: Tables):
    order = ["available_at", "observed_at", "revision", "revision_id"]
    latest = asof.asof_latest(t.observations, ["jurisdiction_id", "metric"], ts(EVENT_CUTOFF), order)
    return latest.select("jurisdiction_id", "metric", "value", "revision", "revision_id")


@query("join_asof_poll_revision", with_ctes("""
SELECT election_id, poll_key, poll_id, contestant_id, round(share, 9) AS share
FROM (SELECT p.election_id, p.pollster AS poll_key, p.poll_id,
             row_number() OVER (PARTITION BY p.election_id, p.pollster ORDER BY p.poll_id DESC) AS rn
      FROM polls p JOIN nation ON n_nationkey = p.election_id
      WHERE available_at <= DATE '1998-01-01' + n_nationkey * 30
        AND fieldwork_end <= DATE '1998-01-01' + n_nationkey * 30) JOIN poll_results USING (poll_id)
WHERE rn = 1""", POLLS, RESULTS))
def _(t: Tables):
    cutoffs = t.nation.select(
        F.col("n_nationkey").alias("election_id"),
        F.date_add(F.lit("1998-01-01").cast("date"), F.col("n_nationkey") * 30).cast("timestamp").alias("as_of"),
    )
    polls = t.poll_headers.select(
        "election_id", F.col("pollster").alias("poll_key"), "poll_id", F.col("poll_id").alias("revision"),
        "fieldwork_end", "available_at",
    )
    chosen = asof.polls_asof(polls.join(t.poll_amounts.select("poll_id"), "poll_id", "left_semi"), cutoffs)
    return chosen.join(t.poll_results, "poll_id").select(
        "election_id", "poll_key", "poll_id", "contestant_id", rnd("share").alias("share")
    )


@query("join_window_interval", with_ctes("""
SELECT election_id, CAST(window_end AS VARCHAR) AS window_end, count(*) AS polls, sum(sample_size) AS sample,
       CAST(min(fieldwork_end) AS VARCHAR) AS first_day
FROM polls JOIN (SELECT n_nationkey, DATE '1998-06-30' - n_nationkey AS window_end FROM nation)
  ON n_nationkey = election_id AND fieldwork_end BETWEEN window_end - 3 AND window_end
GROUP BY 1, 2 HAVING count(*) >= 2""", POLLS))
def _(t: Tables):
    end = F.date_sub(F.lit("1998-06-30").cast("date"), F.col("n_nationkey"))
    windows = t.nation.select(
        F.col("n_nationkey").alias("election_id"), F.date_sub(end, 3).alias("window_start"), end.alias("window_end")
    )
    matched = asof.interval_join(t.polls, windows, ["election_id"], "fieldwork_end")
    return (
        matched.groupBy("election_id", "window_end")
        .agg(
            F.count("*").alias("polls"),
            F.sum("sample_size").alias("sample"),
            day_text(F.min("fieldwork_end")).alias("first_day"),
        )
        .where(F.col("polls") >= 2)
        .withColumn("window_end", day_text("window_end"))
    )


@query("join_lookup_default", with_ctes("""
SELECT mode, contestant, mode_weight, count(*) AS n, round(sum(share), 6) AS share
FROM (SELECT p.mode, coalesce(m.c, 'unmapped') AS contestant, coalesce(q.w, 0.85) AS mode_weight, r.share
      FROM polls p JOIN poll_results r USING (poll_id)
      LEFT JOIN (VALUES ('A', 'alpha'), ('N', 'nova')) m(f, c) ON m.f = r.contestant_id
      LEFT JOIN (VALUES ('live_phone', 1.0), ('mixed', 0.95), ('online', 0.9), ('ivr', 0.82)) q(k, w) ON q.k = p.mode)
GROUP BY 1, 2, 3""".replace("coalesce(q.w, 0.85)", "CAST(coalesce(q.w, 0.85) AS DOUBLE)"), POLLS, RESULTS))
def _(t: Tables):
    rows = t.poll_headers.select("poll_id", "mode").join(t.poll_results, "poll_id")
    mapped = asof.map_with_default(rows, "mode", MODE_QUALITY, OTHER_MODE_QUALITY, "mode_weight")
    mapped = asof.map_with_default(mapped, "contestant_id", {"A": "alpha", "N": "nova"}, "unmapped", "contestant")
    return mapped.groupBy("mode", "contestant", "mode_weight").agg(
        F.count("*").alias("n"), rnd(F.sum("share"), 6).alias("share")
    )


@query("join_catalog_full", """
SELECT coalesce(a.id, b.id) AS id, coalesce(a.name, b.name) AS name, coalesce(a.region, b.region) AS region,
       CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'both'
            WHEN a.id IS NOT NULL THEN 'catalog-only' ELSE 'eligible-only' END AS origin
FROM (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS region FROM customer WHERE c_acctbal >= 0) a
FULL JOIN (SELECT o_custkey AS id, 'customer ' || o_custkey AS name, max(o_orderpriority) AS region
           FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON a.id = b.id""")
def _(t: Tables):
    catalog = t.customer.where(F.col("c_acctbal") >= 0).select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("region")
    )
    orders = t.orders.where(F.col("o_orderstatus") == "F").groupBy(F.col("o_custkey").alias("id")).agg(
        F.max("o_orderpriority").alias("region")
    )
    eligible = orders.withColumn("name", F.concat(F.lit("customer "), F.col("id").cast("string")))
    return asof.merge_catalog(catalog, eligible, "id", ["name", "region"])


@query("join_unknown_refs", """
SELECT 'unused' AS kind, o_orderkey AS ref FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL
SELECT DISTINCT 'unknown', l_orderkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey)""")
def _(t: Tables):
    used = t.lineitem.select(F.col("l_orderkey").alias("ref"))
    known = t.orders.select(F.col("o_orderkey").alias("ref"))
    unused = asof.unknown_refs(known, used, ["ref"]).withColumn("kind", F.lit("unused"))
    unknown = asof.unknown_refs(used, known, ["ref"]).withColumn("kind", F.lit("unknown"))
    return unused.unionByName(unknown)


@query("join_lineage_verified", with_ctes(f"""
SELECT jurisdiction_id, count(*) AS requested, count(*) FILTER ({TIMELY}) AS found,
       count(*) = count(*) FILTER ({TIMELY}) AS verified
FROM observations WHERE observed_at <= TIMESTAMP '{EVENT_CUTOFF}' GROUP BY 1""", OBS))
def _(t: Tables):
    wanted = asof.asof_filter(t.observations, ts(EVENT_CUTOFF), ["observed_at"])
    known = asof.asof_filter(t.observations, ts(EVENT_CUTOFF))
    return asof.lineage_verified(wanted, known, ["jurisdiction_id"], "revision_id")


@query("join_override", with_ctes(f"""
SELECT jurisdiction_id, metric, coalesce(n.value, b.value) AS value,
       n.value IS NOT NULL AND n.value <> b.value AS changed
FROM (SELECT jurisdiction_id, metric, arg_min(value, (available_at, revision_id)) AS value FROM observations GROUP BY 1, 2) b
LEFT JOIN (SELECT jurisdiction_id, metric, arg_max(value, (available_at, revision_id)) AS value
           FROM observations WHERE {TIMELY} GROUP BY 1, 2) n USING (jurisdiction_id, metric)""", OBS))
def _(t: Tables):
    keys = ["jurisdiction_id", "metric"]
    base = t.observations.groupBy(*keys).agg(
        F.min_by("value", F.struct("available_at", "revision_id")).alias("value")
    )
    latest = asof.asof_latest(t.observations, keys, ts(EVENT_CUTOFF), ["available_at", "revision_id"])
    return asof.override(base, latest, keys, ["value"])


@query("join_published_forecast", with_ctes("""
SELECT o_orderkey AS snapshot_id, n_name AS jurisdiction, coalesce(oc.n, 0) AS outcome_count,
       coalesce(oc.body, '') AS outcomes, coalesce(cc.body, '') AS coalitions
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n, string_agg(f || '=' || q, ',' ORDER BY f) AS body
           FROM (SELECT l_orderkey, l_returnflag AS f, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1) oc
  ON oc.l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey, string_agg(f || '=' || q, ',' ORDER BY f) AS body
           FROM (SELECT l_orderkey, l_linestatus AS f, count(*) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1) cc
  ON cc.l_orderkey = o_orderkey
WHERE o_orderstatus = 'F'"""))
def _(t: Tables):
    runs = t.orders.select(
        F.col("o_orderkey").alias("snapshot_id"),
        F.col("o_custkey").alias("c_custkey"),
        F.when(F.col("o_orderstatus") == "F", "validated").otherwise("draft").alias("status"),
    ).join(t.customer.select("c_custkey", F.col("c_nationkey").alias("election_id")), "c_custkey")
    elections = t.nation.select(F.col("n_nationkey").alias("election_id"), F.col("n_name").alias("jurisdiction"))
    per_flag = t.lineitem.groupBy(F.col("l_orderkey").alias("snapshot_id"), F.col("l_returnflag").alias("id")).agg(
        F.sum("l_quantity").cast("long").alias("amount")
    )
    per_status = t.lineitem.groupBy(F.col("l_orderkey").alias("snapshot_id"), F.col("l_linestatus").alias("id")).agg(
        F.count("*").alias("amount")
    )
    nested = asof.published_forecasts(
        runs,
        elections,
        asof.nest(per_flag, ["snapshot_id"], ["id", "amount"], "outcomes"),
        asof.nest(per_status, ["snapshot_id"], ["id", "amount"], "coalitions"),
    )

    def text(column):
        return F.array_join(F.transform(column, lambda x: F.concat_ws("=", x["id"], x["amount"].cast("string"))), ",")

    return nested.select(
        "snapshot_id",
        "jurisdiction",
        F.size("outcomes").alias("outcome_count"),
        text(F.col("outcomes")).alias("outcomes"),
        text(F.col("coalitions")).alias("coalitions"),
    )


@query("join_official_snapshot", with_ctes("""
SELECT unit_id, contestant_id, c_name AS unit_name, label, n_name AS source_name, votes,
       strftime(reported_at, '%Y-%m-%d %H:%M:%S') AS reported_at
FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, contestant_id ORDER BY reported_at DESC, event_id DESC) AS rn FROM feed)
JOIN customer ON c_custkey = unit_id
JOIN (SELECT DISTINCT event_type AS contestant_id, upper(event_type) AS label FROM events) USING (contestant_id)
JOIN nation ON n_nationkey = c_nationkey WHERE rn = 1""", FEED))
def _(t: Tables):
    units = t.customer.select(
        F.col("c_custkey").alias("unit_id"), F.col("c_name").alias("unit_name"), F.col("c_nationkey").alias("source_id")
    )
    contestants = t.feed.select("contestant_id").distinct().withColumn("label", F.upper("contestant_id"))
    sources = t.nation.select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("source_name"))
    snapshot = asof.official_snapshot(t.feed, units, contestants, sources)
    return snapshot.select(
        "unit_id", "contestant_id", "unit_name", "label", "source_name", "votes",
        clock_text("reported_at").alias("reported_at"),
    )


@query("join_hierarchy", """
WITH RECURSIVE units AS (
  SELECT 'R' || r_regionkey AS unit_id, CAST(NULL AS VARCHAR) AS parent_id FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer),
walk AS (
  SELECT unit_id, 0 AS depth FROM units WHERE parent_id IS NULL
  UNION ALL SELECT u.unit_id, depth + 1 FROM units u JOIN walk w ON u.parent_id = w.unit_id)
SELECT unit_id, coalesce(parent_id, '') AS parent_id, coalesce(depth, -1) AS depth,
       CASE WHEN depth IS NOT NULL THEN 'ok' ELSE 'missing_parent' END AS status
FROM units LEFT JOIN walk USING (unit_id)""")
def _(t: Tables):
    def tag(prefix, column):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    none = F.lit(None).cast("string")
    units = (
        t.region.select(tag("R", "r_regionkey").alias("unit_id"), none.alias("parent_id"))
        .unionByName(t.nation.select(tag("N", "n_nationkey").alias("unit_id"), tag("R", "n_regionkey").alias("parent_id")))
        .unionByName(t.customer.select(tag("C", "c_custkey").alias("unit_id"), tag("N", "c_nationkey").alias("parent_id")))
    )
    return asof.unit_levels(units).withColumn("parent_id", F.coalesce("parent_id", F.lit("")))


@query("join_hierarchy_chain", """
SELECT o_orderkey AS unit_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS depth, 'ok' AS status
FROM orders WHERE o_custkey % 7 <> 3
UNION ALL SELECT o_orderkey, -1, CASE WHEN row_number() OVER w = 1 THEN 'missing_parent' ELSE 'missing_ancestor' END FROM orders WHERE o_custkey % 14 = 3
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
UNION ALL SELECT o_orderkey, -1, 'unreachable' FROM orders WHERE o_custkey % 14 = 10""")
def _(t: Tables):
    """A customer's orders as a chain by date; of some customers the first one points nowhere or back to the last."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")  # bounded by a customer's orders
    back = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    last = F.first("o_orderkey").over(back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = F.when(F.col("o_custkey") % 14 == 3, F.lit(-1)).when(F.col("o_custkey") % 14 == 10, last)
    units = t.orders.select(F.col("o_orderkey").alias("unit_id"), F.coalesce(F.lag("o_orderkey").over(order), first).alias("parent_id"))
    return asof.unit_levels(units).select("unit_id", "depth", "status")


@query("join_scope_semi", """
SELECT n_nationkey, coalesce(m.zone, 'own') AS zone, m.zone IS NOT NULL AND m.zone <> 'own' AS changed,
       count(*) AS customers, round(sum(c_acctbal), 2) AS balance
FROM customer JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT n_nationkey AS k, 'managed' AS zone FROM nation JOIN supplier ON s_nationkey = n_nationkey
           GROUP BY 1 HAVING avg(s_acctbal) > 4500) m ON m.k = n_nationkey
WHERE r_name <> 'AFRICA' GROUP BY 1, 2, 3""")
def _(t: Tables):
    regions = t.region.where(F.col("r_name") != "AFRICA").select(F.col("r_regionkey").alias("n_regionkey"))
    allow = t.nation.join(regions, "n_regionkey").select("n_nationkey")
    managed = (
        t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey"))
        .agg(F.avg("s_acctbal").alias("m"))
        .where(F.col("m") > 4500)
        .select("n_nationkey", F.lit("managed").alias("zone"))
    )
    customers = t.customer.select(F.col("c_nationkey").alias("n_nationkey"), "c_acctbal", F.lit("own").alias("zone"))
    kept = asof.scope(customers, allow, "n_nationkey", managed, ["zone"])
    return kept.groupBy("n_nationkey", "zone", "changed").agg(
        F.count("*").alias("customers"), rnd(F.sum("c_acctbal"), 2).alias("balance")
    )


@query("join_manifest", with_ctes("""
SELECT n_nationkey AS election_id, CAST(coalesce(n, 0) AS BIGINT) AS input_count, 1000000 AS simulation_count,
       'baseline_ensemble' AS model_family, coalesce(CAST(d AS VARCHAR), '') AS latest_day
FROM nation JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT election_id, count(*) AS n, max(fieldwork_end) AS d FROM polls GROUP BY 1) ON election_id = n_nationkey
WHERE r_name <> 'AFRICA'""", POLLS))
def _(t: Tables):
    regions = t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    elections = t.nation.join(regions, "n_regionkey").select(
        F.col("n_nationkey").alias("election_id"), (F.col("r_name") != "AFRICA").alias("forecast_enabled")
    )
    evidence = t.polls.groupBy("election_id").agg(
        F.count("*").alias("input_count"), F.max("fieldwork_end").alias("latest_day")
    )
    manifest = asof.run_manifest(elections, evidence)
    return manifest.drop("forecast_enabled").withColumn("latest_day", F.coalesce(day_text("latest_day"), F.lit("")))
