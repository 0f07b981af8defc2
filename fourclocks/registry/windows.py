"""Revision numbering, latest rows, monotonic checks, rates and top-k reports."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from fourclocks.bindings import EVENT_CUTOFF, Tables, ts
from fourclocks.operators import asof, ranking, revisions
from fourclocks.operators.segments import balanced_segments, running_totals, trailing_count
from fourclocks.registry import clock_text, day_text, query, rnd, with_ctes
from fourclocks.registry.ctes import FEED, OBS, RUNS
from fourclocks.session import shared_folder
from fourclocks.sources import sinks

KEYS = ["unit_id", "contestant_id"]
ORDER = ["reported_at", "event_id"]


@query("win_latest_per_key", with_ctes("""
SELECT unit_id, contestant_id, votes, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY unit_id, contestant_id ORDER BY reported_at DESC, event_id DESC) AS rn FROM feed)
WHERE rn = 1""", FEED))
def _(t: Tables):
    return asof.newest(t.feed, KEYS, ORDER).select(*KEYS, "votes", "event_id")


def bucketed(t: Tables):
    """The feed with a coarse content hash, so that contents come back later (A, B, A)."""
    return t.feed.withColumn("content", F.sha2((F.col("k") % 3).cast("string"), 256))


@query("win_revision_number_latest", with_ctes("""
SELECT unit_id, contestant_id, event_id, CAST(sum(step) OVER (PARTITION BY unit_id, contestant_id ORDER BY reported_at, event_id) - 1 AS BIGINT) AS revision
FROM (SELECT *, CASE WHEN lag(k % 3) OVER (PARTITION BY unit_id, contestant_id ORDER BY reported_at, event_id) IS NOT DISTINCT FROM k % 3
             THEN 0 ELSE 1 END AS step FROM feed)""", FEED))
def _(t: Tables):
    feed = bucketed(t)
    out = revisions.number_revisions(feed, KEYS, ORDER, "content", balanced_segments(feed, ORDER))
    return out.select(*KEYS, "event_id", "revision")


@query("win_revision_number_any", with_ctes("""
SELECT unit_id, contestant_id, event_id, CAST(dense_rank() OVER (PARTITION BY unit_id, contestant_id ORDER BY f) - 1 AS BIGINT) AS revision
FROM (SELECT *, min(event_id) OVER (PARTITION BY unit_id, contestant_id, k % 3) AS f FROM feed)""", FEED))
def _(t: Tables):
    feed = bucketed(t)
    out = revisions.number_revisions(feed, KEYS, ORDER, "content", balanced_segments(feed, ORDER), "any")
    return out.select(*KEYS, "event_id", "revision")


@query("win_monotonic_check", with_ctes("""
SELECT event_id, unit_id, contestant_id, votes, previous_votes,
       CASE WHEN votes < previous_votes THEN 'votes_regressed' ELSE 'fraction_regressed' END AS reason
FROM (SELECT *, lag(votes) OVER w AS previous_votes, lag(k) OVER w AS previous_k FROM feed
      WINDOW w AS (PARTITION BY unit_id, contestant_id ORDER BY reported_at, event_id))
WHERE votes < previous_votes OR k < previous_k""", FEED))
def _(t: Tables):
    feed = t.feed.withColumn("reporting_fraction", F.col("k") / 100.0)
    bad = revisions.monotonic_violations(feed, KEYS, ORDER, balanced_segments(feed, ORDER))
    return bad.select("event_id", *KEYS, "votes", "previous_votes", "reason")


@query("win_running_fraction", with_ctes("""
SELECT event_id, count(*) OVER w AS reported, CAST(sum(votes) OVER w AS BIGINT) AS votes_so_far,
       round(count(*) OVER w / CAST(count(*) OVER (PARTITION BY unit_id, contestant_id) AS DOUBLE), 9) AS reporting_fraction
FROM feed WINDOW w AS (PARTITION BY unit_id, contestant_id ORDER BY reported_at, event_id)""", FEED))
def _(t: Tables):
    totals = {"reported": F.lit(1), "votes_so_far": F.col("votes")}
    running = running_totals(t.feed, KEYS, ORDER, totals, balanced_segments(t.feed, ORDER))
    whole = t.feed.groupBy(*KEYS).agg(F.count("*").alias("n"))
    return running.join(whole, KEYS).select(
        "event_id", F.col("reported").cast("long").alias("reported"), "votes_so_far",
        rnd(F.col("reported") / F.col("n")).alias("reporting_fraction"))


@query("win_sliding_rate", with_ctes("""
SELECT a.user_id, a.second, a.n AS hits_in_second, CAST(sum(b.n) AS BIGINT) AS hits, sum(b.n) > 1 AS over_limit
FROM per_second a JOIN per_second b ON a.user_id = b.user_id AND b.second BETWEEN a.second - 60 AND a.second
GROUP BY 1, 2, 3""", "per_second AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS n FROM events GROUP BY 1, 2)"))
def _(t: Tables):
    rate = trailing_count(t.events.select("user_id", "ts"), "user_id", "ts", 60)
    return rate.withColumn("over_limit", F.col("hits") > 1)


@query("win_replay_after", """
SELECT event_id, event_type FROM events WHERE (ts, event_id) > (SELECT (ts, event_id) FROM events WHERE event_id = 5)""")
def _(t: Tables):
    return asof.replay_after(t.events, ["ts", "event_id"], "event_id", 5).select("event_id", "event_type")


ELECTIONS = """
elections AS (
  SELECT o_orderkey AS election_id, o_custkey AS jurisdiction_id,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS election_date FROM orders)"""


def elections(t: Tables):
    """Orders as a calendar; those in progress have no date yet."""
    return t.orders.select(
        F.col("o_orderkey").alias("election_id"), F.col("o_custkey").alias("jurisdiction_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")).alias("election_date"))


@query("top_calendar", with_ctes("""
SELECT election_id, jurisdiction_id, coalesce(CAST(election_date AS VARCHAR), '') AS election_date
FROM elections ORDER BY election_date NULLS LAST, election_id LIMIT 12""".replace("ORDER BY election_date", "ORDER BY elections.election_date"), ELECTIONS))
def _(t: Tables):
    top = ranking.calendar(elections(t), n=12)
    return top.withColumn("election_date", F.coalesce(day_text("election_date"), F.lit("")))


@query("top_calendar_preferred", with_ctes("""
SELECT election_id, jurisdiction_id, coalesce(CAST(election_date AS VARCHAR), '') AS election_date FROM (
  SELECT *, row_number() OVER (PARTITION BY jurisdiction_id ORDER BY election_date NULLS LAST, election_id) AS rn FROM elections)
WHERE rn = 1""", ELECTIONS))
def _(t: Tables):
    top = ranking.calendar(elections(t), per_jurisdiction=True)
    return top.withColumn("election_date", F.coalesce(day_text("election_date"), F.lit("")))


SNAPSHOTS = """
snapshots AS (SELECT o_orderkey AS snapshot_id, c_nationkey AS election_id, CAST(o_orderdate AS DATE) AS published_at, o_orderpriority AS model_family
              FROM orders JOIN customer ON o_custkey = c_custkey)"""


def snapshots(t: Tables):
    return t.poll_headers.select(
        F.col("poll_id").alias("snapshot_id"), "election_id", F.col("fieldwork_end").alias("published_at"),
        F.col("scenario_id").alias("model_family"))


@query("top_history", with_ctes("""
SELECT snapshot_id, CAST(published_at AS VARCHAR) AS published_at, election_id, model_family FROM snapshots""", SNAPSHOTS))
def _(t: Tables):
    return ranking.history(snapshots(t)).select("snapshot_id", "election_id", day_text("published_at").alias("published_at"), "model_family")


@query("top_history_latest", with_ctes("""
SELECT election_id, snapshot_id, CAST(published_at AS VARCHAR) AS published_at FROM (
  SELECT *, row_number() OVER (PARTITION BY election_id ORDER BY published_at DESC, snapshot_id DESC) AS rn FROM snapshots) WHERE rn = 1""", SNAPSHOTS))
def _(t: Tables):
    return ranking.latest_snapshots(snapshots(t)).select("election_id", "snapshot_id", day_text("published_at").alias("published_at"))


# keyed sets ----------------------------------------------------------------------------------


@query("set_union_batches", """
SELECT batch, count(*) AS n, round(sum(amount), 2) AS amount FROM (
  SELECT 'events' AS batch, value AS amount FROM events UNION ALL SELECT 'orders', o_totalprice FROM orders
  UNION ALL SELECT 'lines', l_extendedprice FROM lineitem) GROUP BY 1""")
def _(t: Tables):
    batches = revisions.union_batches(
        t.events.select(F.lit("events").alias("batch"), F.col("value").alias("amount")),
        t.orders.select(F.lit("orders").alias("batch"), F.col("o_totalprice").alias("amount")),
        t.lineitem.select(F.lit("lines").alias("batch"), F.col("l_extendedprice").alias("amount")))
    return batches.groupBy("batch").agg(F.count("*").alias("n"), rnd(F.sum("amount"), 2).alias("amount"))


@query("set_insert_or_existing", """
SELECT content, arg_min(doc_id, (stored, doc_id)) AS doc_id, min(stored) = 1 AS inserted FROM (
  SELECT sha256(text) AS content, doc_id, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS stored FROM documents) GROUP BY 1""")
def _(t: Tables):
    docs = t.documents.select(F.sha2("text", 256).alias("content"), "doc_id", "lang")
    return revisions.resolve_ids(docs.where(F.col("lang") != "en"), docs.where(F.col("lang") == "en"), ["content"], "doc_id")


@query("set_difference", """
SELECT user_id AS ref, 'unknown' AS kind FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1
UNION ALL SELECT o_custkey, 'unused' FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT user_id FROM events) GROUP BY 1""")
def _(t: Tables):
    referenced = t.events.select(F.col("user_id").alias("ref"))
    known = t.orders.where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("ref"))
    unknown = revisions.difference(referenced, known, ["ref"]).withColumn("kind", F.lit("unknown"))
    return unknown.unionByName(revisions.difference(known, referenced, ["ref"]).withColumn("kind", F.lit("unused")))


@query("set_subset", """
SELECT l_orderkey AS order_id, bool_and(l_returnflag IN ('A', 'N')) AS contained FROM lineitem GROUP BY 1""")
def _(t: Tables):
    declared = F.array(F.lit("A"), F.lit("N"))
    required = t.lineitem.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.collect_set("l_returnflag").alias("flags"))
    return required.select("order_id", revisions.is_subset(F.col("flags"), declared).alias("contained"))


@query("set_unique_check", """
SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS copies
FROM events GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def _(t: Tables):
    rows = t.events.select("user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return revisions.duplicate_keys(rows, ["user_id", "event_type", "k"])


@query("snk_append_idempotent", with_ctes(f"""
SELECT jurisdiction_id, metric, revision, min(revision_id) AS revision_id, CAST(0 AS INTEGER) AS inserted_again FROM observations
GROUP BY 1, 2, 3 HAVING min(available_at) > TIMESTAMP '{EVENT_CUTOFF}'""", OBS))
def _(t: Tables):
    keys = ["jurisdiction_id", "metric", "revision"]
    stored = asof.asof_filter(t.observations, ts(EVENT_CUTOFF), ["available_at"])
    fresh = t.observations.groupBy(*keys).agg(F.min("revision_id").alias("revision_id"))
    folder = os.path.join(shared_folder(t.spark), "appended", uuid.uuid4().hex)
    known = stored.select(*keys, "revision_id")
    sinks.append_new(folder, known, keys)
    sinks.append_new(folder, fresh, keys)
    again = sinks.append_new(folder, fresh, keys)  # a second run inserts nothing
    table = t.spark.read.schema(fresh.schema).parquet(folder)
    return table.join(known.select(*keys), keys, "left_anti").withColumn("inserted_again", F.lit(again))
