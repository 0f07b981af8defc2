"""Streaming operators: batch forms on tables, and streams drained over the event files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fourclocks.bindings import Tables, ts
from fourclocks.operators.asof import newest
from fourclocks.operators.segments import time_segment
from fourclocks.registry import clock_text, query, rnd, with_ctes
from fourclocks.registry.ctes import FEED, RUNS
from fourclocks.registry.sources import scratch
from fourclocks.sources import sinks
from fourclocks.streaming import jobs, stateful

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
FEED_WINDOWS = "(SELECT user_id, event_type, min(ts) FILTER (value > 50) AS opens_at, max(ts) FILTER (value > 50) AS closes_at FROM events GROUP BY 1, 2)"


def event_stream(t: Tables) -> DataFrame:
    """The event files as a stream."""
    source = t.spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", 1000)
    return source.parquet(t.folder).withColumn("ts", F.col("ts").cast("timestamp"))


def in_steps(t: Tables, base: str, rows: DataFrame, step, steps: int, run) -> None:
    """Deal rows out to several arrivals; the stream drains each one, from its checkpoint on, before the next one comes."""
    for k in range(steps):
        rows.where(step == k).write.mode("append").parquet(base + "/in")
        run(t.spark.readStream.schema(rows.schema).parquet(base + "/in"))


def by_time(events: DataFrame):
    """Three arrivals in the order of the events' days."""
    return F.least(F.lit(2), F.floor(F.dayofmonth("ts") / 11))


def table_events(t: Tables) -> DataFrame:
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


def feed_rows(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.col("user_id").alias("unit_id"), F.col("event_type").alias("contestant_id"), F.floor("value").cast("long").alias("votes"),
        F.lit(0.5).alias("reporting_fraction"), F.col("ts").alias("reported_at"))


def envelope(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "alert").when(F.col("event_type") == "view", "forecast_publication").when(F.col("event_type") == "signup", "rumor").otherwise("calendar_change")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.struct(
        F.when(F.col("value") > 5, F.col("event_id").cast("string")).otherwise("").alias("id"), kind.alias("type"), stamp.alias("as_of"), stamp.alias("published_at"),
        F.lit("v1").alias("model_version"), F.when(F.col("event_type") != "error", "B").alias("data_quality"), F.lit("fresh").alias("freshness"),
        F.when(F.col("value") > 200, F.array().cast("array<string>")).otherwise(F.array(F.lit("feed"))).alias("provenance"))
    return t.events.select("event_id", F.to_json(record).alias("value"))


PROBLEM = "CASE WHEN event_type = 'error' THEN 'missing:data_quality' WHEN event_type = 'signup' THEN 'unsupported_type' WHEN value <= 5 THEN 'empty_id' WHEN value > 200 THEN 'no_provenance' ELSE '' END"


def routed(t: Tables) -> str:
    """Envelopes of three arrivals, routed; the folder that holds both sides and the counts."""
    base = scratch(t, "route")
    write = jobs.route_events_batch(base + "/events", base + "/rejects", ["event_id"])
    in_steps(t, base, envelope(t), F.col("event_id") % 3, 3, lambda stream: jobs.run_available(stream, base + "/check", write))
    return base


@query("st_event_validate", f"SELECT event_id, {PROBLEM} AS problem FROM events")
def _(t: Tables):
    return jobs.routed_events(t.spark, routed(t) + "/events", "event_id long").select("event_id", "problem")


@query("st_event_accepted", f"""
SELECT event_id, CAST(event_id AS VARCHAR) AS id, CASE event_type WHEN 'click' THEN 'alert' WHEN 'view' THEN 'forecast_publication' ELSE 'calendar_change' END AS type
FROM events WHERE {PROBLEM} = ''""")
def _(t: Tables):
    out = jobs.routed_events(t.spark, routed(t) + "/events", "event_id long")
    return out.where(F.col("outcome") == "accepted").select("event_id", "e.id", "e.type")


@query("st_event_rejects", f"""
SELECT event_id % 3 AS batch, CASE WHEN p = '' THEN 'accepted' ELSE split_part(p, ':', 1) END AS reason, count(*) AS n
FROM (SELECT event_id, {PROBLEM} AS p FROM events) GROUP BY 1, 2""")
def _(t: Tables):
    counts = t.spark.read.schema("reason string, n long, batch long").parquet(routed(t) + "/rejects")
    return counts.where("n > 0").select("batch", "reason", "n")


@query("st_alert_windows", with_ctes("""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, job, count(*) AS runs, count(*) FILTER (status = 'failure') AS failures,
       round(count(*) FILTER (status = 'failure') / CAST(count(*) AS DOUBLE), 9) AS error_ratio, count(*) FILTER (status = 'failure') > 0 AS failure_alert,
       count(*) FILTER (status = 'failure') / CAST(count(*) AS DOUBLE) > 0.05 AS error_alert, count(*) FILTER (value / 1000 > 0.3) AS slow,
       20 * count(*) FILTER (value / 1000 > 0.3) > count(value) AS latency_alert
FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, occurred_at) - s * INTERVAL 5 MINUTE AS w FROM runs CROSS JOIN (VALUES (0), (1), (2)) v(s)) GROUP BY w, job""", RUNS))
def _(t: Tables):
    out = jobs.alert_windows(t.runs.withColumn("latency", F.col("value") / 1000))
    return out.select(clock_text("window_start").alias("window_start"), "job", "runs", "failures", rnd("error_ratio").alias("error_ratio"), "failure_alert", "error_alert", "slow", "latency_alert")


KINDS = "CASE WHEN value < 2 THEN 'parser_drift' WHEN value < 3 THEN 'source_drift' ELSE 'network' END"
AT, BOUNDS = "value / 1000", jobs.LATENCY_BOUNDS
REACHED = [f"count(*) FILTER ({AT} <= {b})" for b in BOUNDS]
P95 = "CASE " + " ".join(
    f"WHEN {c} >= 0.95 * count(value) THEN {BOUNDS[i - 1] if i else 0.0} + ({b} - {BOUNDS[i - 1] if i else 0.0}) * (0.95 * count(value) - {REACHED[i - 1] if i else 0}) / ({c} - {REACHED[i - 1] if i else 0})"
    for i, (b, c) in enumerate(zip(BOUNDS, REACHED))
) + f" ELSE {BOUNDS[-1]} END"


@query("st_alert_windows_stream", with_ctes(f"""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, job, count(*) AS runs, count(*) FILTER (status = 'failure') AS failures,
       count(*) FILTER (status = 'failure' AND {KINDS} <> 'network') AS drifts, count(*) FILTER ({AT} > 0.3) AS slow, round({P95}, 9) AS p95,
       count(*) FILTER (status = 'failure') > 0 AS failure_alert, count(*) FILTER (status = 'failure' AND {KINDS} <> 'network') > 0 AS drift_alert,
       count(*) FILTER (status = 'failure') / CAST(count(*) AS DOUBLE) > 0.05 AS error_alert, 20 * count(*) FILTER ({AT} > 0.3) > count(value) AS latency_alert
FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, occurred_at) - s * INTERVAL 5 MINUTE AS w FROM runs CROSS JOIN (VALUES (0), (1), (2)) v(s)) GROUP BY w, job""", RUNS))
def _(t: Tables):
    kind = F.when(F.col("value") < 2, "parser_drift").when(F.col("value") < 3, "source_drift").otherwise("network")
    runs = t.runs.select("event_id", "job", "occurred_at", "status", kind.alias("failure_kind"), (F.col("value") / 1000).alias("latency"))
    base = scratch(t, "alerts")
    write = jobs.alerts_batch(jobs.alert_ledger(base + "/counts"), base + "/alerts")
    # five arrivals that do not care for time: windows of all days are amended by each
    in_steps(t, base, runs, F.col("event_id") % 5, 5, lambda stream: jobs.run_available(stream, base + "/check", write))
    out = jobs.current_alerts(t.spark, base + "/alerts")
    return out.select(
        clock_text("window_start").alias("window_start"), "job", "runs", "failures", "drifts", "slow", rnd("p95").alias("p95"),
        "failure_alert", "drift_alert", "error_alert", "latency_alert")


@query("st_alert_staleness", with_ctes("""
SELECT job, scope, round(epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(occurred_at) FILTER (status = 'success')) / 1e6, 3) AS age_seconds,
       coalesce(epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(occurred_at) FILTER (status = 'success')) / 1e6 > 190000, TRUE) AS stale FROM runs GROUP BY 1, 2""", RUNS))
def _(t: Tables):
    out = jobs.stale_keys(t.runs, ["job", "scope"], "occurred_at", ts("2024-02-01 00:00:00"), 190_000)
    return out.select("job", "scope", rnd("age_seconds", 3).alias("age_seconds"), "stale")


def buffers(t: Tables) -> DataFrame:
    """The buffers after three arrivals that do not care for time."""
    stateful.use_keyed_state(t.spark)
    rows = table_events(t).select("user_id", F.col("ts").cast("double").alias("at"), "event_id")
    base = scratch(t, "buffer")

    def run(stream: DataFrame) -> None:
        jobs.store_available(stateful.latest_buffer(stream, "user_id", 50), base + "/check", base + "/out", "update")

    in_steps(t, base, rows, F.col("event_id") % 3, 3, run)
    return newest(t.spark.read.parquet(base + "/out"), ["subscriber"], ["batch"])


@query("st_latest_buffer", """
SELECT user_id, least(count(*), 50) AS buffered, greatest(count(*) - 50, 0) AS dropped, arg_max(event_id, (ts, event_id)) AS newest FROM events GROUP BY 1""")
def _(t: Tables):
    return buffers(t).select(
        F.col("subscriber").alias("user_id"), F.col("buffered").cast("long").alias("buffered"), "dropped", F.element_at("held", -1).alias("newest"))


@query("st_latest_buffer_rows", """
SELECT user_id, event_id, n - rn AS from_oldest FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, least(count(*) OVER (PARTITION BY user_id), 50) AS n FROM events) WHERE rn <= 50""")
def _(t: Tables):
    held = buffers(t).select(F.col("subscriber").alias("user_id"), F.posexplode("held").alias("p", "event_id"))
    return held.select("user_id", "event_id", F.col("p").cast("long").alias("from_oldest"))


@query("st_heartbeat", "SELECT user_id AS subscriber, count(*) AS events, TRUE AS silent_beat FROM events GROUP BY 1")
def _(t: Tables):
    stateful.use_keyed_state(t.spark)
    base = scratch(t, "beats")
    wanted = t.events.select("user_id").distinct().count()
    beats = stateful.heartbeats(event_stream(t).select("user_id", "event_id"), "user_id", 1)
    schema = "subscriber long, kind string, n long"

    def heard() -> DataFrame:
        rows = t.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(base + "/out") if sinks.table_exists(t.spark, base + "/out") else t.spark.createDataFrame([], schema)
        return rows.groupBy("subscriber").agg(F.sum("n").alias("events"), F.bool_or(F.col("kind") == "heartbeat").alias("silent_beat"))

    jobs.run_until(beats, base + "/check", base + "/out", lambda: heard().where("silent_beat").count() == wanted, 120)
    return heard()


@query("st_rate_limit", """
SELECT user_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, count(*) AS hits, count(*) > 1 AS limited FROM events GROUP BY 1, 2""")
def _(t: Tables):
    out = jobs.rate_limit(t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", 1)
    return out.withColumn("minute", clock_text("minute"))


@query("st_rate_limit_accepted", """
WITH RECURSIVE hits AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events),
chain AS (
  SELECT user_id, min(us) AS us FROM hits GROUP BY 1
  UNION ALL SELECT c.user_id, min(h.us) FROM chain c JOIN hits h ON h.user_id = c.user_id AND h.us >= c.us + 3600000000 GROUP BY c.user_id, c.us)
SELECT h.user_id AS client, event_id, c.us IS NOT NULL AS allowed FROM hits h LEFT JOIN chain c ON c.user_id = h.user_id AND c.us = h.us""")
def _(t: Tables):
    stateful.use_keyed_state(t.spark)
    hits = event_stream(t).select("user_id", "event_id", F.col("ts").cast("double").alias("at"))
    base = scratch(t, "rate")
    jobs.store_available(stateful.accepted_rate(hits, "user_id", 1, 3600), base + "/check", base + "/out")
    return t.spark.read.parquet(base + "/out").select("client", "event_id", "allowed")


@query("st_result_monotonic", with_ctes("""
SELECT event_id, unit_id, contestant_id, best AS votes, votes >= best AS accepted, CASE WHEN votes >= best THEN '' ELSE 'source_drift' END AS warning
FROM (SELECT *, max(votes) OVER (PARTITION BY unit_id, contestant_id ORDER BY reported_at, event_id) AS best FROM feed)""", FEED))
def _(t: Tables):
    stateful.use_keyed_state(t.spark)
    base = scratch(t, "monotonic")
    jobs.store_available(stateful.monotonic_results(feed_rows(event_stream(t))), base + "/check", base + "/out")
    return t.spark.read.parquet(base + "/out").select("event_id", "unit_id", "contestant_id", "votes", "accepted", "warning")


@query("st_dedupe_events", """
SELECT DISTINCT user_id || ':' || event_type AS id FROM events""")
def _(t: Tables):
    keyed = table_events(t).select("event_id", F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_type")).alias("id"), "ts")
    # three arrivals that do not care for time, and repeats that come 41 days later
    late = keyed.where(F.col("event_id") % 5 == 0).withColumn("ts", F.col("ts") + F.expr("INTERVAL 41 DAYS"))
    rows = keyed.withColumn("arrival", F.col("event_id") % 3).unionByName(late.withColumn("arrival", F.lit(2).cast("long")))
    base = scratch(t, "dedupe")
    write = jobs.new_events_batch(jobs.seen_ids(base + "/ids"), base + "/out", "id", ["ts", "event_id"])
    in_steps(t, base, rows, F.col("arrival"), 3, lambda stream: jobs.run_available(stream, base + "/check", write))
    return t.spark.read.parquet(base + "/out").select("id")


@query("st_live_window", f"""
SELECT event_id, e.user_id FROM events e JOIN {FEED_WINDOWS} w USING (user_id, event_type) WHERE ts BETWEEN opens_at AND closes_at""")
def _(t: Tables):
    clock = F.when(F.col("value") > 50, F.col("ts").cast("timestamp"))
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_type")).alias("feed")
    feeds = t.events.groupBy(key).agg(F.min(clock).alias("opens_at"), F.max(clock).alias("closes_at"))
    base = scratch(t, "window")
    live = jobs.in_window(event_stream(t).select("event_id", "user_id", "ts", key), feeds, "feed", "ts")
    jobs.store_available(live, base + "/check", base + "/out")
    return t.spark.read.parquet(base + "/out").select("event_id", "user_id")


@query("join_stream_static", f"""
SELECT event_id, c_custkey IS NOT NULL AS known_unit, coalesce(c_acctbal > 0, FALSE) AS approved, coalesce(ts BETWEEN opens_at AND closes_at, FALSE) AS in_window
FROM events e LEFT JOIN customer ON c_custkey = user_id
LEFT JOIN (SELECT user_id, min(opens_at) AS opens_at, max(closes_at) AS closes_at FROM {FEED_WINDOWS} GROUP BY 1) w ON w.user_id = e.user_id""")
def _(t: Tables):
    clock = F.when(F.col("value") > 50, F.col("ts").cast("timestamp"))
    windows = t.events.groupBy(F.col("user_id").alias("unit_id")).agg(F.min(clock).alias("opens_at"), F.max(clock).alias("closes_at"))
    units = t.customer.select(F.col("c_custkey").alias("unit_id"))
    registry = t.customer.select(F.col("c_custkey").alias("source_id"), (F.col("c_acctbal") > 0).alias("approved"))
    rows = feed_rows(event_stream(t)).withColumn("source_id", F.col("unit_id"))
    base = scratch(t, "enrich")
    jobs.store_available(jobs.enrich_stream(rows, windows, units, registry), base + "/check", base + "/out")
    return t.spark.read.parquet(base + "/out").select("event_id", "known_unit", "approved", "in_window")


def feed_batch(events: DataFrame) -> DataFrame:
    day = F.floor(F.col("ts").cast("double") / 86400).cast("long")
    return events.withColumn("feed_id", F.col("user_id") * 1000 + day % 1000).select(
        "feed_id", F.col("user_id").alias("unit_id"), F.concat_ws(":", F.col("event_type"), F.col("event_id").cast("string")).alias("contestant_id"),
        F.floor("value").cast("long").alias("votes"), F.lit(0.5).alias("reporting_fraction"), F.col("ts").alias("reported_at"), (F.col("value") >= 5).alias("valid"))


@query("st_batch_atomic_fallback", """
SELECT feed_id, count(*) AS total, round(count(*) FILTER (value >= 5) / CAST(count(*) AS DOUBLE), 9) AS confidence,
       CASE WHEN count(*) FILTER (value >= 5) / CAST(count(*) AS DOUBLE) < 0.98 THEN 'fallback_parser_drift' ELSE 'accepted' END AS outcome
FROM (SELECT user_id * 1000 + CAST(floor(epoch(ts) / 86400) AS BIGINT) % 1000 AS feed_id, value FROM events) GROUP BY 1""")
def _(t: Tables):
    base = scratch(t, "feeds")
    jobs.run_available(feed_batch(event_stream(t)), base + "/check", jobs.ingest_feed_batch(jobs.result_ledger(base + "/results"), base + "/decisions"))
    out = t.spark.read.schema(jobs.DECISION_SCHEMA).parquet(base + "/decisions")
    return out.select("feed_id", "total", rnd("confidence").alias("confidence"), "outcome")


@query("st_batch_outcomes", """
WITH feeds AS (
  SELECT feed_id, count(*) AS n, count(*) FILTER (value >= 5) / CAST(count(*) AS DOUBLE) AS confidence
  FROM (SELECT user_id * 1000 + CAST(floor(epoch(ts) / 86400) AS BIGINT) % 1000 AS feed_id, value FROM events) GROUP BY 1)
SELECT 0 AS batch, feed_id, CASE WHEN feed_id % 5 = 0 THEN 2 * n ELSE n END AS total,
       CASE WHEN confidence < 0.98 THEN 'fallback_parser_drift' WHEN feed_id % 5 = 0 THEN 'fallback_duplicates' ELSE 'accepted' END AS outcome FROM feeds
UNION ALL
SELECT 1, feed_id, n, CASE WHEN confidence < 0.98 THEN 'fallback_parser_drift' WHEN feed_id % 3 = 0 AND feed_id % 5 <> 0 THEN 'fallback_source_drift' ELSE 'accepted' END
FROM feeds WHERE feed_id % 3 < 2""")
def _(t: Tables):
    rows = feed_batch(table_events(t)).withColumn("arrival", F.lit(0))
    twice = rows.where(F.col("feed_id") % 5 == 0)
    # a second time: every third feed falls back by a vote, the next ones gain one
    again = rows.where(F.col("feed_id") % 3 < 2).withColumns({
        "arrival": F.lit(1), "votes": F.col("votes") + F.when(F.col("feed_id") % 3 == 0, -1).otherwise(1), "reported_at": F.col("reported_at") + F.expr("INTERVAL 1 HOUR")})
    base = scratch(t, "outcomes")
    write = jobs.ingest_feed_batch(jobs.result_ledger(base + "/results"), base + "/decisions")
    in_steps(t, base, rows.unionByName(twice).unionByName(again), F.col("arrival"), 2, lambda stream: jobs.run_available(stream, base + "/check", write))
    out = t.spark.read.schema(jobs.DECISION_SCHEMA + ", batch int").parquet(base + "/decisions")
    return out.select("batch", "feed_id", "total", "outcome")


@query("st_checkpoint_upsert", """
SELECT event_type AS adapter_id, user_id % 10 AS scope_id, arg_max(CAST(json_extract_string(props, '$.k') AS INTEGER) % 3, (ts, event_id)) || '' AS content FROM events GROUP BY 1, 2""")
def _(t: Tables):
    rows = table_events(t).select(
        F.col("event_type").alias("adapter_id"), (F.col("user_id") % 10).alias("scope_id"), F.lit("v1").alias("parser_version"),
        (F.get_json_object("props", "$.k").cast("int") % 3).cast("string").alias("sha256"), F.col("ts").alias("updated_at"), by_time(t.events).alias("arrival"))
    base = scratch(t, "checkpoints")
    ledger = jobs.checkpoint_ledger(base + "/rows")
    write = jobs.upsert_checkpoints_batch(ledger, base + "/health")
    in_steps(t, base, rows, F.col("arrival"), 3, lambda stream: jobs.run_available(stream, base + "/check", write))
    return jobs.current_checkpoints(t.spark, ledger).select("adapter_id", "scope_id", F.col("sha256").alias("content"))


@query("st_latest_snapshot", with_ctes("""
SELECT unit_id, contestant_id, votes, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY unit_id, contestant_id ORDER BY reported_at DESC, event_id DESC) AS rn FROM feed) WHERE rn = 1""", FEED))
def _(t: Tables):
    base = scratch(t, "snapshot")
    ledger = jobs.snapshot_ledger(base + "/rows")
    run = jobs.maintain_snapshot_batch(ledger)
    in_steps(t, base, feed_rows(table_events(t)), F.col("event_id") % 3, 3, lambda stream: jobs.run_available(stream, base + "/check", run))
    ledger.compact(t.spark, jobs.newest_rows)
    return jobs.current_snapshot(t.spark, ledger).select("unit_id", "contestant_id", "votes", "event_id")


@query("st_calendar_change", """
SELECT 'calendar:' || user_id || ':' || (k % 3) || ':' || event_id AS id, user_id AS election_id FROM (
  SELECT *, lag(k % 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
WHERE before IS DISTINCT FROM k % 3""")
def _(t: Tables):
    rows = table_events(t).select(
        F.col("user_id").alias("election_id"), (F.get_json_object("props", "$.k").cast("int") % 3).cast("string").alias("content"), F.col("ts").alias("released_at"),
        F.col("event_id").alias("record_id"), by_time(t.events).alias("arrival"))
    base = scratch(t, "calendar")
    write = jobs.calendar_changes_batch(jobs.calendar_ledger(base + "/rows"), base + "/events", lambda: time_segment(F.col("released_at"), 3600))
    in_steps(t, base, rows, F.col("arrival"), 3, lambda stream: jobs.run_available(stream, base + "/check", write))
    return t.spark.read.parquet(base + "/events").select("id", "election_id")


@query("snk_event_topic", "SELECT CASE event_type WHEN 'click' THEN 'alert' ELSE 'calendar_change' END AS type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def _(t: Tables):
    kind = F.when(F.col("event_type") == "click", "alert").otherwise("calendar_change")
    base = scratch(t, "sink")
    sinks.write_events(t.events.select("event_id", kind.alias("type"), "value"), base)
    lines = t.spark.read.schema("value string, type string").text(base)
    total = F.get_json_object("value", "$.value").cast("double")
    return lines.groupBy("type").agg(F.count("*").alias("n"), rnd(F.sum(total), 2).alias("total"))


@query("src_event_topic", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'alert' ELSE 'calendar_change' END AS type FROM events""")
def _(t: Tables):
    kind = F.when(F.col("event_type") == "click", "alert").otherwise("calendar_change")
    base = scratch(t, "topic")
    sinks.write_events(t.events.select("event_id", kind.alias("type"), "value"), base + "/topic")
    stream = sinks.read_events(t.spark, base + "/topic", "event_id long, type string, value double")
    jobs.store_available(stream, base + "/check", base + "/out")
    return t.spark.read.parquet(base + "/out").select("event_id", "type")
