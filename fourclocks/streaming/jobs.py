"""Streaming forms of the event, result and checkpoint operators.

Functions that return a DataFrame work on streams and on tables alike. ``*_batch`` functions are
meant for ``foreachBatch``: every write carries the batch id or a natural key, so a batch that is
replayed after a lost executor or driver changes nothing.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fourclocks.operators.asof import newest
from fourclocks.operators.revisions import number_revisions
from fourclocks.operators.reporting import LATENCY_BOUNDS
from fourclocks.sources.sinks import table_exists
from fourclocks.streaming.ledger import Ledger

# The envelope contract.
EVENT_TYPES = ("alert", "calendar_change", "forecast_publication", "official_result_update")
EVENT_FIELDS = ("id", "type", "as_of", "published_at", "model_version", "data_quality", "freshness", "provenance")
REFUSALS = ("missing", "unsupported_type", "empty_id", "bad_time", "no_provenance")
ENVELOPE = (
    "id string, type string, as_of string, published_at string, model_version string, "
    "data_quality string, freshness string, provenance array<string>"
)


def validate_events(raw: DataFrame, value: str = "value") -> DataFrame:
    """Parsed envelopes with the first rule each breaks (empty when valid)."""
    keys = F.json_object_keys(F.col(value))
    missing = F.array_except(F.array(*[F.lit(f) for f in EVENT_FIELDS]), F.coalesce(keys, F.array().cast("array<string>")))
    parsed = raw.withColumn("e", F.from_json(F.col(value), ENVELOPE)).withColumn("_missing", missing)
    problem = (
        F.when(F.size("_missing") > 0, F.concat(F.lit("missing:"), F.array_join("_missing", ",")))
        .when(~F.coalesce(F.col("e.type").isin(*EVENT_TYPES), F.lit(False)), "unsupported_type")
        .when(F.coalesce(F.length("e.id"), F.lit(0)) == 0, "empty_id")
        .when(F.try_to_timestamp("e.as_of").isNull() | F.try_to_timestamp("e.published_at").isNull(), "bad_time")
        .when(F.coalesce(F.size("e.provenance"), F.lit(0)) <= 0, "no_provenance")
        .otherwise("")
    )
    return parsed.withColumn("problem", problem).drop("_missing")


def route_events_batch(events: str, rejects: str, extra: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """Envelopes fan out in one write: valid ones to ``outcome=accepted``, refused ones with their reason to ``outcome=dead``.

    Both lie below ``events``, in a folder per batch id, with the raw value and the columns ``extra``. The counts per reason
    are observed during that write and put below ``rejects``, one small file a batch; a replayed batch replaces both.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation("routed")
        checked = validate_events(batch).withColumn("outcome", F.when(F.col("problem") == "", "accepted").otherwise("dead"))
        reason = F.split_part("problem", F.lit(":"), F.lit(1))
        counts = {name: F.count_if(reason == name).alias(name or "accepted") for name in ("", *REFUSALS)}
        counted = checked.observe(seen, *counts.values())
        fanned = counted.select(*extra, "value", "problem", F.when(F.col("outcome") == "accepted", F.col("e")).alias("e"), "outcome")
        fanned.write.mode("overwrite").partitionBy("outcome").parquet(os.path.join(events, f"batch={batch_id}"))
        got = [(name, int(n)) for name, n in seen.get.items()]
        told = batch.sparkSession.createDataFrame(got, "reason string, n long").coalesce(1)
        told.write.mode("overwrite").parquet(os.path.join(rejects, f"batch={batch_id}"))

    return write


def routed_events(spark: SparkSession, events: str, extra: str = "") -> DataFrame:
    """What ``route_events_batch`` put down; a filter on ``outcome`` reads that side's folders only."""
    fields = ", ".join(f"{n}:{k}" for n, k in (x.split(" ", 1) for x in ENVELOPE.split(", ")))
    columns = f"{extra}{', ' if extra else ''}value string, problem string, e struct<{fields}>, outcome string, batch long"
    return spark.read.schema(columns).parquet(events)


def dedupe_events(stream: DataFrame, id_column: str, clock: str, delay: str = "1 hour") -> DataFrame:
    """Drop repeated ids that arrive within the delay of the first; rows behind the watermark are lost. For ids that must stay
    no-ops without end, see ``new_events_batch``."""
    return stream.withWatermark(clock, delay).dropDuplicatesWithinWatermark([id_column])


def seen_ids(path: str, kind: str = "string", buckets: int = 256) -> Ledger:
    return Ledger(path, f"id {kind}", ["id"], buckets)


def new_events_batch(ids: Ledger, out: str, id_column: str, order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Pass each id on once, however late its first row or a repeat comes.

    Of a batch's rows of one id the first by ``order`` (then by its JSON text) stands for it. The ids that were passed on lie
    in a ledger; a batch reads the buckets that its ids hit and leaves out those of earlier batches. New rows go below ``out``
    under the batch id, then their ids to the ledger; a replay repeats both.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != id_column]
        row = F.struct(*rest)
        first = batch.groupBy(F.col(id_column).alias("id")).agg(F.min_by(row, F.struct(*order, F.to_json(row))).alias("_row"))
        known = ids.read(spark, ids.hits(batch.select(F.col(id_column).alias("id"))), batch_id).select(F.col("id").alias("_known"))
        fresh = first.join(known, F.col("id").eqNullSafe(F.col("_known")), "left_anti")
        folder = os.path.join(out, f"batch={batch_id}")
        fresh.select(F.col("id").alias(id_column), "_row.*").write.mode("overwrite").parquet(folder)
        ids.write(spark.read.schema(fresh.select(F.col("id").alias(id_column), "_row.*").schema).parquet(folder).select(F.col(id_column).alias("id")), batch_id)

    return write


def enrich_stream(stream: DataFrame, windows: DataFrame, units: DataFrame, registry: DataFrame) -> DataFrame:
    """Live rows with their feed window, a known-unit flag and their source's approval."""
    known = units.select("unit_id").distinct().withColumn("known_unit", F.lit(True))
    return (
        stream.join(windows, "unit_id", "left")
        .join(known, "unit_id", "left")
        .join(registry, "source_id", "left")
        .withColumns(
            {
                "known_unit": F.coalesce("known_unit", F.lit(False)),
                "approved": F.coalesce("approved", F.lit(False)),
                "in_window": F.coalesce(F.col("reported_at").between(F.col("opens_at"), F.col("closes_at")), F.lit(False)),
            }
        )
    )


def in_window(stream: DataFrame, feeds: DataFrame, key: str, clock: str) -> DataFrame:
    """Rows whose feed window is open at their own time, both ends included."""
    return stream.join(feeds, key).where(F.col(clock).between(F.col("opens_at"), F.col("closes_at"))).drop("opens_at", "closes_at")


def alert_windows(
    runs: DataFrame, clock: str = "occurred_at", width: str = "15 minutes", slide: str = "5 minutes",
    max_error_ratio: float = 0.05, max_p95: float = 0.3, delay: str = "1 hour",
) -> DataFrame:
    """Failures, error ratio, share of slow runs and approximate p95 latency per job and sliding window, with alerts.

    Needs job, status and latency. The latency alert is exact: p95 is above the limit where more than 5 % of the runs with
    a latency are slower than it. The p95 figure beside it comes from a bounded sketch.
    """
    source = runs.withWatermark(clock, delay) if runs.isStreaming else runs
    counted = source.groupBy(F.window(clock, width, slide).alias("w"), "job").agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("status") == "failure").alias("failures"),
        F.count("latency").alias("timed"),
        F.count_if(F.col("latency") > max_p95).alias("slow"),
        F.percentile_approx("latency", 0.95, 1000).alias("p95"),
    )
    ratio = F.col("failures") / F.col("runs")
    return counted.select(
        F.col("w.start").alias("window_start"),
        "job",
        "runs",
        "failures",
        ratio.alias("error_ratio"),
        "slow",
        "p95",
        (F.col("failures") > 0).alias("failure_alert"),
        (ratio > max_error_ratio).alias("error_alert"),
        (F.col("slow") * 20 > F.col("timed")).alias("latency_alert"),
    )


#: Drift kinds among the failures of a run, as its warnings name them.
DRIFT_KINDS = ("parser_drift", "source_drift")
COUNTS = ("runs", "failures", "drifts", "timed", "slow", *[f"h{i}" for i in range(len(LATENCY_BOUNDS) + 1)])
ALERT_SCHEMA = "window_start timestamp, job string, window_day date, " + ", ".join(f"{c} long" for c in COUNTS)


def window_counts(runs: DataFrame, clock: str = "occurred_at", width: str = "15 minutes", slide: str = "5 minutes", max_p95: float = 0.3) -> DataFrame:
    """Counts per job and sliding window that add up over any split of the runs; ``h0``.. is the latency histogram.

    Needs job, status, failure_kind and latency (null: not timed).
    """
    at = F.col("latency")
    hits = [F.count_if(at <= LATENCY_BOUNDS[0])]
    hits += [F.count_if((at > low) & (at <= high)) for low, high in zip(LATENCY_BOUNDS, LATENCY_BOUNDS[1:])]
    hits += [F.count_if(at > LATENCY_BOUNDS[-1])]
    failed = F.col("status") == "failure"
    sums = [F.count("*"), F.count_if(failed), F.count_if(failed & F.col("failure_kind").isin(*DRIFT_KINDS)), F.count("latency"), F.count_if(at > max_p95), *hits]
    counted = runs.groupBy(F.window(clock, width, slide).alias("w"), "job").agg(*[c.alias(n) for n, c in zip(COUNTS, sums, strict=True)])
    return counted.select(F.col("w.start").alias("window_start"), "job", F.to_date("w.start").alias("window_day"), *COUNTS)


def merge_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("window_start", "job", "window_day").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])


def judge_counts(counts: DataFrame, max_error_ratio: float = 0.05) -> DataFrame:
    """Alerts of merged counts. The latency alert is exact; p95 is read from the histogram, linear inside a bucket and the last
    bound for what lies above it."""
    wanted, before, p95 = F.col("timed") * 0.95, F.lit(0), F.lit(LATENCY_BOUNDS[-1])
    steps = []
    for i, high in enumerate(LATENCY_BOUNDS):
        low = LATENCY_BOUNDS[i - 1] if i else 0.0
        inside = F.lit(low) + (F.lit(high) - F.lit(low)) * F.try_divide(wanted - before, F.col(f"h{i}"))
        steps.append((before + F.col(f"h{i}") >= wanted, inside))
        before = before + F.col(f"h{i}")
    for reached, inside in reversed(steps):
        p95 = F.when(reached, inside).otherwise(p95)
    ratio = F.col("failures") / F.col("runs")
    return counts.select(
        "window_start", "job", "runs", "failures", "drifts", ratio.alias("error_ratio"), "slow",
        F.when(F.col("timed") > 0, p95).alias("p95"),
        (F.col("failures") > 0).alias("failure_alert"),
        (F.col("drifts") > 0).alias("drift_alert"),
        (ratio > max_error_ratio).alias("error_alert"),
        (F.col("slow") * 20 > F.col("timed")).alias("latency_alert"),
    )


def alert_ledger(path: str, buckets: int = 64) -> Ledger:
    """Window counts by day: a day's counts are bounded by its windows and jobs."""
    return Ledger(path, ALERT_SCHEMA, ["window_day"], buckets)


def alerts_batch(counts: Ledger, alerts: str) -> Callable[[DataFrame, int], None]:
    """Add a batch's counts to the ledger and tell the windows that they amend, late rows too.

    Only the days of the batch's windows are read back. ``alerts`` holds the amended windows per batch id; of a window the
    last batch counts (``current_alerts``).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counts.write(window_counts(batch), batch_id)
        own = counts.read(spark).where(F.col("batch") == batch_id)
        touched = own.select("window_start", "job", "window_day").distinct()
        hits = [r[0] for r in own.select("bucket").distinct().collect()]  # at most the ledger's buckets
        known = counts.read(spark, hits, batch_id + 1).drop("bucket", "batch")
        amended = merge_counts(known.join(touched, ["window_start", "job", "window_day"], "left_semi"))
        judge_counts(amended).write.mode("overwrite").parquet(os.path.join(alerts, f"batch={batch_id}"))

    return write


def current_alerts(spark: SparkSession, alerts: str) -> DataFrame:
    return newest(spark.read.parquet(alerts), ["window_start", "job"], ["batch"]).drop("batch")


def stale_keys(runs: DataFrame, keys: Sequence[str], clock: str, now: Column, limit_seconds: float = 90_000) -> DataFrame:
    """Keys whose last success is older than the limit."""
    last = F.max(F.when(F.col("status") == "success", F.col(clock)))
    age = now.cast("timestamp").cast("double") - F.col("last_success").cast("double")
    return (
        runs.groupBy(*keys).agg(last.alias("last_success")).withColumn("age_seconds", age)
        .withColumn("stale", F.coalesce(F.col("age_seconds") > limit_seconds, F.lit(True)))
    )


def rate_limit(events: DataFrame, key: str, clock: str, limit: int = 120, delay: str = "5 minutes") -> DataFrame:
    """Hits per client and calendar minute, flagged above the limit."""
    source = events.withWatermark(clock, delay) if events.isStreaming else events
    counted = source.groupBy(F.window(clock, "1 minute").alias("w"), key).agg(F.count("*").alias("hits"))
    return counted.select(key, F.col("w.start").alias("minute"), "hits", (F.col("hits") > limit).alias("limited"))


def buffer_state(events: DataFrame, key: str, order: Sequence[str], size: int = 100) -> DataFrame:
    """Batch form of the bounded buffer: held and dropped per subscriber.

    Counts aggregate before the shuffle; nothing needs the rows of a subscriber in one place.
    """
    return events.groupBy(key).agg(F.count("*").alias("_n"), F.max(F.struct(*order)).alias("_newest")).select(
        key,
        F.least(F.col("_n"), F.lit(size)).alias("buffered"),
        F.greatest(F.col("_n") - size, F.lit(0)).alias("dropped"),
        F.col("_newest")[order[-1]].alias("newest"),
    )


RESULT_SCHEMA = "feed_id long, unit_id long, contestant_id string, votes long, reporting_fraction double, reported_at timestamp"
DECISION_SCHEMA = "feed_id long, total long, confidence double, regressed long, duplicates long, outcome string"


def feed_decisions(batch: DataFrame, stored: DataFrame, minimum_confidence: float = 0.98) -> DataFrame:
    """Accept or fall back, feed by feed: one regressed or duplicate row refuses the whole feed.

    batch: feed_id, unit_id, contestant_id, votes, reporting_fraction, reported_at, valid.
    """
    keys = ["feed_id", "unit_id", "contestant_id"]
    previous = newest(stored, keys, ["reported_at", "votes"]).select(
        *keys, F.col("votes").alias("_v"), F.col("reporting_fraction").alias("_f"), F.col("reported_at").alias("_t")
    )
    joined = batch.where("valid").join(previous, keys, "left")
    behind = (F.col("votes") < F.col("_v")) | (F.col("reporting_fraction") < F.col("_f")) | (F.col("reported_at") < F.col("_t"))
    changed = (F.col("reported_at") == F.col("_t")) & (
        (F.col("votes") != F.col("_v")) | (F.col("reporting_fraction") != F.col("_f"))
    )
    bad = joined.groupBy("feed_id").agg(F.count_if(F.coalesce(behind | changed, F.lit(False))).alias("regressed"))
    twice = batch.where("valid").groupBy(*keys).agg(F.count("*").alias("_n")).groupBy("feed_id").agg(
        F.count_if(F.col("_n") > 1).alias("duplicates")
    )
    sums = batch.groupBy("feed_id").agg(
        F.count("*").alias("total"), (F.count_if(F.col("valid")) / F.count("*")).alias("confidence")
    )
    judged = sums.join(bad, "feed_id", "left").join(twice, "feed_id", "left").na.fill(0, ["regressed", "duplicates"])
    outcome = (
        F.when(F.col("confidence") < minimum_confidence, "fallback_parser_drift")
        .when(F.col("duplicates") > 0, "fallback_duplicates")
        .when(F.col("regressed") > 0, "fallback_source_drift")
        .otherwise("accepted")
    )
    return judged.withColumn("outcome", outcome)


def result_ledger(path: str) -> Ledger:
    return Ledger(path, RESULT_SCHEMA, ["feed_id"])


def ingest_feed_batch(results: Ledger, decisions: str, minimum_confidence: float = 0.98) -> Callable[[DataFrame, int], None]:
    """Append accepted feeds only; a feed that falls back is reported but never stored.

    Both tables are written per batch id, so a replayed batch replaces its own output, and the
    stored state a batch is judged against leaves that output out. Of the stored rows only the buckets of the batch's feeds
    are read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = results.read(spark, results.hits(batch), batch_id).drop("bucket", "batch")
        judged = feed_decisions(batch, stored, minimum_confidence)
        judged.select("feed_id", "total", "confidence", "regressed", "duplicates", "outcome").write.mode("overwrite").parquet(
            os.path.join(decisions, f"batch={batch_id}")
        )
        verdicts = spark.read.schema(DECISION_SCHEMA).parquet(os.path.join(decisions, f"batch={batch_id}"))
        accepted = verdicts.where(F.col("outcome") == "accepted").select("feed_id")
        columns = ["feed_id", "unit_id", "contestant_id", "votes", "reporting_fraction", "reported_at"]
        results.write(batch.where("valid").select(*columns).join(accepted, "feed_id", "left_semi"), batch_id)

    return write


CHECKPOINT_SCHEMA = "adapter_id string, scope_id long, parser_version string, sha256 string, updated_at timestamp"
CHECKPOINT_ORDER = ["updated_at", "sha256", "parser_version"]


def checkpoint_ledger(path: str) -> Ledger:
    return Ledger(path, CHECKPOINT_SCHEMA, ["adapter_id", "scope_id"])


def upsert_checkpoints_batch(checkpoints: Ledger, health: str) -> Callable[[DataFrame, int], None]:
    """Append a checkpoint when its hash or parser version changed; health rows always.

    The ledger is append-only and read by the buckets of the batch's keys; ``current_checkpoints`` reads the state.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        keys = ["adapter_id", "scope_id"]
        columns = [*keys, "parser_version", "sha256", "updated_at"]
        latest = newest(batch.select(*columns), keys, CHECKPOINT_ORDER)
        held = newest(checkpoints.read(batch.sparkSession, checkpoints.hits(batch), batch_id).select(*columns), keys, CHECKPOINT_ORDER)
        before = held.select(*keys, F.col("sha256").alias("_s"), F.col("parser_version").alias("_p"))
        joined = latest.join(before, keys, "left")
        same = F.col("sha256").eqNullSafe(F.col("_s")) & F.col("parser_version").eqNullSafe(F.col("_p"))
        checkpoints.write(joined.where(~same).select(*columns), batch_id)
        batch.select(*keys, "updated_at", F.lit("success").alias("status")).write.mode("overwrite").parquet(
            os.path.join(health, f"batch={batch_id}")
        )

    return write


def current_checkpoints(spark: SparkSession, checkpoints: Ledger) -> DataFrame:
    rows = checkpoints.read(spark).drop("bucket", "batch")
    return newest(rows, ["adapter_id", "scope_id"], CHECKPOINT_ORDER)


SNAPSHOT_SCHEMA = "unit_id long, contestant_id string, votes long, reported_at timestamp, event_id long"


def snapshot_ledger(path: str) -> Ledger:
    return Ledger(path, SNAPSHOT_SCHEMA, ["unit_id", "contestant_id"])


def newest_rows(rows: DataFrame) -> DataFrame:
    return newest(rows, ["unit_id", "contestant_id"], ["reported_at", "event_id"])


def maintain_snapshot_batch(snapshot: Ledger) -> Callable[[DataFrame, int], None]:
    """Append each batch's newest row per unit and contestant; readers take the newest overall.

    ``snapshot.compact(spark, newest_rows)`` shortens the log to one row a key.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        snapshot.write(newest_rows(batch.select("unit_id", "contestant_id", "votes", "reported_at", "event_id")), batch_id)

    return write


def current_snapshot(spark: SparkSession, snapshot: Ledger, wanted: DataFrame | None = None) -> DataFrame:
    """The newest row of every key, or of the keys in ``wanted``, of whose buckets alone are read."""
    rows = snapshot.read(spark, None if wanted is None else snapshot.hits(wanted)).drop("bucket", "batch")
    kept = rows if wanted is None else rows.join(wanted.select("unit_id", "contestant_id").distinct(), ["unit_id", "contestant_id"], "left_semi")
    return newest_rows(kept)


CALENDAR_SCHEMA = "election_id long, content string, released_at timestamp, record_id long"


def calendar_ledger(path: str) -> Ledger:
    return Ledger(path, CALENDAR_SCHEMA, ["election_id"])


def calendar_changes_batch(revisions: Ledger, events: str, segment: Callable[[], Column]) -> Callable[[DataFrame, int], None]:
    """Append calendar rows whose content differs from the one before and announce each.

    The stored latest row of an election stands in front of the batch's rows, so the first new
    row is compared with it; rows that repeat it append nothing and announce nothing. Only the batch's elections' buckets
    of the ledger are read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = ["election_id", "content", "released_at", "record_id"]
        held = newest(revisions.read(spark, revisions.hits(batch), batch_id).select(*columns), ["election_id"], ["released_at", "record_id"])
        rows = batch.select(*columns).withColumn("_new", F.lit(True)).unionByName(held.withColumn("_new", F.lit(False)))
        numbered = number_revisions(rows, ["election_id"], ["released_at", "record_id"], "content", segment())
        first = numbered.groupBy("election_id", "revision").agg(
            F.min_by(F.struct("content", "released_at", "record_id", "_new"), F.struct("released_at", "record_id")).alias("_r")
        ).select("election_id", "revision", "_r.*").where("_new")
        revisions.write(first.select(*columns), batch_id)
        announced = revisions.read(spark, revisions.hits(batch)).where(F.col("batch") == batch_id)
        announced.select(
            F.concat_ws(":", F.lit("calendar"), F.col("election_id").cast("string"), F.substring("content", 1, 12), F.col("record_id").cast("string")).alias("id"),
            F.lit("calendar_change").alias("type"),
            "election_id",
            F.col("released_at").alias("as_of"),
        ).write.mode("overwrite").parquet(os.path.join(events, f"batch={batch_id}"))

    return write


def run_available(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> None:
    """Drain what is there through ``foreachBatch`` and stop."""
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_until(stream: DataFrame, checkpoint: str, path: str, done: Callable[[], bool], seconds: float, every: str = "500 milliseconds") -> bool:
    """Run a stream by the clock into ``path``, one folder per batch id, until ``done`` or the time is up; whether it was done.

    For state with processing-time timers, which would keep a run over the available rows going for ever.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))

    query = (
        stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(processingTime=every).start()
    )
    end = time.monotonic() + seconds
    try:
        while time.monotonic() < end and query.exception() is None:
            if done():
                return True
            time.sleep(0.5)
    finally:
        query.stop()
    if query.exception() is not None:
        raise query.exception()
    return done()


def store_available(stream: DataFrame, checkpoint: str, path: str, mode: str = "append") -> None:
    """Drain a stream into parquet, one folder per batch id (idempotent), and stop."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))

    query = (
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
