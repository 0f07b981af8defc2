"""Poll aggregates, draw summaries and reporting aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fourclocks.bindings import CONTESTANTS, POLL_CUTOFF, Tables, ts
from fourclocks.operators import draws as draw_ops
from fourclocks.operators import polls as poll_ops
from fourclocks.registry import clock_text, day_text, query, rnd, with_ctes
from fourclocks.registry.ctes import DRAWS, POLLS, RESULTS

K = len(CONTESTANTS)

WEIGHTED = f"""
adjusted AS (
  SELECT election_id, poll_id, sample_size, available_at, fieldwork_end,
         greatest(sa - CASE WHEN sponsor = 'BUILDING' THEN 0.02 ELSE 0.0 END, 0.001) AS a,
         greatest(sn + CASE WHEN sponsor = 'BUILDING' THEN 0.02 ELSE 0.0 END, 0.001) AS n,
         greatest(sr, 0.001) AS r,
         exp(-ln(2) * greatest(0, DATE '{POLL_CUTOFF[:10]}' - fieldwork_end) / 21.0) AS decay,
         CASE mode WHEN 'live_phone' THEN 1.0 WHEN 'mixed' THEN 0.95 WHEN 'online' THEN 0.9 WHEN 'ivr' THEN 0.82 ELSE 0.85 END AS quality
  FROM polls WHERE available_at <= TIMESTAMP '{POLL_CUTOFF}' AND fieldwork_end <= DATE '{POLL_CUTOFF[:10]}'),
weighted AS (
  SELECT election_id, poll_id, sample_size, decay, sqrt(sample_size) * decay * quality AS w, u.c AS contestant_id, u.x AS x
  FROM (SELECT *, unnest([{{'c': 'A', 'x': a / (a + n + r)}}, {{'c': 'N', 'x': n / (a + n + r)}}, {{'c': 'R', 'x': r / (a + n + r)}}]) AS u
        FROM adjusted)),
means AS (SELECT election_id, contestant_id, sum(w * x) / sum(w) AS mu, count(*) AS n FROM weighted GROUP BY 1, 2)"""


@query("agg_poll_weighted_mean", with_ctes(
    "SELECT election_id, contestant_id, round(mu, 9) AS share, n AS poll_count FROM means", POLLS, WEIGHTED))
def _(t: Tables):
    out = poll_ops.aggregate_polls(t.polls, CONTESTANTS, ts(POLL_CUTOFF), house_effects=t.house_effects)
    return out.withColumn("share", rnd("share"))


@query("agg_poll_covariance", with_ctes("""
SELECT a.election_id, a.contestant_id AS row_id, b.contestant_id AS col_id,
       round(CASE WHEN ma.n > 1 THEN sum(a.w * (a.x - ma.mu) * (b.x - mb.mu)) / sum(a.w)
            WHEN a.contestant_id = b.contestant_id THEN max(ma.mu * (1 - ma.mu) / a.sample_size) ELSE 0 END
       + CASE WHEN a.contestant_id = b.contestant_id THEN 1e-6 ELSE 0 END, 9) AS covariance
FROM weighted a JOIN weighted b ON a.poll_id = b.poll_id
JOIN means ma ON ma.election_id = a.election_id AND ma.contestant_id = a.contestant_id
JOIN means mb ON mb.election_id = b.election_id AND mb.contestant_id = b.contestant_id
GROUP BY a.election_id, a.contestant_id, b.contestant_id, ma.n""", POLLS, WEIGHTED))
def _(t: Tables):
    out = poll_ops.poll_covariance(t.polls, CONTESTANTS, ts(POLL_CUTOFF), house_effects=t.house_effects)
    return out.withColumn("covariance", rnd("covariance"))


@query("agg_poll_effective_n", with_ctes(f"""
SELECT p.election_id, count(a.poll_id) AS poll_count, count(*) - count(a.poll_id) AS omitted,
       round(sum(a.sample_size * a.decay), 6) AS effective_n,
       strftime(max(a.available_at), '%Y-%m-%d %H:%M:%S') AS latest_available_at
FROM polls p LEFT JOIN adjusted a ON a.poll_id = p.poll_id GROUP BY 1""", POLLS, WEIGHTED))
def _(t: Tables):
    out = poll_ops.poll_effective_n(t.polls, K, ts(POLL_CUTOFF))
    return out.withColumns({
        "effective_n": rnd("effective_n", 6), "latest_available_at": clock_text("latest_available_at")})


@query("agg_window_mean_vector", with_ctes("""
SELECT election_id, CAST(window_end AS VARCHAR) AS window_end, count(*) AS poll_count, CAST(min(fieldwork_end) AS VARCHAR) AS observed_at,
       round(avg(sa) / (avg(sa) + avg(sn) + avg(sr)), 9) AS share_a, round(avg(sn) / (avg(sa) + avg(sn) + avg(sr)), 9) AS share_n,
       round(avg(sr) / (avg(sa) + avg(sn) + avg(sr)), 9) AS share_r
FROM polls JOIN (SELECT n_nationkey, unnest(generate_series(0, 11)) AS m FROM nation) ON n_nationkey = election_id
CROSS JOIN LATERAL (SELECT CAST(DATE '1998-01-31' + to_months(CAST(m AS INTEGER)) AS DATE) AS window_end)
WHERE fieldwork_end BETWEEN window_end - 3 AND window_end GROUP BY 1, 2""", POLLS))
def _(t: Tables):
    month = F.explode(F.sequence(F.lit(0), F.lit(11)))
    end = F.add_months(F.lit("1998-01-31").cast("date"), F.col("m"))
    windows = t.nation.select(F.col("n_nationkey").alias("election_id"), month.alias("m")).select(
        "election_id", F.date_sub(end, 3).alias("window_start"), end.alias("window_end"))
    out = poll_ops.window_mean(t.polls, windows, K)
    return out.select(
        "election_id", day_text("window_end").alias("window_end"), "poll_count", day_text("observed_at").alias("observed_at"),
        *[rnd(F.col("shares")[i]).alias(f"share_{c.lower()}") for i, c in enumerate(CONTESTANTS)])


@query("agg_top5_mean", with_ctes("""
SELECT election_id, count(*) AS poll_count, round(avg(sa) / (avg(sa) + avg(sn) + avg(sr)), 9) AS share_a,
       round(avg(sn) / (avg(sa) + avg(sn) + avg(sr)), 9) AS share_n, round(avg(sr) / (avg(sa) + avg(sn) + avg(sr)), 9) AS share_r
FROM (SELECT *, row_number() OVER (PARTITION BY election_id ORDER BY fieldwork_end DESC, poll_id DESC) AS rn
      FROM polls WHERE sa > 0 AND sn > 0 AND sr > 0) WHERE rn <= 5 GROUP BY 1""", POLLS))
def _(t: Tables):
    out = poll_ops.recent_mean(t.polls, K, 5)
    return out.select("election_id", "poll_count",
        *[rnd(F.col("shares")[i]).alias(f"share_{c.lower()}") for i, c in enumerate(CONTESTANTS)])


@query("agg_vector_pivot", with_ctes("""
SELECT poll_id, round(sa, 9) AS share_a, round(sn, 9) AS share_n, round(sr, 9) AS share_r FROM polls""", POLLS))
def _(t: Tables):
    out = poll_ops.to_vector(t.poll_results, ["poll_id"], CONTESTANTS).join(
        t.poll_headers.select("poll_id"), "poll_id", "left_semi")
    return out.select("poll_id",
        *[rnd(F.col("shares")[i]).alias(f"share_{c.lower()}") for i, c in enumerate(CONTESTANTS)])


SUMMARY = """
SELECT {keys}, contestant_id, count(*) AS draws, round(avg(CAST(is_win AS INTEGER)), 9) AS win_probability,
       round(avg(share), 9) AS projected_share, CAST(round_even(avg(seats), 0) AS INTEGER) AS projected_seats,
       round(quantile_cont(share, 0.05), 9) AS share_low, round(quantile_cont(share, 0.95), 9) AS share_high,
       CAST(round_even(quantile_cont(CAST(seats AS DOUBLE), 0.05), 0) AS INTEGER) AS seats_low,
       CAST(round_even(quantile_cont(CAST(seats AS DOUBLE), 0.95), 0) AS INTEGER) AS seats_high
FROM won GROUP BY {keys}, contestant_id"""


def _rounded(df):
    return df.withColumns({c: rnd(c) for c in ("win_probability", "projected_share", "share_low", "share_high")})


@query("agg_draw_summary", with_ctes(SUMMARY.format(keys="election_id"), DRAWS))
def _(t: Tables):
    return _rounded(draw_ops.summarise_draws(t.draws, ["election_id"], CONTESTANTS))


@query("agg_draw_conditional", with_ctes(SUMMARY.format(keys="election_id, scenario_id"), DRAWS))
def _(t: Tables):
    return _rounded(draw_ops.summarise_draws(t.draws, ["election_id", "scenario_id"], CONTESTANTS))


@query("agg_draw_missing", with_ctes("""
SELECT e.n_nationkey AS election_id, s.scenario_id FROM nation e CROSS JOIN (VALUES ('1-URGENT'), ('5-LOW'), ('none')) s(scenario_id)
WHERE NOT EXISTS (SELECT 1 FROM draws d WHERE d.election_id = e.n_nationkey AND d.scenario_id = s.scenario_id)""", DRAWS))
def _(t: Tables):
    declared = t.nation.select(F.col("n_nationkey").alias("election_id"), F.explode(F.array(F.lit("1-URGENT"), F.lit("5-LOW"), F.lit("none"))).alias("scenario_id"))
    return draw_ops.missing_scenarios(t.draws, declared, ["election_id", "scenario_id"])


@query("agg_draw_majority", with_ctes("""
SELECT election_id, count(*) AS draws, round(avg(CAST(top >= majority AS INTEGER)), 9) AS majority_probability,
       round(median(turnout), 9) AS turnout_median
FROM (SELECT run_id, election_id, max(seats) AS top, max(majority) AS majority, max(turnout) AS turnout FROM draws GROUP BY 1, 2)
GROUP BY 1""", DRAWS))
def _(t: Tables):
    out = draw_ops.majority_probability(t.draws, ["election_id"], K, "majority")
    return out.withColumns({c: rnd(c) for c in ("majority_probability", "turnout_median")})


@query("agg_coalition", with_ctes("""
SELECT election_id, coalition_key, round(avg(CAST(held >= majority AS INTEGER)), 9) AS majority_probability,
       CAST(round_even(quantile_cont(CAST(held AS DOUBLE), 0.05), 0) AS INTEGER) AS seats_low,
       CAST(round_even(quantile_cont(CAST(held AS DOUBLE), 0.5), 0) AS INTEGER) AS seats_median,
       CAST(round_even(quantile_cont(CAST(held AS DOUBLE), 0.95), 0) AS INTEGER) AS seats_high
FROM (SELECT d.run_id, d.election_id, s.key AS coalition_key, max(majority) AS majority, sum(seats) AS held
      FROM draws d JOIN (VALUES ('A+N', 'A'), ('A+N', 'N'), ('A+R', 'A'), ('A+R', 'R'), ('N+R', 'N'), ('N+R', 'R')) s(key, member)
        ON s.member = d.contestant_id GROUP BY 1, 2, 3)
GROUP BY 1, 2""", DRAWS))
def _(t: Tables):
    out = draw_ops.coalitions(t.draws, ["election_id"], CONTESTANTS, "majority")
    return out.withColumn("majority_probability", rnd("majority_probability"))


# reporting -----------------------------------------------------------------------------------

from fourclocks.bindings import EVENT_CUTOFF  # noqa: E402
from fourclocks.operators import asof, fundamentals, metrics, reporting  # noqa: E402
from fourclocks.registry.ctes import FEED, OBS, RUNS  # noqa: E402

# Features and the metrics that can feed them; no event of the last kind exists.
SPECS = {
    "engagement": ("click", "view"), "conversion": ("purchase",), "growth": ("signup",),
    "faults": ("error",), "returns": ("refund",),
}


def number(field):
    return F.get_json_object("props", field).cast("int")


@query("agg_security_events", """
SELECT CAST(user_id AS VARCHAR) AS country, count(*) AS events, count(*) FILTER (k % 5 IN (3, 4)) AS conflicts, CAST(sum(k) AS BIGINT) AS mentions,
       round(avg(value), 6) AS tone, round(avg(value - k), 6) AS score
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type <> 'signup') GROUP BY 1""")
def _(t: Tables):
    k = number("$.k")
    events = t.events.select(
        F.when(F.col("event_type") == "signup", " ").otherwise(F.col("user_id").cast("string")).alias("country"),
        (k % 5).alias("event_class"), k.alias("mentions"), F.col("value").alias("tone"), (F.col("value") - k).alias("score"))
    out = reporting.security_aggregates(events)
    return out.withColumns({"tone": rnd("tone", 6), "score": rnd("score", 6)})


HEALTH = """
SELECT {keys}, count(*) FILTER (status = 'failure') AS failures, round(epoch_us(max(occurred_at) FILTER (status = 'success')) / 1e6, 3) AS last_success
FROM runs GROUP BY {keys}"""


@query("agg_run_health", with_ctes(HEALTH.format(keys="job"), RUNS))
def _(t: Tables):
    return reporting.run_health(t.runs, ["job"]).withColumn("last_success", rnd("last_success", 3))


@query("agg_run_health_scoped", with_ctes(HEALTH.format(keys="job, scope"), RUNS))
def _(t: Tables):
    return reporting.run_health(t.runs, ["job", "scope"]).withColumn("last_success", rnd("last_success", 3))


@query("agg_catalog_status", """
SELECT count(*) AS jurisdictions, count(*) FILTER (c_acctbal > 0) AS forecast, count(*) FILTER (c_acctbal <= 0 AND c_mktsegment = 'BUILDING') AS calendar_only,
       count(*) FILTER (c_acctbal <= 0 AND c_mktsegment <> 'BUILDING') AS mechanics_blocked FROM customer""")
def _(t: Tables):
    status = F.when(F.col("c_acctbal") > 0, "forecast").when(F.col("c_mktsegment") == "BUILDING", "calendar_only").otherwise("mechanics_blocked")
    return reporting.catalog_status(t.customer.select(status.alias("coverage_status")))


EARLY = "2024-01-02 00:00:00"


@query("agg_completeness", with_ctes(f"""
SELECT jurisdiction_id, CAST(4 - len(list_filter(gaps, lambda x: x <> '')) + 0 AS INTEGER) AS present, 5 AS required, round((4 - len(list_filter(gaps, lambda x: x <> ''))) / 5.0, 9) AS completeness,
       array_to_string(list_sort(list_append(list_filter(gaps, lambda x: x <> ''), 'returns')), ',') AS missing
FROM (SELECT jurisdiction_id, [CASE WHEN count(*) FILTER (metric IN ('click', 'view')) = 0 THEN 'engagement' ELSE '' END,
        CASE WHEN count(*) FILTER (metric = 'purchase') = 0 THEN 'conversion' ELSE '' END, CASE WHEN count(*) FILTER (metric = 'signup') = 0 THEN 'growth' ELSE '' END,
        CASE WHEN count(*) FILTER (metric = 'error') = 0 THEN 'faults' ELSE '' END] AS gaps
      FROM observations WHERE available_at <= TIMESTAMP '{EARLY}' AND observed_at <= TIMESTAMP '{EARLY}' GROUP BY 1)""", OBS))
def _(t: Tables):
    seen = asof.asof_filter(t.observations, ts(EARLY), ["available_at", "observed_at"])
    out = reporting.completeness(seen, ["jurisdiction_id"], SPECS)
    return out.withColumns({"completeness": rnd("completeness"), "missing": F.array_join("missing", ",")})


@query("agg_nested_collect", """
SELECT c_nationkey AS nation, string_agg(seg || '=' || n, ',' ORDER BY seg) AS segments
FROM (SELECT c_nationkey, c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1""")
def _(t: Tables):
    counts = t.customer.groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    nested = asof.nest(counts, ["nation"], ["segment", "n"], "segments")
    text = F.transform("segments", lambda s: F.concat_ws("=", s["segment"], s["n"].cast("string")))
    return nested.select("nation", F.array_join(text, ",").alias("segments"))


@query("agg_provenance_distinct", """
SELECT lang, source, content, f AS first_seen, CAST(row_number() OVER (PARTITION BY lang ORDER BY f, source, content) AS INTEGER) AS position
FROM (SELECT lang, source, sha256(text) AS content, min(doc_id) AS f FROM documents GROUP BY 1, 2, 3)""")
def _(t: Tables):
    docs = t.documents.select("lang", "source", F.sha2("text", 256).alias("content"), "doc_id")
    return reporting.provenance(docs, ["lang"], ["source", "content"], "doc_id", F.floor(F.col("first_seen") / 1000))


@query("agg_status_rollup", with_ctes("""
SELECT unit_id, contestant_id, CASE WHEN bool_and(votes < 300) THEN 'certified' ELSE 'live' END AS status, max(k) / 100.0 AS reporting_fraction,
       strftime(max(reported_at), '%Y-%m-%d %H:%M:%S') AS reported_at, string_agg(DISTINCT 'v' || (k % 3), '+' ORDER BY 'v' || (k % 3)) AS parser_version
FROM feed GROUP BY 1, 2""", FEED))
def _(t: Tables):
    rows = t.feed.select("unit_id", "contestant_id", (F.col("votes") < 300).alias("is_certified"), (F.col("k") / 100.0).alias("reporting_fraction"),
        "reported_at", F.concat(F.lit("v"), (F.col("k") % 3).cast("string")).alias("parser_version"))
    out = reporting.status_rollup(rows, ["unit_id", "contestant_id"])
    return out.withColumn("reported_at", clock_text("reported_at"))


BOUNDS = (5.0, 10.0, 25.0, 50.0, 100.0, 150.0, 200.0, 300.0)


@query("agg_latency_histogram", "SELECT event_type, b.le, count(*) FILTER (value <= b.v) AS hits, count(*) AS total, round(sum(value), 2) AS total_seconds\nFROM events CROSS JOIN (VALUES "
       + ", ".join(f"('{b}', {b})" for b in BOUNDS) + ", ('+Inf', 1e300)) b(le, v) GROUP BY 1, 2")
def _(t: Tables):
    out = reporting.latency_histogram(t.events, ["event_type"], "value", BOUNDS)
    return out.withColumn("total_seconds", rnd("total_seconds", 2))


@query("agg_latency_p95", """
SELECT event_type, value AS p95 FROM (SELECT event_type, value, row_number() OVER w AS rn, count(*) OVER (PARTITION BY event_type) AS n
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)) WHERE rn = greatest(CAST(floor(0.95 * n) AS BIGINT) - 1, 0) + 1""")
def _(t: Tables):
    return reporting.latency_p95(t.events, ["event_type"], "value", 0.05)


@query("agg_freshness", """
SELECT user_id, greatest(round(epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(max(ts)), 3), 0.0) AS age_seconds FROM events GROUP BY 1""")
def _(t: Tables):
    out = reporting.freshness(t.events, ["user_id"], "ts", ts("2024-01-30 12:00:00"))
    return out.withColumn("age_seconds", rnd("age_seconds", 3))


@query("agg_batch_counts", "SELECT source, count(*) AS records, count(DISTINCT text) AS inserted FROM documents GROUP BY 1")
def _(t: Tables):
    docs = t.documents.select("source", F.sha2("text", 256).alias("content"))
    return reporting.batch_counts(docs, ["source"], "content")


# clusters and fundamentals ---------------------------------------------------------------------


@query("agg_cluster_mean", with_ctes("""
SELECT mode, round(avg(m), 9) AS sa, count(*) AS clusters FROM (SELECT mode, election_id, avg(sa) AS m FROM polls GROUP BY 1, 2) GROUP BY 1""", POLLS))
def _(t: Tables):
    out = metrics.clustered_average(t.polls.withColumn("sa", F.col("shares")[0]), ["mode"], "election_id", ["sa"])
    return out.withColumn("sa", rnd("sa"))


RESAMPLED = """
numbered AS (SELECT {key}, v, row_number() OVER (PARTITION BY {key} ORDER BY {cluster}) - 1 AS slot, count(*) OVER (PARTITION BY {key}) AS n FROM clusters),
picks AS (
  SELECT {key}, rep, CAST('0x' || substr(md5(rep || ':' || slot), 1, 8) AS BIGINT) % n AS pick
  FROM numbered CROSS JOIN range({resamples}) r(rep)),
means AS (SELECT p.{key}, rep, avg(v) AS m FROM picks p JOIN numbered x ON x.{key} = p.{key} AND x.slot = p.pick GROUP BY 1, 2)"""


@query("agg_bootstrap_ci", with_ctes("""
SELECT mode, round(quantile_cont(m, 0.05), 9) AS ci_low, round(quantile_cont(m, 0.95), 9) AS ci_high FROM means GROUP BY 1""",
    POLLS, "clusters AS (SELECT mode, election_id, avg(sa) AS v FROM polls GROUP BY 1, 2)",
    RESAMPLED.format(key="mode", cluster="election_id", resamples=5000)))
def _(t: Tables):
    out = metrics.bootstrap_ci(t.polls.withColumn("sa", F.col("shares")[0]), ["mode"], "election_id", "sa", 5000)
    return out.withColumns({"ci_low": rnd("ci_low"), "ci_high": rnd("ci_high")})


@query("agg_paired_bootstrap", with_ctes("""
SELECT mode, round(quantile_cont(m, 0.95), 9) AS upper, quantile_cont(m, 0.95) < 0 AS superior FROM means GROUP BY 1""",
    POLLS, "clusters AS (SELECT mode, election_id, avg(sa - sr) AS v FROM polls GROUP BY 1, 2)",
    RESAMPLED.format(key="mode", cluster="election_id", resamples=10000)))
def _(t: Tables):
    pairs = t.polls.withColumns({"sa": F.col("shares")[0], "sr": F.col("shares")[2]})
    out = metrics.paired_superiority(pairs, ["mode"], "election_id", "sa", "sr", 10000)
    return out.withColumn("upper", rnd("upper"))


def fundamental_rows(t: Tables):
    """Customers as past elections: two features, a share target, segment and nation labels."""
    per_customer = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").cast("double").alias("orders"), F.avg(F.col("o_totalprice")).alias("price"),
        F.max("o_orderdate").cast("date").alias("election_date"))
    return t.customer.join(per_customer, "c_custkey").select(
        F.col("c_custkey").alias("election_id"), F.col("c_mktsegment").alias("archetype"), F.col("c_nationkey").alias("jurisdiction_id"),
        "orders", "price", "election_date", F.date_add("election_date", 14).cast("timestamp").alias("available_at"),
        ((F.col("c_acctbal") + 1500.0) / 13000.0).alias("actual_share"))


FUND = """
fund AS (
  SELECT c_custkey AS election_id, c_mktsegment AS archetype, c_nationkey AS jurisdiction_id, o.orders, o.price, o.day AS election_date,
         (c_acctbal + 1500.0) / 13000.0 AS actual_share
  FROM customer JOIN (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS orders, avg(o_totalprice) AS price, CAST(max(o_orderdate) AS DATE) AS day FROM orders GROUP BY 1) o
    ON o_custkey = c_custkey),
train AS (
  SELECT *, ln(least(greatest(actual_share, 0.01), 0.99) / (1 - least(greatest(actual_share, 0.01), 0.99))) AS y
  FROM fund WHERE election_date + 14 <= DATE '2001-06-30' AND election_date < DATE '2001-06-30'),
scale AS (SELECT count(*) AS n, avg(orders) AS m1, stddev_pop(orders) AS s1, avg(price) AS m2, stddev_pop(price) AS s2 FROM train),
z AS (SELECT train.*, (orders - m1) / s1 AS z1, (price - m2) / s2 AS z2 FROM train, scale)"""
FUND_CUTOFF = "2001-06-30 00:00:00"
FEATURES = ["orders", "price"]


@query("agg_feature_standardise", with_ctes("SELECT election_id, round(z1, 6) AS orders, round(z2, 6) AS price FROM z", FUND))
def _(t: Tables):
    train = fundamentals.training_rows(fundamental_rows(t), ts(FUND_CUTOFF))
    z = fundamentals.standardised(train, FEATURES, fundamentals.feature_scale(train, FEATURES))
    return z.select("election_id", rnd("orders", 6).alias("orders"), rnd("price", 6).alias("price"))


@query("agg_ridge_gram", with_ctes("""
SELECT CAST(count(*) AS DOUBLE) AS g0_0, round(sum(z1), 4) + 0.0 AS g0_1, round(sum(z2), 4) + 0.0 AS g0_2, round(sum(z1 * z1), 4) AS g1_1, round(sum(z1 * z2), 4) AS g1_2,
       round(sum(z2 * z2), 4) AS g2_2, round(sum(y), 4) AS b0, round(sum(z1 * y), 4) AS b1, round(sum(z2 * y), 4) AS b2 FROM z""", FUND))
def _(t: Tables):
    from fourclocks.functions.shares import logit

    train = fundamentals.training_rows(fundamental_rows(t), ts(FUND_CUTOFF)).withColumn("y", logit(F.col("actual_share")))
    z = fundamentals.standardised(train, FEATURES, fundamentals.feature_scale(train, FEATURES))
    sums = fundamentals.gram_sums(z, FEATURES, "y")
    return sums.select(*[(rnd(c, 4) + 0.0).alias(c) for c in sums.columns])


@query("agg_pooled_offsets", with_ctes("""
SELECT archetype, round((avg(y) - 0.1) * count(*) / (count(*) + 5.0), 9) AS "offset", count(*) AS n FROM train GROUP BY 1""", FUND))
def _(t: Tables):
    from fourclocks.functions.shares import logit

    train = fundamentals.training_rows(fundamental_rows(t), ts(FUND_CUTOFF))
    out = fundamentals.pooled_offsets(train.withColumn("r", logit(F.col("actual_share")) - 0.1), "archetype", "r")
    return out.withColumn("offset", rnd("offset"))


SOLVED = """
gram AS (SELECT count(*) AS a, sum(z1) AS b, sum(z2) AS c, sum(z1 * z1) + 4 AS d, sum(z1 * z2) AS e, sum(z2 * z2) + 4 AS f,
         sum(y) AS p, sum(z1 * y) AS q, sum(z2 * y) AS r FROM z),
det AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS dt FROM gram),
beta AS (SELECT (p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / dt AS b0,
                (a * (q * f - e * r) - p * (b * f - e * c) + c * (b * r - q * c)) / dt AS b1,
                (a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c)) / dt AS b2 FROM det),
res AS (SELECT z.*, y - (b0 + b1 * z1 + b2 * z2) AS r0 FROM z, beta),
arch AS (SELECT archetype, avg(r0) * count(*) / (count(*) + 5) AS o1 FROM res GROUP BY 1),
res1 AS (SELECT res.*, r0 - o1 AS r1 FROM res JOIN arch USING (archetype)),
juri AS (SELECT jurisdiction_id, avg(r1) * count(*) / (count(*) + 5) AS o2 FROM res1 GROUP BY 1),
spread AS (SELECT greatest(0.08, stddev_samp(r1 - o2)) AS sd FROM res1 JOIN juri USING (jurisdiction_id))"""


@query("agg_ridge_fit", with_ctes("""
SELECT archetype, round(o1, 6) AS archetype_offset, round(b0, 6) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2, round(sd, 6) AS residual_std, CAST(n AS INTEGER) AS training_count
FROM arch, beta, spread, scale""", FUND, SOLVED))
def _(t: Tables):
    model = fundamentals.fit_ridge(fundamental_rows(t), FEATURES, ts(FUND_CUTOFF))
    return model.archetype_offsets.select(
        "archetype", rnd("archetype_offset", 6).alias("archetype_offset"),
        *[rnd(F.lit(b), 6).alias(f"b{i}") for i, b in enumerate(model.coefficients)],
        rnd(F.lit(model.residual_std), 6).alias("residual_std"), F.lit(model.training_count).alias("training_count"))


@query("agg_ridge_predict", with_ctes("""
SELECT election_id, round(1 / (1 + exp(-x)), 6) AS share, round(1 / (1 + exp(-(x - 1.645 * s))), 6) AS low, round(1 / (1 + exp(-(x + 1.645 * s))), 6) AS high,
       round(s, 6) AS posterior_std, CAST(n AS INTEGER) AS training_count, o1 IS NULL AS unseen_archetype, o2 IS NULL AS unseen_jurisdiction
FROM (SELECT election_id, n, o1, o2, b0 + b1 * (orders - m1) / s1 + b2 * (price - m2) / s2 + coalesce(o1, 0) + coalesce(o2, 0) AS x,
             sd * (1 + CASE WHEN o1 IS NULL THEN 0.2 ELSE 0 END + CASE WHEN o2 IS NULL THEN 0.15 ELSE 0 END) AS s
      FROM fund LEFT JOIN arch USING (archetype) LEFT JOIN juri USING (jurisdiction_id), beta, spread, scale)""", FUND, SOLVED))
def _(t: Tables):
    rows = fundamental_rows(t)
    model = fundamentals.fit_ridge(rows, FEATURES, ts(FUND_CUTOFF))
    out = fundamentals.predict_fundamentals(model, rows)
    return out.select("election_id", *[rnd(c, 6).alias(c) for c in ("share", "low", "high", "posterior_std")], "training_count", "unseen_archetype", "unseen_jurisdiction")
