"""Election history: origins, training sets, fits, predictions, scores and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fourclocks.bindings import CONTESTANTS, Tables
from fourclocks.operators import asof, metrics
from fourclocks.plans import walk_forward as wf
from fourclocks.functions.shares import horizon_tolerance
from fourclocks.registry import day_text, query, rnd, with_ctes
from fourclocks.session import cut_lineage

K = len(CONTESTANTS)
HORIZONS = (28, 14, 7)


def each(pattern: str) -> str:
    """The pattern once per contestant position, {i} replaced."""
    return ", ".join(pattern.replace("{i}", str(i)) for i in range(K))


def plus(pattern: str) -> str:
    return "(" + " + ".join(pattern.replace("{i}", str(i)) for i in range(K)) + ")"


HIST = f"""
daily AS (
  SELECT CAST(o_orderdate AS DATE) AS day, sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END) AS v0,
         sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END) AS v1, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS v2
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
qsum AS (SELECT CAST(date_trunc('quarter', day) AS DATE) AS qs, {each('sum(v{i}) AS v{i}')} FROM daily GROUP BY 1),
el AS (
  SELECT * FROM (
    SELECT qs, CAST(qs + INTERVAL 3 MONTH AS DATE) - 1 AS ed, year(qs) || 'Q' || quarter(qs) AS eid, {each('v{i} / (v0 + v1 + v2) AS a{i}')},
           {each('lag(v{i} / (v0 + v1 + v2)) OVER (ORDER BY qs) AS f{i}')}, lag(qs) OVER (ORDER BY qs) AS pqs FROM qsum) WHERE f0 IS NOT NULL),
wsum AS (
  SELECT qs, CAST(floor((day - CAST(date_trunc('quarter', day) AS DATE)) / 7) AS INTEGER) AS wk, {each('sum(v{i}) AS v{i}')}
  FROM (SELECT *, CAST(date_trunc('quarter', day) AS DATE) AS qs FROM daily) GROUP BY 1, 2),
snap AS (
  SELECT eid, ed, least(wsum.qs + wk * 7 + 6, ed) AS wd, {each('v{i} / (v0 + v1 + v2) AS s{i}')} FROM wsum JOIN el ON el.qs = wsum.qs),
org AS (SELECT el.*, h, ed - h AS cut_at, ed + 14 AS rav, CAST(pqs + INTERVAL 3 MONTH AS DATE) - 1 + 14 AS fav FROM el CROSS JOIN (VALUES (28), (14), (7)) t(h)),
seen AS (SELECT o.eid, o.cut_at, o.ed, wd, {each('s{i}')}, row_number() OVER (PARTITION BY o.eid, o.cut_at ORDER BY wd DESC) AS rn
         FROM org o JOIN snap ON snap.eid = o.eid AND wd <= cut_at),
rec AS (
  SELECT o.*, {each('l.s{i} AS p{i}')}, {each('p.s{i} AS q{i}')}, c.n AS snapshots
  FROM org o JOIN seen l ON l.eid = o.eid AND l.cut_at = o.cut_at AND l.rn = 1 JOIN seen p ON p.eid = o.eid AND p.cut_at = o.cut_at AND p.rn = 2
  JOIN (SELECT eid, cut_at, count(*) AS n FROM seen GROUP BY 1, 2) c ON c.eid = o.eid AND c.cut_at = o.cut_at),
long_seen AS (
  SELECT eid, cut_at, wd, i, CASE i WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS s FROM seen CROSS JOIN (VALUES (0), (1), (2)) t(i)),
mv AS (
  SELECT *, lag(st) OVER (PARTITION BY eid, cut_at, i ORDER BY wd) AS pst FROM (
    SELECT eid, cut_at, wd, i, ch, CASE WHEN ch < -0.003 THEN 0 WHEN ch > 0.003 THEN 2 ELSE 1 END AS st FROM (
      SELECT *, s - lag(s) OVER (PARTITION BY eid, cut_at, i ORDER BY wd) AS ch FROM long_seen) WHERE ch IS NOT NULL)),
uni AS (SELECT * FROM mv WHERE (eid, cut_at) IN (SELECT (eid, max(cut_at)) FROM org GROUP BY eid))"""

FOLDS = """
near AS (
  SELECT te, ta, td, eid, cut_at, h, th FROM (
    SELECT t.eid AS te, t.cut_at AS ta, t.ed AS td, t.h AS th, r.eid, r.cut_at, r.h,
           row_number() OVER (PARTITION BY t.eid, t.cut_at, r.eid ORDER BY abs(r.h - t.h), r.cut_at DESC) AS rn
    FROM rec t JOIN rec r ON r.ed < t.ed AND r.rav <= t.cut_at)
  WHERE rn = 1 AND abs(h - th) <= greatest(2, least(30, ceil(th * 0.1)))),
train AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY te, ta) AS n FROM near) WHERE n >= 5),
fr AS (
  SELECT te, ta, eid, cut_at, FALSE AS is_test FROM train UNION ALL SELECT DISTINCT te, ta, te, ta, TRUE FROM train),
frr AS (SELECT fr.te, fr.ta, fr.is_test, r.* FROM fr JOIN rec r ON r.eid = fr.eid AND r.cut_at = fr.cut_at),
pr AS (SELECT x.te, x.ta, x.eid AS xe, y.eid AS ye, y.cut_at AS yasof FROM frr x JOIN frr y ON x.te = y.te AND x.ta = y.ta AND y.ed < x.ed)"""

NUM = plus("(p{i} - f{i}) * (a{i} - f{i})")
DEN = plus("(p{i} - f{i}) * (p{i} - f{i})")


def normal(prefix: str) -> list[str]:
    parts = [f"greatest({prefix}{i}, 0.001)" for i in range(K)]
    return [f"{p} / ({' + '.join(parts)})" for p in parts]


FITS = f"""
wfit AS (
  SELECT te, ta, xe, CASE WHEN sum({DEN}) > 1e-12 THEN least(greatest(sum({NUM}) / sum({DEN}), 0.0), 1.0) ELSE 0.5 END AS w
  FROM pr JOIN rec ON rec.eid = ye AND rec.cut_at = yasof GROUP BY 1, 2, 3),
frw AS (SELECT frr.*, coalesce(w, 0.5) AS w FROM frr LEFT JOIN wfit ON wfit.te = frr.te AND wfit.ta = frr.ta AND xe = frr.eid),
mixes AS (
  SELECT pr.te, pr.ta, pr.xe, {each('rec.a{i} AS a{i}')}, {each('w * rec.p{i} + (1 - w) * rec.f{i} AS m{i}')}
  FROM pr JOIN frw x ON x.te = pr.te AND x.ta = pr.ta AND x.eid = pr.xe JOIN rec ON rec.eid = ye AND rec.cut_at = yasof),
biases AS (SELECT te, ta, xe, {', '.join(f'avg(a{i} - {n}) AS b{i}' for i, n in enumerate(normal('m')))} FROM mixes GROUP BY 1, 2, 3),
tcount AS (
  SELECT pr.te, pr.ta, pr.xe, pst, sum(CAST(st = 2 AS INTEGER)) - sum(CAST(st = 0 AS INTEGER)) AS net, count(*) AS n
  FROM pr JOIN mv ON mv.eid = ye AND mv.cut_at = yasof WHERE pst IS NOT NULL GROUP BY 1, 2, 3, 4),
stepfit AS (SELECT pr.te, pr.ta, pr.xe, median(abs(ch)) AS step FROM pr JOIN mv ON mv.eid = ye AND mv.cut_at = yasof GROUP BY 1, 2, 3),
drift AS (
  SELECT f.te, f.ta, f.eid, i.i, coalesce(net, 0) / (coalesce(t.n, 0) + 3.0) AS ex
  FROM frr f CROSS JOIN (VALUES (0), (1), (2)) i(i)
  JOIN (SELECT eid, cut_at, {each('CASE WHEN p{i} - q{i} < -0.003 THEN 0 WHEN p{i} - q{i} > 0.003 THEN 2 ELSE 1 END AS st{i}')} FROM rec) s ON s.eid = f.eid AND s.cut_at = f.cut_at
  LEFT JOIN tcount t ON t.te = f.te AND t.ta = f.ta AND t.xe = f.eid AND t.pst = CASE i.i WHEN 0 THEN st0 WHEN 1 THEN st1 ELSE st2 END),
drifts AS (SELECT te, ta, eid, {each('max(CASE WHEN i = {i} THEN ex END) AS x{i}')} FROM drift GROUP BY 1, 2, 3),
bases AS (SELECT *, {each('w * p{i} + (1 - w) * f{i} AS m{i}')} FROM frw),
based AS (SELECT *, {', '.join(f'{n} AS base{i}' for i, n in enumerate(normal('m')))} FROM bases),
shifted AS (
  SELECT b.*, coalesce(step, 0.01) AS step, {each('base{i} + coalesce(b{i}, 0) AS g{i}')}, {each('coalesce(b{i}, 0) AS bias{i}')},
         {each('base{i} + coalesce(b{i}, 0) + (x{i} - (x0 + x1 + x2) / 3) * coalesce(step, 0.01) * 0.5 AS k{i}')},
         {each('lag(a{i}) OVER (PARTITION BY b.te, b.ta ORDER BY ed) AS prev{i}')}
  FROM based b LEFT JOIN biases ON biases.te = b.te AND biases.ta = b.ta AND biases.xe = b.eid
  LEFT JOIN stepfit s ON s.te = b.te AND s.ta = b.ta AND s.xe = b.eid JOIN drifts d ON d.te = b.te AND d.ta = b.ta AND d.eid = b.eid),
pred AS (
  SELECT te, ta, eid, ed, is_test, {each('a{i}')}, 'gaussian_monte_carlo' AS family, {', '.join(f'{n} AS m{i}' for i, n in enumerate(normal('g')))} FROM shifted
  UNION ALL SELECT te, ta, eid, ed, is_test, {each('a{i}')}, 'markov_momentum', {', '.join(normal('k'))} FROM shifted
  UNION ALL SELECT te, ta, eid, ed, is_test, {each('a{i}')}, 'baseline_ensemble', {each('base{i}')} FROM shifted
  UNION ALL SELECT te, ta, eid, ed, is_test, {each('a{i}')}, 'polls_only', {', '.join(normal('p'))} FROM shifted
  UNION ALL SELECT te, ta, eid, ed, is_test, {each('a{i}')}, 'fundamentals_only', {', '.join(normal('f'))} FROM shifted
  UNION ALL SELECT te, ta, eid, ed, is_test, {each('a{i}')}, 'previous_election', {', '.join(normal('prev'))} FROM shifted WHERE prev0 IS NOT NULL),
resid AS (
  SELECT te, ta, family, eid, ed, {each('(a{i} - m{i}) - ((a0 - m0) + (a1 - m1) + (a2 - m2)) / 3 AS r{i}')} FROM pred WHERE NOT is_test)"""

SCORES = f"""
shock AS (SELECT te, ta, family, {each('r{i} - avg(r{i}) OVER (PARTITION BY te, ta, family) AS z{i}')} FROM resid),
raws AS (
  SELECT p.te, p.ta, p.ed, p.family, {each('p.a{i} AS a{i}')},
         {each("p.m{i} + CASE WHEN p.family = 'baseline_ensemble' THEN 0.60 / 0.45 ELSE 1.0 END * coalesce(z{i}, 0) AS u{i}")}
  FROM pred p LEFT JOIN shock s ON s.te = p.te AND s.ta = p.ta AND s.family = CASE p.family WHEN 'baseline_ensemble' THEN 'gaussian_monte_carlo' ELSE p.family END
  WHERE p.is_test),
drawn AS (SELECT te, ta, ed, family, {each('a{i}')}, {', '.join(f'{n} AS x{i}' for i, n in enumerate(normal('u')))} FROM raws),
fc AS (
  SELECT te, ta, ed, family, i, avg(CASE i WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END) AS predicted,
         avg(CAST(i = CASE WHEN x0 >= x1 AND x0 >= x2 THEN 0 WHEN x1 >= x2 THEN 1 ELSE 2 END AS INTEGER)) AS probability,
         quantile_cont(CASE i WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END, 0.05) AS low, quantile_cont(CASE i WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END, 0.95) AS high,
         max(CASE i WHEN 0 THEN a0 WHEN 1 THEN a1 ELSE a2 END) AS actual
  FROM drawn CROSS JOIN (VALUES (0), (1), (2)) t(i) GROUP BY 1, 2, 3, 4, 5),
marked AS (SELECT *, CAST(row_number() OVER (PARTITION BY te, ta, family ORDER BY actual DESC, i) = 1 AS INTEGER) AS won FROM fc),
fold AS (
  SELECT te, ta, ed, family, sum((probability - won) ** 2) AS brier, sqrt(avg((predicted - actual) ** 2)) AS rmse,
         avg(CAST(actual BETWEEN low AND high AS INTEGER)) AS coverage FROM marked GROUP BY 1, 2, 3, 4)"""

BINS = ", ".join(f"({i}, {low!r}, {2.0 if i == 9 else high!r})" for i, (low, high) in enumerate(metrics.CALIBRATION_BINS))
CALIBRATION = f"""
binned AS (
  SELECT family, te, b.k, count(*) AS n, avg(probability) AS p, avg(won) AS y FROM marked
  JOIN (VALUES {BINS}) b(k, lo, hi) ON probability >= lo AND probability < hi GROUP BY 1, 2, 3),
calibration AS (SELECT family, avg(e) AS calibration_error FROM (SELECT family, te, sum(n * abs(p - y)) / sum(n) AS e FROM binned GROUP BY 1, 2) GROUP BY 1)"""


def records(t: Tables):
    return cut_lineage(wf.history(t.daily_amounts, CONTESTANTS, HORIZONS))


def pieces(t: Tables):
    """(elections, snapshots seen per origin) on the checkpointed daily sums."""
    daily = cut_lineage(t.daily_amounts)
    elections = wf.quarter_elections(daily, CONTESTANTS)
    origins = asof.origin_grid(elections, HORIZONS).drop("offset_days", "snapshot_date")
    return origins, wf.origin_snapshots(origins, wf.weekly_snapshots(daily, elections, CONTESTANTS))


def vector(column: str, name: str):
    return [rnd(F.col(column)[i]).alias(f"{name}{i}") for i in range(K)]


@query("job_origin_builder", with_ctes(f"""
SELECT eid AS election_id, CAST(cut_at AS VARCHAR) AS forecast_as_of, CAST(rav AS VARCHAR) AS result_available_at, CAST(fav AS VARCHAR) AS fundamentals_available_at,
       snapshots AS snapshot_count, {each('round(a{i}, 9) AS a{i}')}, {each('round(f{i}, 9) AS f{i}')}, {each('round(p{i}, 9) AS p{i}')}, {each('round(q{i}, 9) AS q{i}')} FROM rec""", HIST))
def _(t: Tables):
    r = wf.history(t.daily_amounts, CONTESTANTS, HORIZONS)
    return r.select(
        "election_id", *[day_text(c).alias(c) for c in ("forecast_as_of", "result_available_at", "fundamentals_available_at")], "snapshot_count",
        *vector("actual", "a"), *vector("fundamentals", "f"), *vector("last_poll", "p"), *vector("prev_poll", "q"))


@query("join_cross_grid", with_ctes("""
SELECT eid AS election_id, h AS horizon_days, off AS offset_days, CAST(cut_at AS VARCHAR) AS forecast_as_of, CAST(cut_at - off AS VARCHAR) AS snapshot_date
FROM org CROSS JOIN (VALUES (0), (7)) o(off)""", HIST))
def _(t: Tables):
    elections = wf.quarter_elections(t.daily_amounts, CONTESTANTS)
    grid = asof.origin_grid(elections, HORIZONS, (0, 7))
    return grid.select("election_id", "horizon_days", "offset_days", day_text("forecast_as_of").alias("forecast_as_of"), day_text("snapshot_date").alias("snapshot_date"))


def in_nations(text: str) -> str:
    """The history's SQL with a series for each nation: every partition and join that is by quarter is by nation too, and an
    election's id begins with its nation."""
    swaps = (
        ("SELECT CAST(o_orderdate AS DATE) AS day", "SELECT c_nationkey AS sid, CAST(o_orderdate AS DATE) AS day"),
        ("FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)", "FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"),
        ("qsum AS (SELECT CAST", "qsum AS (SELECT sid, CAST"),
        ("FROM daily GROUP BY 1)", "FROM daily GROUP BY 1, 2)"),
        ("SELECT qs, CAST(qs + INTERVAL", "SELECT sid, qs, CAST(qs + INTERVAL"),
        ("year(qs) || 'Q'", "sid || ':' || year(qs) || 'Q'"),
        ("OVER (ORDER BY qs)", "OVER (PARTITION BY sid ORDER BY qs)"),
        ("SELECT qs, CAST(floor(", "SELECT sid, qs, CAST(floor("),
        ("AS qs FROM daily) GROUP BY 1, 2)", "AS qs FROM daily) GROUP BY 1, 2, 3)"),
        ("JOIN el ON el.qs = wsum.qs", "JOIN el ON el.sid = wsum.sid AND el.qs = wsum.qs"),
        ("ON r.ed < t.ed", "ON r.sid = t.sid AND r.ed < t.ed"),
    )
    for old, new in swaps:
        text = text.replace(old, new)
    return text


HIST_N, NEAR_N = in_nations(HIST), in_nations(FOLDS)


def nation_records(t: Tables):
    return cut_lineage(wf.history(t.daily_amounts_by_nation, CONTESTANTS, HORIZONS))


def split_id(column: str) -> str:
    return f"split_part({column}, ':', 1) AS series_id, split_part({column}, ':', 2)"


@query("join_horizon_bands", with_ctes(f"""
SELECT {split_id('eid')} AS election_id, th AS band, CAST(cut_at AS VARCHAR) AS forecast_as_of, CAST(abs(h - th) AS INTEGER) AS horizon_gap,
       row_number() OVER (PARTITION BY sid, th ORDER BY ed) AS position
FROM (SELECT r.*, th, row_number() OVER (PARTITION BY r.eid, th ORDER BY abs(h - th), cut_at DESC) AS rn
      FROM rec r JOIN (SELECT DISTINCT sid, h AS th FROM rec) b ON b.sid = r.sid)
WHERE rn = 1 AND abs(h - th) <= greatest(2, least(30, ceil(th * 0.1)))""", HIST_N))
def _(t: Tables):
    out = wf.horizon_bands(nation_records(t))
    return out.select("series_id", "election_id", "band", day_text("forecast_as_of").alias("forecast_as_of"), "horizon_gap", "position")


@query("join_fold_prefix", with_ctes(f"""
SELECT {split_id('te')} AS test_election_id, CAST(ta AS VARCHAR) AS test_as_of, count(*) AS upto FROM near GROUP BY te, ta""", HIST_N, NEAR_N))
def _(t: Tables):
    r = nation_records(t)
    marks = wf.fold_marks(r, wf.horizon_bands(r))
    return marks.select("series_id", *test_keys(), "upto")


@query("join_walk_forward", with_ctes("""
SELECT t.eid AS test_election_id, CAST(t.cut_at AS VARCHAR) AS test_as_of, r.eid AS election_id, CAST(r.cut_at AS VARCHAR) AS forecast_as_of
FROM rec t JOIN rec r ON r.ed < t.ed AND r.rav <= t.cut_at""", HIST))
def _(t: Tables):
    pairs = asof.walk_forward_pairs(records(t))
    return pairs.select("test_election_id", day_text("test_as_of").alias("test_as_of"), "election_id", day_text("forecast_as_of").alias("forecast_as_of"))


@query("join_nearest_horizon", with_ctes("""
SELECT te AS test_election_id, CAST(ta AS VARCHAR) AS test_as_of, eid AS election_id, CAST(cut_at AS VARCHAR) AS forecast_as_of, CAST(abs(h - th) AS INTEGER) AS horizon_gap FROM near""", HIST, FOLDS))
def _(t: Tables):
    near = asof.nearest_origin(asof.walk_forward_pairs(records(t)), horizon_tolerance)
    return near.select("test_election_id", day_text("test_as_of").alias("test_as_of"), "election_id", day_text("forecast_as_of").alias("forecast_as_of"), "horizon_gap")


@query("win_collapse_origins", with_ctes("""
SELECT eid AS election_id, CAST(max(cut_at) AS VARCHAR) AS forecast_as_of, CAST(wd AS VARCHAR) AS snapshot_date, round(arg_min(s0, cut_at), 9) AS s0, round(arg_min(s1, cut_at), 9) AS s1, round(arg_min(s2, cut_at), 9) AS s2
FROM (SELECT eid, max(cut_at) OVER (PARTITION BY eid) AS cut_at, wd, s0, s1, s2 FROM seen) GROUP BY eid, wd""", HIST))
def _(t: Tables):
    origins, seen = pieces(t)
    latest, snaps = wf.collapse_origins(origins, seen)
    joined = snaps.join(latest.select("series_id", "election_id", "forecast_as_of"), ["series_id", "election_id"])
    return joined.select("election_id", day_text("forecast_as_of").alias("forecast_as_of"), day_text("snapshot_date").alias("snapshot_date"), *vector("shares", "s"))


def unique_moves(t: Tables):
    """Moves of the collapsed elections: each snapshot counted once."""
    origins, seen = pieces(t)
    _, snaps = wf.collapse_origins(origins, seen)
    return wf.snapshot_moves(snaps, ["series_id", "election_id"], K)


@query("win_movement_state", with_ctes("""
SELECT eid AS election_id, CAST(wd AS VARCHAR) AS snapshot_date, i AS contestant, round(ch, 9) AS change, st AS state FROM uni""", HIST))
def _(t: Tables):
    moves = unique_moves(t)
    return moves.select("election_id", day_text("snapshot_date").alias("snapshot_date"), "contestant", rnd("change").alias("change"), "state")


@query("agg_transition_matrix", with_ctes("""
SELECT f AS from_state, g AS to_state, round((coalesce(n, 0) + 1) / (sum(coalesce(n, 0) + 1) OVER (PARTITION BY f)), 9) AS probability
FROM (VALUES (0), (1), (2)) a(f) CROSS JOIN (VALUES (0), (1), (2)) b(g)
LEFT JOIN (SELECT pst, st, count(*) AS n FROM uni WHERE pst IS NOT NULL GROUP BY 1, 2) ON pst = f AND st = g""", HIST))
def _(t: Tables):
    out = wf.fit_transition(unique_moves(t), ["series_id"])
    return out.select("from_state", "to_state", rnd("probability").alias("probability"))


@query("agg_median_step", with_ctes("SELECT round(median(abs(ch)), 9) AS step, count(*) AS moves FROM uni", HIST))
def _(t: Tables):
    moves = cut_lineage(unique_moves(t))
    counted = moves.groupBy("series_id").agg(F.count("*").alias("moves"))
    return wf.fit_step(moves, ["series_id"]).join(counted, "series_id").select(rnd("step").alias("step"), "moves")


@query("win_cadence_steps", with_ctes("""
SELECT eid AS election_id, CAST(cut_at AS VARCHAR) AS forecast_as_of, coalesce(median(gap) FILTER (gap > 0), 7.0) AS cadence,
       CAST(greatest(1, least(24, ceil(greatest(1, max(ed - cut_at)) / greatest(coalesce(median(gap) FILTER (gap > 0), 7.0), 1.0)))) AS INTEGER) AS steps
FROM (SELECT *, wd - lag(wd) OVER (PARTITION BY eid, cut_at ORDER BY wd) AS gap FROM seen) GROUP BY 1, 2, cut_at""", HIST))
def _(t: Tables):
    origins, seen = pieces(t)
    keys = ["series_id", "election_id", "forecast_as_of"]
    dated = seen.join(origins.select(*keys, "election_date", F.col("forecast_as_of").alias("as_of")), keys)
    out = wf.campaign_steps(dated, keys, "election_date", "as_of")
    return out.select("election_id", day_text("forecast_as_of").alias("forecast_as_of"), "cadence", "steps")


@query("agg_blend_weight_fit", with_ctes(f"""
SELECT round(least(greatest(sum(n) / sum(d), 0.0), 1.0), 9) AS poll_weight FROM (SELECT eid, avg({NUM}) AS n, avg({DEN}) AS d FROM rec GROUP BY 1)""", HIST))
def _(t: Tables):
    return wf.fit_poll_weight(records(t), ["series_id"], K).select(rnd("poll_weight").alias("poll_weight"))


def folds(t: Tables):
    return wf.Folds(records(t), K)


TEST_KEYS = "te AS test_election_id, CAST(ta AS VARCHAR) AS test_as_of"


def test_keys():
    return ["test_election_id", day_text("test_as_of").alias("test_as_of")]


@query("agg_bias", with_ctes(f"""
SELECT {TEST_KEYS}, round(w, 9) AS poll_weight, round(step, 9) AS step, {each('round(bias{i}, 9) + 0.0 AS b{i}')} FROM shifted WHERE is_test""", HIST, FOLDS, FITS))
def _(t: Tables):
    rows = folds(t).test_rows().where(F.col("model_family") == "baseline_ensemble")
    return rows.select(*test_keys(), rnd("poll_weight").alias("poll_weight"), rnd("step").alias("step"),
        *[(rnd(F.col("bias")[i]) + 0.0).alias(f"b{i}") for i in range(K)])


@query("agg_bias_series", with_ctes(f"""
SELECT {split_id('te')} AS test_election_id, CAST(ta AS VARCHAR) AS test_as_of, round(w, 8) AS poll_weight, round(step, 8) AS step, {each('round(bias{i}, 8) + 0.0 AS b{i}')} FROM shifted WHERE is_test""", HIST_N, NEAR_N, FITS))
def _(t: Tables):
    rows = wf.Folds(nation_records(t), K).test_rows().where(F.col("model_family") == "baseline_ensemble")
    return rows.select("series_id", *test_keys(), rnd("poll_weight", 8).alias("poll_weight"), rnd("step", 8).alias("step"),
        *[(rnd(F.col("bias")[i], 8) + 0.0).alias(f"b{i}") for i in range(K)])


@query("job_point_predictions", with_ctes(f"""
SELECT {TEST_KEYS}, family AS model_family, {each('round(m{i}, 9) AS m{i}')} FROM pred WHERE is_test""", HIST, FOLDS, FITS))
def _(t: Tables):
    return folds(t).test_rows().select(*test_keys(), "model_family", *vector("pred", "m"))


@query("win_rolling_residuals", with_ctes(f"""
SELECT {TEST_KEYS}, family AS model_family, eid AS election_id, {each('round(r{i}, 8) + 0.0 AS r{i}')} FROM resid""", HIST, FOLDS, FITS))
def _(t: Tables):
    out = wf.rolling_residuals(folds(t).rows(), K)
    return out.select(*test_keys(), "model_family", "election_id", *[(rnd(F.col("residual")[i], 8) + 0.0).alias(f"r{i}") for i in range(K)])


@query("agg_residual_covariance", with_ctes(f"""
SELECT {TEST_KEYS}, family AS model_family, count(*) AS n, round(0.75 * (covar_samp(r0, r0) - 2 * (covar_samp(r0, r0) + covar_samp(r0, r1) + covar_samp(r0, r2)) / 3 + (covar_samp(r0, r0) + covar_samp(r1, r1) + covar_samp(r2, r2)
       + 2 * covar_samp(r0, r1) + 2 * covar_samp(r0, r2) + 2 * covar_samp(r1, r2)) / 9)
       + 0.25 * greatest((covar_samp(r0, r0) + covar_samp(r1, r1) + covar_samp(r2, r2)) / 3, 0.005 * 0.005) * 2 / 3, 9) AS c00
FROM resid GROUP BY te, ta, family""", HIST, FOLDS, FITS))
def _(t: Tables):
    out = folds(t).covariances()
    clipped = out.withColumn("covariance", wf.clip_eigenvalues("covariance"))
    return clipped.select(*test_keys(), "model_family", "n", rnd(F.col("covariance")[0][0]).alias("c00"))


def forecasts(t: Tables):
    return wf.fold_forecasts(records(t), K)


@query("job_empirical_intervals", with_ctes(f"""
SELECT {TEST_KEYS}, family AS model_family, i AS party_index, round(predicted, 8) AS predicted, round(probability, 8) AS probability, round(low, 8) AS low, round(high, 8) AS high, round(actual, 8) AS actual
FROM fc""", HIST, FOLDS, FITS, SCORES))
def _(t: Tables):
    return forecasts(t).select(*test_keys(), "model_family", "party_index", *[rnd(c, 8).alias(c) for c in ("predicted", "probability", "low", "high", "actual")])


FOLD_KEYS = [*wf.FOLD, "model_family"]


def score_query(name: str, column: str, fn):
    @query(name, with_ctes(f"SELECT {TEST_KEYS}, family AS model_family, round({column}, 8) AS {column} FROM fold", HIST, FOLDS, FITS, SCORES))
    def _(t: Tables):
        return fn(forecasts(t), FOLD_KEYS).select(*test_keys(), "model_family", rnd(column, 8).alias(column))


score_query("agg_brier", "brier", metrics.brier)
score_query("agg_rmse", "rmse", metrics.vote_share_rmse)
score_query("agg_coverage", "coverage", metrics.interval_coverage)


@query("agg_calibration", with_ctes("SELECT family AS model_family, round(calibration_error, 8) AS calibration_error FROM calibration", HIST, FOLDS, FITS, SCORES, CALIBRATION))
def _(t: Tables):
    marked = metrics.scored(forecasts(t), FOLD_KEYS)
    out = metrics.calibration_error(marked, ["model_family"], "test_election_id", "probability", "is_winner")
    return out.select("model_family", rnd("calibration_error", 8).alias("calibration_error"))


METRICS = """
clustered AS (
  SELECT family, avg(b) AS brier, avg(r) AS rmse, avg(c) AS coverage, count(*) AS held_out, sum(n) AS folds
  FROM (SELECT family, te, avg(brier) AS b, avg(rmse) AS r, avg(coverage) AS c, count(*) AS n FROM fold GROUP BY 1, 2) GROUP BY 1)"""
BOOT = """
numbered AS (SELECT family, v, row_number() OVER (PARTITION BY family ORDER BY te) - 1 AS slot, count(*) OVER (PARTITION BY family) AS n
             FROM (SELECT family, te, avg(brier) AS v FROM fold GROUP BY 1, 2)),
boot AS (
  SELECT family, quantile_cont(m, 0.05) AS ci_low, quantile_cont(m, 0.95) AS ci_high FROM (
    SELECT p.family, rep, avg(x.v) AS m
    FROM (SELECT family, rep, CAST('0x' || substr(md5(rep || ':' || slot), 1, 8) AS BIGINT) % n AS pick FROM numbered CROSS JOIN range(5000) r(rep)) p
    JOIN numbered x ON x.family = p.family AND x.slot = p.pick GROUP BY 1, 2) GROUP BY 1)"""


@query("job_walk_forward", with_ctes("""
SELECT c.family AS model_family, CAST(folds AS BIGINT) AS folds, held_out, round(brier, 8) AS brier, round(ci_low, 8) AS ci_low, round(ci_high, 8) AS ci_high,
       round(rmse, 8) AS rmse, round(coverage, 8) AS coverage, round(calibration_error, 8) AS calibration_error
FROM clustered c JOIN boot USING (family) JOIN calibration USING (family)""", HIST, FOLDS, FITS, SCORES, CALIBRATION, METRICS, BOOT))
def _(t: Tables):
    out = wf.model_metrics(cut_lineage(forecasts(t)))
    return out.select("model_family", "folds", "held_out", *[rnd(c, 8).alias(c) for c in ("brier", "ci_low", "ci_high", "rmse", "coverage", "calibration_error")])


@query("top_best_model", with_ctes("SELECT arg_min(family, (brier, rmse)) AS model_family, round(min(brier), 8) AS brier FROM clustered", HIST, FOLDS, FITS, SCORES, METRICS))
def _(t: Tables):
    scores = metrics.fold_scores(forecasts(t), FOLD_KEYS)
    averages = metrics.clustered_average(scores, ["model_family"], "test_election_id", ["brier", "rmse", "coverage"])
    return ranking_best(averages)


def ranking_best(averages):
    best = metrics.best_model(averages)
    return best.withColumn("brier", rnd("brier", 8))


@query("agg_history_span", with_ctes("""
SELECT CAST((SELECT year(max(ed)) - year(min(ed)) FROM rec) AS INTEGER) AS span_years, (SELECT count(DISTINCT eid) FROM rec) AS elections, count(*) AS folds, count(DISTINCT te) AS held_out,
       CAST(min(td - ta) AS INTEGER) AS horizon_min, CAST(max(td - ta) AS INTEGER) AS horizon_max
FROM (SELECT DISTINCT te, ta, td FROM train)""", HIST, FOLDS))
def _(t: Tables):
    r = records(t)
    train = wf.training_sets(r)
    return wf.history_span(r, train).drop("series_id")


@query("win_gap_check", with_ctes("""
SELECT CAST(ed AS VARCHAR) AS election_date, CAST(p AS VARCHAR) AS previous_date, round((ed - p) / 365.2425, 9) AS gap_years
FROM (SELECT ed, lag(ed) OVER (ORDER BY ed) AS p FROM (SELECT DISTINCT ed FROM rec)) WHERE (ed - p) / 365.2425 > 0.25""", HIST))
def _(t: Tables):
    out = wf.gap_violations(records(t), 0.25)
    return out.select(day_text("election_date").alias("election_date"), day_text("previous_date").alias("previous_date"), rnd("gap_years").alias("gap_years"))


SHA = "0" * 64


def verified(t: Tables):
    return records(t).withColumn("provenance_verified", F.lit(True))


@query("job_reliability", with_ctes("""
SELECT CASE WHEN years < 20 THEN 'span' ELSE '' END AS reasons, years >= 20 AS reliable
FROM (SELECT year(max(ed)) - year(min(ed)) AS years FROM rec)""", HIST))
def _(t: Tables):
    r = verified(t)
    out = wf.reliability(r, wf.training_sets(r), 14, SHA)
    return out.select(F.array_join("reasons", "; ").alias("reasons"), "reliable")


PAIRED = """
best AS (SELECT c.*, calibration_error FROM clustered c JOIN calibration USING (family) WHERE family NOT IN ('gaussian_monte_carlo', 'markov_momentum') ORDER BY brier, rmse LIMIT 1),
diffs AS (
  SELECT f.family, f.te, avg(f.brier - b.brier) AS v FROM fold f JOIN fold b ON b.te = f.te AND b.ta = f.ta AND b.family = (SELECT family FROM best)
  WHERE f.family IN ('gaussian_monte_carlo', 'markov_momentum') GROUP BY 1, 2),
dnum AS (SELECT family, v, row_number() OVER (PARTITION BY family ORDER BY te) - 1 AS slot, count(*) OVER (PARTITION BY family) AS n FROM diffs),
bound AS (
  SELECT family, quantile_cont(m, 0.95) AS up FROM (
    SELECT p.family, rep, avg(x.v) AS m
    FROM (SELECT family, rep, CAST('0x' || substr(md5(rep || ':' || slot), 1, 8) AS BIGINT) % n AS pick FROM dnum CROSS JOIN range(10000) r(rep)) p
    JOIN dnum x ON x.family = p.family AND x.slot = p.pick GROUP BY 1, 2) GROUP BY 1),
judged AS (
  SELECT c.family, c.brier, c.rmse, concat_ws('; ',
    CASE WHEN c.brier >= b.brier THEN printf('%s:brier:%.4f:%.4f', c.family, c.brier, b.brier) WHEN up >= 0 THEN printf('%s:paired_upper:%.4f:%.4f', c.family, up, 0.0::DOUBLE) END,
    CASE WHEN c.rmse > b.rmse * 1.05 THEN printf('%s:rmse:%.4f:%.4f', c.family, c.rmse, b.rmse * 1.05) END,
    CASE WHEN c.coverage < 0.8 THEN printf('%s:coverage:%.4f:%.4f', c.family, c.coverage, 0.8::DOUBLE) END,
    CASE WHEN k.calibration_error > 0.1 THEN printf('%s:calibration:%.4f:%.4f', c.family, k.calibration_error, 0.1::DOUBLE) END,
    CASE WHEN k.calibration_error > b.calibration_error + 0.01 THEN printf('%s:calibration_margin:%.4f:%.4f', c.family, k.calibration_error, b.calibration_error + 0.01) END) AS why
  FROM clustered c JOIN calibration k USING (family) JOIN bound USING (family) CROSS JOIN best b)"""


@query("job_promotion", with_ctes("""
SELECT coalesce(arg_min(family, (brier, rmse)) FILTER (why = ''), '') AS winner,
       CASE WHEN count(*) FILTER (why = '') = 0 THEN 'baseline_retained' ELSE 'challenger_promoted' END AS status,
       CASE WHEN count(*) FILTER (why = '') = 0 THEN string_agg(why, '; ' ORDER BY family) ELSE 'beats:' || (SELECT family FROM best) END AS reasons
FROM judged""", HIST, FOLDS, FITS, SCORES, CALIBRATION, METRICS, PAIRED))
def _(t: Tables):
    r = verified(t)
    fc = cut_lineage(wf.fold_forecasts(r, K))
    scores = metrics.fold_scores(fc, FOLD_KEYS)
    judged = wf.promotion(scores, wf.model_metrics(fc), wf.reliability(r, fc, 14, SHA, min_years=5))
    return judged.select(F.coalesce("winner", F.lit("")).alias("winner"), "status", F.array_join("reasons", "; ").alias("reasons"))


@query("job_vintage_audit", with_ctes("""
SELECT eid AS election_id, CAST(cut_at AS VARCHAR) AS forecast_as_of, 'fundamentals_available' AS rule FROM rec WHERE fav + 70 > cut_at""", HIST))
def _(t: Tables):
    late = records(t).withColumn("fundamentals_available_at", F.date_add("fundamentals_available_at", 70))
    return wf.vintage_audit(late, K).select("election_id", F.coalesce(day_text("forecast_as_of"), F.lit("")).alias("forecast_as_of"), "rule")
