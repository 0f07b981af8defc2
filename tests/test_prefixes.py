"""Prefix statistics, balanced segments and fold predictions against plain forms."""

import datetime

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fourclocks.operators import revisions
from fourclocks.operators.expanding import prefix_medians
from fourclocks.operators.segments import SEG, balanced_segments, with_segment
from fourclocks.plans import walk_forward as wf


def hot_feed(spark, rows):
    """One key, one second, and a few rows elsewhere."""
    hot = spark.range(rows).select(F.lit("hot").alias("k"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("t"), "id", (F.col("id") % 7 % 3).cast("string").alias("h"))
    cold = spark.range(rows, rows + 50).select((F.col("id") % 5).cast("string").alias("k"), F.timestamp_seconds(F.col("id") * 100).alias("t"), "id", (F.col("id") % 2).cast("string").alias("h"))
    return hot.unionByName(cold)


def test_a_hot_second_is_cut_evenly(spark):
    feed = hot_feed(spark, 100_000).cache()
    segment = balanced_segments(feed, ["t", "id"], 32)
    sizes = [r["count"] for r in with_segment(feed, segment).where("k = 'hot'").groupBy(SEG).count().collect()]
    assert len(sizes) >= 24 and max(sizes) <= 2 * np.median(sizes)
    w = Window.partitionBy("k").orderBy("t", "id")
    step = F.when(F.lag("h").over(w).eqNullSafe(F.col("h")), 0).otherwise(1)
    want = feed.withColumn("s", step).withColumn("revision", F.sum("s").over(w) - 1).select("id", "revision")
    got = revisions.number_revisions(feed, ["k"], ["t", "id"], "h", segment).select("id", "revision")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    feed.unpersist()


@pytest.mark.parametrize("order", [["t", "id"], ["id"], ["h", "id"]])
def test_segments_never_fall_along_the_order(spark, order):
    feed = hot_feed(spark, 300)
    rows = with_segment(feed, balanced_segments(feed, order, 20)).orderBy(*order).collect()
    numbers = [r[SEG] for r in rows]
    assert numbers == sorted(numbers) and len(set(numbers)) > 10
    assert with_segment(feed.limit(0), balanced_segments(feed.limit(0), order)).count() == 0


def test_prefix_medians_equal_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(at), float(v)) for k in ("a", "b") for at in range(1, 30) for v in rng.integers(0, 9, rng.integers(0, 40)) / 7]
    values = spark.createDataFrame(rows, "k string, at long, value double")
    places = spark.createDataFrame([(k, at, sum(1 for r in rows if r[0] == k and r[1] <= at)) for k in ("a", "b", "c") for at in range(1, 30)], "k string, at long, n long")
    got = {(r.k, r.at): r.median for r in prefix_medians(values, places, ["k"]).collect()}
    for k in ("a", "b"):
        for at in range(1, 30):
            seen = [v for key, place, v in rows if key == k and place <= at]
            assert got.get((k, at)) == (pytest.approx(np.median(seen)) if seen else None)
    assert not any(k == "c" for k, _ in got)


def made_records(spark, late=False):
    """Two series with origins at several horizons, some vectors with clipped parts; in ``late`` results of one series cross."""
    rng = np.random.default_rng(8)
    rows = []
    for series, n in (("x", 14), ("y", 9)):
        for e in range(n):
            date = datetime.date(1990, 1, 1) + datetime.timedelta(days=365 * e + 3)
            out = date + datetime.timedelta(days=14 if not (late and series == "y") else (900 if e % 3 == 0 else 10))
            truth, fund = (rng.dirichlet([3, 2, 1]) for _ in range(2))
            for h in (30, 28, 7) if e % 2 else (29, 7):
                last, prev = (rng.dirichlet([3, 2, 1]) for _ in range(2))
                if e % 4 == 1:
                    last = np.array([0.7, 0.3, 0.0])
                steps = np.abs(rng.normal(0, 0.01, rng.integers(0, 12))).tolist()
                rows.append((series, f"{series}{e}", date, date - datetime.timedelta(days=h), out, truth.tolist(), fund.tolist(), last.tolist(), prev.tolist(), rng.integers(0, 4, 9).tolist(), steps))
    schema = "series_id string, election_id string, election_date date, forecast_as_of date, result_available_at date, actual array<double>, fundamentals array<double>, last_poll array<double>, prev_poll array<double>, transitions array<long>, steps array<double>"
    return spark.createDataFrame(rows, schema)


def numbers(df):
    columns = [*wf.FOLD, "election_id", "forecast_as_of", "is_test", "model_family"]
    rows = df.select(*columns, "pred", "bias", "step", "poll_weight").collect()
    out = {tuple(r[: len(columns)]): r[len(columns) :] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("late", [False, True])
def test_prefix_predictions_equal_pairs(spark, late):
    records = made_records(spark, late).cache()
    folds = wf.Folds(records, 3, minimum_train=3)
    assert (folds.paired is not None) == late
    got = numbers(folds.rows())
    plain = wf.predictions(wf.fold_rows(records, wf.training_sets(records, 3)), 3)
    want = numbers(plain)
    assert got.keys() == want.keys() and len(got) > 100
    for key, (pred, bias, step, weight) in want.items():
        mine = got[key]
        assert (mine[0] is None) == (pred is None)
        if pred is not None:
            assert list(mine[0]) == pytest.approx(list(pred), abs=1e-10)
        assert list(mine[1]) == pytest.approx(list(bias), abs=1e-10) and mine[2:] == pytest.approx((step, weight), abs=1e-10)
    covered = {tuple(r[:4]): r[5] for r in folds.covariances().select(*wf.FOLD, "model_family", "n", "covariance").collect()}
    slow = wf.residual_covariance(wf.rolling_residuals(plain, 3), 3)
    for r in slow.select(*wf.FOLD, "model_family", "n", "covariance").collect():
        assert np.array(covered[tuple(r[:4])]) == pytest.approx(np.array(r[5]), abs=1e-9)
    records.unpersist()
