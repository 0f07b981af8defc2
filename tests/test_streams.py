"""Streams over several triggers: late rows, repeats, replays, hot keys."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fourclocks.streaming import jobs, stateful
from fourclocks.streaming.ledger import Ledger

START = datetime(2024, 1, 1)


def test_ids_pass_once_however_late(spark, tmp_path):
    schema = "id string, ts timestamp, n int"
    arrivals = [
        [("a", START + timedelta(hours=5), 1), ("b", START, 2), ("b", START, 3), (None, START, 4)],
        [("c", START - timedelta(days=30), 5), ("a", START + timedelta(days=41), 6)],  # a late first row, a late repeat
        [("a", START, 7), ("c", START, 8), ("d", START, 9), (None, START, 10)],
    ]
    ids = jobs.seen_ids(f"{tmp_path}/ids", buckets=4)
    write = jobs.new_events_batch(ids, f"{tmp_path}/out", "id", ["ts"])
    for rows in arrivals:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.run_available(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/check", write)
    out = spark.read.parquet(f"{tmp_path}/out")
    got = {(r.batch, r.id, r.n) for r in out.collect()}
    assert got == {(0, "a", 1), (0, "b", 2), (0, None, 4), (1, "c", 5), (2, "d", 9)}
    write(spark.createDataFrame(arrivals[2], schema), 2)  # a replay changes nothing
    assert {(r.batch, r.id, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == got
    assert ids.read(spark).count() == 5


def test_a_batch_reads_only_its_buckets_and_compaction_keeps_rows(spark, tmp_path):
    table = Ledger(f"{tmp_path}/t", "k long, v long", ["k"], buckets=16)
    for batch in range(3):
        table.write(spark.range(100).select(F.col("id").alias("k"), F.lit(batch).cast("long").alias("v")), batch)
    one = spark.createDataFrame([(7,)], "k long")
    read = table.read(spark, table.hits(one), before=2)
    assert len({f.split("bucket=")[1].split("/")[0] for f in read.inputFiles()}) == 1
    assert {r.v for r in read.where("k = 7").collect()} == {0, 1}
    table.compact(spark, lambda rows: rows.groupBy("k").agg(F.max("v").alias("v")))
    assert table.generation(spark) == 1 and table.read(spark).count() == 100
    table.write(one.withColumn("v", F.lit(9).cast("long")), 3)
    assert sorted(r.v for r in table.read(spark, table.hits(one)).where("k = 7").collect()) == [2, 9]


def test_late_rows_amend_their_alerts(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [
        (i, "job", START + timedelta(seconds=int(rng.integers(0, 7200))), "failure" if rng.random() < 0.03 else "success", "parser_drift" if rng.random() < 0.5 else "network", float(rng.random()) * 0.4)
        for i in range(600)
    ]
    rows += [(600, "job", START, "failure", "source_drift", 9.0), (601, "idle", START, "success", None, None)]
    runs = spark.createDataFrame(rows, "i int, job string, occurred_at timestamp, status string, failure_kind string, latency double")
    counts = jobs.alert_ledger(f"{tmp_path}/counts", 4)
    write = jobs.alerts_batch(counts, f"{tmp_path}/alerts")
    for k in range(5):  # the last batch holds rows of all times
        write(runs.where(F.col("i") % 5 == k), k)
    write(runs.where(F.col("i") % 5 == 4), 4)
    whole = jobs.judge_counts(jobs.window_counts(runs))
    got = {tuple(r) for r in jobs.current_alerts(spark, f"{tmp_path}/alerts").select(whole.columns).collect()}
    assert got == {tuple(r) for r in whole.collect()}
    table = jobs.alert_windows(runs).select("window_start", "job", "runs", "failures", "slow", "failure_alert", "error_alert", "latency_alert")
    assert {tuple(r) for r in whole.select(table.columns).collect()} == {tuple(r) for r in table.collect()}


def test_events_fan_out_in_one_write(spark, tmp_path):
    good = '{"id":"x","type":"alert","as_of":"2024-01-01T00:00:00Z","published_at":"2024-01-01T00:00:00Z","model_version":"1","data_quality":"A","freshness":"f","provenance":["p"]}'
    rows = spark.createDataFrame([(good,), (good.replace('"x"', '""'),), ("{}",), ("no json",), (None,)], "value string")
    write = jobs.route_events_batch(f"{tmp_path}/events", f"{tmp_path}/rejects")
    write(rows, 0)
    write(rows, 0)
    out = jobs.routed_events(spark, f"{tmp_path}/events")
    assert [r.e.id for r in out.where("outcome = 'accepted'").collect()] == ["x"]
    assert out.where("outcome = 'dead'").count() == 4
    counts = {r.reason: r.n for r in spark.read.parquet(f"{tmp_path}/rejects").where("n > 0").collect()}
    assert counts == {"accepted": 1, "empty_id": 1, "missing": 3}


@pytest.mark.parametrize("size", [1, 3, 50])
def test_buffer_keeps_the_newest_in_any_order(spark, tmp_path, size):
    stateful.use_keyed_state(spark)
    rng = np.random.default_rng(size)
    rows = [(int(u), float(rng.integers(0, 40)), i) for i, u in enumerate(rng.choice([1, 1, 1, 2], 160))]
    df = spark.createDataFrame(rows, "user long, at double, event_id long")
    for k in range(2):
        df.where(F.col("event_id") % 2 == k).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        jobs.store_available(stateful.latest_buffer(stream, "user", size), f"{tmp_path}/check", f"{tmp_path}/out", "update")
    out = spark.read.parquet(f"{tmp_path}/out").groupBy("subscriber").agg(F.max_by(F.struct("held", "buffered", "dropped"), "batch").alias("b"))
    for r in out.collect():
        mine = sorted((at, i) for u, at, i in rows if u == r.subscriber)
        assert list(r.b.held) == [i for _, i in mine[-size:]]
        assert (r.b.buffered, r.b.dropped) == (min(size, len(mine)), max(0, len(mine) - size))


def slow_good(rows, last):
    out = []
    for v, f in rows:
        ok = last is None or (v >= last[0] and f >= last[1])
        last = (v, f) if ok else last
        out.append((ok, *last))
    return out


def test_chunked_judgements_equal_row_loops():
    rng = np.random.default_rng(1)
    for last in (None, (5, 0.2)):
        for n, top in ((1, 10), (50, 10), (500, 100_000)):
            votes, share = rng.integers(0, top, n), rng.integers(0, 10, n) / 10
            if top > 10:
                votes.sort()
                share = np.sort(share)
            ok, v, f = stateful.good_rows(votes, share, last)
            assert list(zip(ok.tolist(), v.tolist(), f.tolist())) == slow_good(list(zip(votes.tolist(), share.tolist())), last)
    for limit in (0, 1, 3, 120):
        at = np.sort(rng.integers(0, 300, 400) / 2)
        got, ring = [], []
        for begin in range(0, len(at), 37):
            part, ring = stateful.allowed_hits(at[begin : begin + 37], ring, limit, 10)
            got += part.tolist()
        recent, want = [], []
        for x in at.tolist():
            recent = [y for y in recent if y > x - 10]
            want.append(len(recent) < limit)
            recent += [x] if want[-1] else []
        assert got == want


def test_a_million_rows_of_one_key_stay_small():
    import tracemalloc

    import pandas as pd

    n = 1_000_000
    rng = np.random.default_rng(0)
    at = rng.permutation(n)
    frames = (
        pd.DataFrame({"votes": at[s : s + 10_000], "reporting_fraction": 0.5, "reported_at": pd.to_datetime(at[s : s + 10_000], unit="s"), "event_id": at[s : s + 10_000]})
        for s in range(0, n, 10_000)
    )

    class State:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    judge = stateful.MonotonicResults()
    judge.good = State()
    tracemalloc.start()
    total = sum(int(f["accepted"].sum()) for f in judge.handleInputRows((1, "A"), frames, None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == n and judge.good.value == (n - 1, 0.5, (n - 1) * 1_000_000)
    assert peak < 500e6
