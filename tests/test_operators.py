"""Golden values, revision rules, leakage and skew checks on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from fourclocks.operators import asof, polls, revisions, seats
from fourclocks.operators.quantiles import quantiles


def votes(spark, values, total):
    rows = [(1, f"p{i}", i, float(v), total) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "contest_id int, party string, party_index int, votes double, seats int")


def allocated(df):
    return [r.allocated for r in df.orderBy("party_index").collect()]


@pytest.mark.parametrize("method, expected", [("dhondt", [3, 2, 0]), ("sainte_lague", [2, 2, 1])])
def test_divisor_goldens(spark, method, expected):
    assert allocated(seats.divisor_seats(votes(spark, [100000, 80000, 30000], 5), ["contest_id"], method)) == expected


def test_remainder_and_threshold_goldens(spark):
    shares = [0.48, 0.32, 0.16, 0.04]
    assert allocated(seats.largest_remainder(votes(spark, shares, 10), ["contest_id"])) == [5, 3, 2, 0]
    assert allocated(seats.proportional_seats(votes(spark, shares, 100), ["contest_id"], 0.05)) == [50, 33, 17, 0]


def test_revision_rules_differ_on_returning_content(spark):
    rows = spark.createDataFrame([("k", 0, "A"), ("k", 100, "B"), ("k", 200, "A")], "key string, t long, h string")
    segment = F.floor(F.col("t") / 100).cast("long")
    for mode, expected in (("latest", [0, 1, 2]), ("any", [0, 1, 0])):
        out = revisions.number_revisions(rows, ["key"], ["t"], "h", segment, mode).orderBy("t").collect()
        assert [r.revision for r in out] == expected


def test_future_poll_changes_nothing(spark):
    schema = "election_id int, pollster string, mode string, fieldwork_end date, available_at timestamp, sample_size int, shares array<double>"

    def rows(future):
        return spark.sql(
            "SELECT * FROM VALUES (1, 'A', 'live_phone', date'2028-10-01', timestamp'2028-10-02', 1000, array(0.54D, 0.46D)),"
            "(1, 'B', 'live_phone', date'2028-10-20', timestamp'2028-10-21', 1000, array(0.48D, 0.52D)),"
            f"(1, 'C', 'live_phone', date'2028-10-22', timestamp'2028-10-26', 1000, array({future}D, 1 - {future}D))"
            " AS t(election_id, pollster, mode, fieldwork_end, available_at, sample_size, shares)"
        ).select(*[c.split()[0] for c in schema.split(", ")])

    cutoff = F.lit("2028-10-24").cast("timestamp")
    results = [
        [r.share for r in polls.aggregate_polls(rows(x), ("a", "b"), cutoff).orderBy("contestant_id").collect()]
        for x in ("0.10", "0.90")
    ]
    assert results[0] == results[1]
    assert results[0][0] < 0.52 and abs(sum(results[0]) - 1) < 1e-9


def test_quantiles_equal_brute_force_under_skew(spark):
    rng = random.Random(7)
    data = [("hot", round(rng.random(), 3)) for _ in range(3000)] + [("cold", round(rng.random(), 3)) for _ in range(41)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: (r.lo, r.hi) for r in quantiles(df, ["k"], "v", {"lo": 0.05, "hi": 0.95}, 0.01).collect()}
    want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", [0.05, 0.95]).alias("q")).collect()}
    for key, (low, high) in got.items():
        assert abs(low - want[key][0]) < 1e-12 and abs(high - want[key][1]) < 1e-12


def test_unit_levels_tells_missing_parents_and_cycles(spark):
    rows = [("r", None), ("a", "r"), ("b", "a"), ("x", "gone"), ("c1", "c2"), ("c2", "c1")]
    out = asof.unit_levels(spark.createDataFrame(rows, "unit_id string, parent_id string")).collect()
    got = {r.unit_id: (r.depth, r.status) for r in out}
    assert got["b"] == (2, "ok") and got["x"] == (-1, "missing_parent") and got["c1"] == (-1, "unreachable")


# tables that can fail ------------------------------------------------------------------------------------------------


def test_levels_have_no_depth_limit(spark):
    from fourclocks.operators.asof import unit_levels

    rows = [(str(i), str(i - 1) if i else None) for i in range(40)]
    rows += [("a", "b"), ("b", "a"), ("tail", "a"), ("lost", "nobody"), ("below", "lost")]
    got = {r["unit_id"]: (r["depth"], r["status"]) for r in unit_levels(spark.createDataFrame(rows, "unit_id string, parent_id string")).collect()}
    assert all(got[str(i)] == (i, "ok") for i in range(40))
    assert got["a"] == got["b"] == got["tail"] == (-1, "unreachable")
    assert got["lost"] == (-1, "missing_parent") and got["below"] == (-1, "missing_ancestor")


def test_levels_of_many_short_cycles_take_few_rounds(spark):
    """Rounds follow the longest chain, not the number of units, and no round multiplies the planner's size up."""
    from fourclocks.operators.asof import unit_levels

    pairs = [(f"{side}{i}", f"{other}{i}") for i in range(300) for side, other in ("ab", "ba")]
    out = unit_levels(spark.createDataFrame([("r", None), ("c", "r"), ("d", "c"), *pairs], "unit_id string, parent_id string"))
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 200
    got = {r["unit_id"]: (r["depth"], r["status"]) for r in out.collect()}
    assert got.pop("r") == (0, "ok") and got.pop("c") == (1, "ok") and got.pop("d") == (2, "ok")
    assert len(got) == 600 and set(got.values()) == {(-1, "unreachable")}


def test_csv_of_real_shapes(spark):
    from fourclocks.sources.tabular import csv_records

    text = 'a,b,a,,\n1,"x, ""y""\nz",3,4,5\n,,\n7\n'
    rows = [r["record"] for r in csv_records(spark.createDataFrame([(text,), ("a,b\n",), ("",)], "content string"), "content").collect()]
    assert rows[0] == {"a": "3", "b": 'x, "y"\nz', "": "5"}
    assert rows[1] == {"a": "", "b": ""} and rows[2] == {"a": "7"}
    assert rows[3] is None and rows[4] is None


def test_unreadable_objects_stay_visible(spark):
    from fourclocks.sources.tabular import read_results

    raw = spark.createDataFrame([(1, '{"results":[{"x"', "json"), (2, "", "csv")], "id int, content string, format string")
    assert [(r["id"], r["valid"]) for r in read_results(raw).orderBy("id").collect()] == [(1, False), (2, False)]


def test_contests_without_votes_or_seats(spark):
    from fourclocks.operators.seats import divisor_seats, largest_remainder

    rows = [("x", 0, 0.0, 3), ("x", 1, 0.0, 3), ("y", 0, 60.0, 0), ("y", 1, 40.0, 0), ("z", 0, 60.0, 3), ("z", 1, 40.0, 3)]
    votes = spark.createDataFrame(rows, "contest string, party_index int, votes double, seats int")
    want = {("z", 0): 2, ("z", 1): 1}
    largest = {(r["contest"], r["party_index"]): r["allocated"] for r in largest_remainder(votes, ["contest"]).collect()}
    assert largest == {(c, i): want.get((c, i), 0) for c, i, _, _ in rows}
    divided = {(r["contest"], r["party_index"]): r["allocated"] for r in divisor_seats(votes, ["contest"]).collect()}
    assert divided["y", 0] == divided["y", 1] == 0 and divided["z", 0] == 2


def test_hash_parts_do_not_run_together(spark):
    from pyspark.sql import functions as F

    from fourclocks.functions.text import content_hash

    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a\\", "b|c"), (None, "c"), ("\\N", "c")], "x string, y string")
    assert rows.select(content_hash(F.col("x"), F.col("y")).alias("h")).distinct().count() == 5


def test_a_source_listed_twice_decides_nothing(spark):
    from fourclocks.operators.contracts import apply_source_policy

    registry = spark.createDataFrame([("s", True, "L"), ("s", False, "L"), ("t", True, "L")], "source_id string, approved boolean, license_id string")
    rows = spark.createDataFrame([(1, "s", "L"), (2, "t", "L"), (3, "u", "L")], "id int, source_id string, license string")
    got = {r["id"]: r["decision"] for r in apply_source_policy(rows, registry).collect()}
    assert got == {1: "duplicate_source", 2: "accepted", 3: "unknown_source"}


def test_references_and_folding_equal_the_standard_library(spark):
    import html

    from fourclocks.functions.text import visible_text

    texts = [
        "f&uuml;r &#228;&#xE4;&#x1F600; &amp;lt; &amp &ampfoo; &nosuch; & &#; &#x; &#xg1;", "a&nbsp;　 b\x1c c", "&#128;&#0;&#xD800;&#1;&#65534;x",
        "&#99999999999;&#x0000041;&#65 &notin; &notit;", "STRASSE Straße ΟΔΟΣ ﬁn ſt İ", "", "plain",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", visible_text(F.col("t")).alias("v"))
    assert {r.i: r.v for r in rows.collect()} == {i: " ".join(html.unescape(t).casefold().split()) for i, t in enumerate(texts)}


def test_markup_tables_follow_colspan_and_the_last_mention(spark):
    from fourclocks.sources import markup

    def table(span, header, cells):
        return f"{{| class=x\n! Date !! {span}| Two-party vote\n|-\n! Firm !! {header}\n|-\n! 3 May 1998\n| Poll || {cells}\n|}}"

    docs = [
        (1, table("colspan=3 ", "Alpha !! Nova !! Lead", "40% || 60% || 20")),
        (2, table("colspan=2 ", "Alpha of old !! Nova !! Alpha", "40% || 60%")),
        (3, table("", "Alpha !! Nova", "45 || 55")),
        (4, table("colspan=1 ", "Alpha !! Nova", "45 || 55")),
        (5, table("colspan=2 ", "Others !! Nova", "45 || 55")),
    ]
    rules = markup.TableRules("(?i)two-party vote", r"\bAlpha\b", r"\bNova\b")
    out = markup.extract_poll_rows(spark.createDataFrame(docs, "i int, content string"), rules)
    assert {r.i: round(r.first_share, 6) for r in out.collect()} == {1: 0.4, 2: 0.6, 3: 0.45}


@pytest.mark.parametrize("width", [1e-3, 0.5, 100.0])
def test_quantiles_are_exact_at_any_bin_width(spark, width):
    import numpy as np

    draw = random.Random(5)
    values = {0: [draw.uniform(-1, 1) for _ in range(501)], 1: [0.25] * 40 + [draw.gauss(0.25, 1e-7) for _ in range(300)], 2: [-3.0]}
    rows = [(k, v) for k, own in values.items() for v in own] + [(0, None)]
    out = quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", {"a": 0.05, "b": 0.5, "c": 1.0}, width)
    got = {r.k: (r.a, r.b, r.c) for r in out.collect()}
    assert got.keys() == values.keys()
    for k, own in values.items():
        assert got[k] == pytest.approx(np.quantile(own, [0.05, 0.5, 1.0]), rel=1e-12)


def test_provenance_numbers_sources_across_segments_and_null_keys(spark):
    from fourclocks.operators import reporting

    rows = [("a", "x", 5), ("a", "y", 1), ("a", "x", 900), ("a", "z", 2500), (None, "x", 3), (None, "y", 4000)]
    out = reporting.provenance(spark.createDataFrame(rows, "k string, s string, t long"), ["k"], ["s"], "t", F.floor(F.col("first_seen") / 1000))
    assert {(r.k, r.s, r.first_seen, r.position) for r in out.collect()} == {
        ("a", "y", 1, 1), ("a", "x", 5, 2), ("a", "z", 2500, 3), (None, "x", 3, 1), (None, "y", 4000, 2)}


def test_poll_rows_evaluate_each_expression_once(spark):
    """The plan names a document's regular expressions once each; uses inside lambdas and pushed filters repeat none."""
    from fourclocks.sources import markup

    docs = spark.createDataFrame([(1, None), (2, ""), (3, "{| class=x\n! Two-party vote\n! A !! B\n|-\n! 1 May 1998\n| P || 60 || 40\n|}")], "i int, content string").where("i < 9")
    for out in (
        markup.extract_poll_rows(docs, markup.TableRules("Two-party vote", "A", "B")),
        markup.extract_poll_vectors(docs, markup.VectorRules("^== x ==$", 0)),
    ):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract(") + plan.count("regexp_extract_all(") + plan.count("aggregate(") < 15
    rows = markup.extract_poll_rows(docs, markup.TableRules("Two-party vote", "A", "B")).collect()
    assert [(r.i, r.rows_used, r.first_share) for r in rows] == [(3, 1, 0.6)]


def test_bundles_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    """While the tables are written, a task may hold a file of each entity open; the session's setting then comes back."""
    from pyspark.sql.readwriter import DataFrameWriter

    from fourclocks.plans import publication

    name, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(int(spark.conf.get(name))), write(self, *a, **k))[1])
    docs = spark.createDataFrame([('{"id":"1","election_id":"e","input_revision_ids":["a","a"]}',), ("{}",)], "content string")
    before = spark.conf.get(name)
    tagged = publication.load_bundles(docs, str(tmp_path / "b"))
    entities = {r.entity for r in tagged.select("entity").distinct().collect()}
    assert {p.name for p in (tmp_path / "b").glob("entity=*")} == {f"entity={e}" for e in entities}
    assert {"forecast_snapshots", "duplicates", "unreadable"} <= entities
    assert seen == [len(publication.BUNDLE_TABLES) + 1] and spark.conf.get(name) == before


def test_unknown_refs_sort_and_join_no_repeats(spark):
    """Null references have no target, a null target meets none, and repeats are not sorted for a join."""
    refs = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "ref int")
    out = asof.unknown_refs(refs, spark.createDataFrame([(2,), (None,), (3,), (3,)], "ref long"), ["ref"])
    assert out.dtypes == [("ref", "int")] and sorted((r.ref for r in out.collect()), key=str) == [1, None]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_revision_numbers_look_a_segment_up_once(spark):
    """No pass over the rows repeats the lookup among the splitters."""
    from fourclocks.operators.segments import balanced_segments

    df = spark.createDataFrame([("u", i, "ab"[i // 3 % 2]) for i in range(40)], "k string, at long, h string")
    out = revisions.number_revisions(df, ["k"], ["at"], "h", balanced_segments(df, ["at"], 5))
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["at"]: r["revision"] for r in out.collect()} == {i: i // 3 for i in range(40)}


def test_a_new_key_asks_its_state_once():
    """Each call of a state is a round trip; that of a key without state answers none."""
    import pandas as pd

    from fourclocks.streaming.stateful import MonotonicResults

    class State:
        calls, value = [], None

        def get(self):
            self.calls.append("get")
            return self.value

        def exists(self):
            self.calls.append("exists")
            return self.value is not None

        def update(self, value):
            self.value = value

    judge = MonotonicResults()
    judge.good = State()
    times = pd.to_datetime(["2024-01-01", "2024-01-02"])
    rows = pd.DataFrame({"votes": [5, 3], "reporting_fraction": [0.5, 0.5], "reported_at": times, "event_id": [1, 2]})
    out = pd.concat(judge.handleInputRows((1, "a"), iter([rows]), None))
    assert out["accepted"].tolist() == [True, False] and out["votes"].tolist() == [5, 5]
    assert State.calls == ["get"]
