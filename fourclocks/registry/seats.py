"""Seat apportionment, runoff and rankings over votes and draws."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fourclocks.bindings import CONTESTANTS, Tables
from fourclocks.functions.shares import probability_label
from fourclocks.operators import asof, draws as draw_ops, ranking, revisions, seats
from fourclocks.registry import query, rnd, with_ctes
from fourclocks.registry.ctes import DRAWS, VOTES

BY = ["contest_id"]

REMAINDER = """
SELECT contest_id, party, CAST(floor(q) + CASE WHEN row_number() OVER (PARTITION BY contest_id ORDER BY q - floor(q) DESC, party_index)
         <= seats - sum(floor(q)) OVER (PARTITION BY contest_id) THEN 1 ELSE 0 END AS BIGINT) AS allocated
FROM (SELECT *, {value} / sum({value}) OVER (PARTITION BY contest_id) * seats AS q FROM {source})"""

ELIGIBLE = """
shared AS (SELECT *, votes / sum(votes) OVER (PARTITION BY contest_id) AS s FROM votes),
eligible AS (
  SELECT *, CASE WHEN s >= {threshold} OR max(CAST(s >= {threshold} AS INTEGER)) OVER (PARTITION BY contest_id) = 0
            THEN {power} ELSE 0.0 END AS e FROM shared)"""


def allocated(df):
    return df.select("contest_id", "party", "allocated")


@query("win_largest_remainder", with_ctes(REMAINDER.format(value="votes", source="votes"), VOTES))
def _(t: Tables):
    return allocated(seats.largest_remainder(t.votes, BY))


def divisor_oracle(divisor: str) -> str:
    return with_ctes(f"""
SELECT contest_id, party, CAST(sum(CAST(rk <= seats AS INTEGER)) AS BIGINT) AS allocated
FROM (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY votes / CAST({divisor} AS DOUBLE) DESC, party_index, n) AS rk
      FROM (SELECT *, unnest(generate_series(1, seats)) AS n FROM votes)) GROUP BY 1, 2""", VOTES)


@query("win_divisor_seats", divisor_oracle("n"))
def _(t: Tables):
    return allocated(seats.divisor_seats(t.votes, BY, "dhondt"))


@query("win_divisor_seats_odd", divisor_oracle("2 * n - 1"))
def _(t: Tables):
    return allocated(seats.divisor_seats(t.votes, BY, "sainte_lague"))


@query("win_threshold_seats", with_ctes(REMAINDER.format(value="e", source="eligible"), VOTES, ELIGIBLE.format(threshold="0.18", power="s")))
def _(t: Tables):
    return allocated(seats.proportional_seats(t.votes, BY, 0.18))


@query("win_proxy_seats", with_ctes(REMAINDER.format(value="e", source="eligible"), VOTES, ELIGIBLE.format(threshold="0.05", power="pow(s, 3)")))
def _(t: Tables):
    return allocated(seats.proportional_seats(t.votes, BY, 0.05, power=3))


@query("win_proxy_seats_college", with_ctes(REMAINDER.format(value="e", source="eligible"), VOTES, ELIGIBLE.format(threshold="0.05", power="pow(s, 4)")))
def _(t: Tables):
    return allocated(seats.proportional_seats(t.votes, BY, 0.05, power=4))


@query("win_plurality_units", with_ctes("""
SELECT n_regionkey AS region_id, party, CAST(sum(CASE WHEN rn = 1 THEN seats ELSE 0 END) AS BIGINT) AS allocated
FROM (SELECT v.*, n_regionkey, row_number() OVER (PARTITION BY contest_id ORDER BY votes DESC, party_index) AS rn
      FROM votes v JOIN nation ON n_nationkey = contest_id) GROUP BY 1, 2""", VOTES))
def _(t: Tables):
    regions = t.nation.select(F.col("n_nationkey").alias("contest_id"), F.col("n_regionkey").alias("region_id"))
    return seats.plurality_seats(t.votes.join(regions, "contest_id"), ["contest_id"], ["region_id"])


@query("win_mixed_member", with_ctes("""
SELECT a.contest_id, a.party, a.allocated,
       min(d) OVER (PARTITION BY a.contest_id) < 0 OR sum(d) OVER (PARTITION BY a.contest_id) > a.seats AS district_violation
FROM (""" + REMAINDER.format(value="e", source="eligible").replace("SELECT contest_id, party,", "SELECT contest_id, party, seats, votes % 7 AS d,", 1) + ") a",
    VOTES, ELIGIBLE.format(threshold="0.05", power="s")))
def _(t: Tables):
    votes = t.votes.withColumn("district_seats", F.col("votes") % 7)
    return seats.mixed_member(votes, BY, 0.05).select("contest_id", "party", "allocated", "district_violation")


@query("win_runoff", with_ctes("""
SELECT contest_id, party, rk <= 2 AS finalist,
       round(CASE WHEN rk <= 2 THEN s + (total - pair) * s / pair ELSE 0 END, 9) AS runoff_share
FROM (SELECT *, sum(s) OVER (PARTITION BY contest_id) AS total, sum(CASE WHEN rk <= 2 THEN s ELSE 0 END) OVER (PARTITION BY contest_id) AS pair
      FROM (SELECT *, votes / sum(votes) OVER (PARTITION BY contest_id) AS s,
                   row_number() OVER (PARTITION BY contest_id ORDER BY votes DESC, party_index) AS rk FROM votes))""", VOTES))
def _(t: Tables):
    total = F.sum("votes").over(Window.partitionBy("contest_id"))
    out = seats.runoff(t.votes.withColumn("share", F.col("votes") / total), BY)
    return out.select("contest_id", "party", "finalist", rnd("runoff_share").alias("runoff_share"))


@query("win_argmax_first", with_ctes("""
SELECT contest_id, party, votes FROM (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY votes DESC, party_index) AS rn FROM votes)
WHERE rn = 1""", VOTES))
def _(t: Tables):
    return seats.argmax_first(t.votes, BY, "votes", "party_index", "party")


WIN = """
SELECT election_id, contestant_id, avg(CAST(is_win AS INTEGER)) AS p FROM won GROUP BY 1, 2"""


@query("top_leaders", with_ctes(f"""
SELECT election_id, contestant_id, round(p, 9) AS win_probability, CAST(rn AS INTEGER) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY election_id ORDER BY p DESC, contestant_id) AS rn FROM ({WIN})) WHERE rn <= 2""", DRAWS))
def _(t: Tables):
    outcomes = draw_ops.outcome_moments(t.draws, ["election_id"], CONTESTANTS)
    top = ranking.leaders(outcomes, ["election_id"], "win_probability", "contestant_id", 2)
    return top.select("election_id", "contestant_id", rnd("win_probability").alias("win_probability"), "place")


@query("probability_label", with_ctes(f"""
SELECT election_id, contestant_id, CASE WHEN p >= 0.8 THEN 'STRONG FAVORITE' WHEN p >= 0.6 THEN 'FAVORED' WHEN p >= 0.4 THEN 'COMPETITIVE'
       WHEN p >= 0.2 THEN 'UNDERDOG · REAL PATH' ELSE 'LONG SHOT' END AS label FROM ({WIN})""", DRAWS))
def _(t: Tables):
    outcomes = draw_ops.outcome_moments(t.draws, ["election_id"], CONTESTANTS)
    return outcomes.select("election_id", "contestant_id", probability_label(F.col("win_probability")).alias("label"))


HELD = """
held AS (
  SELECT d.run_id, d.election_id, s.key AS coalition_key, max(majority) AS majority, sum(seats) AS held
  FROM draws d JOIN (VALUES ('A+N', 'A'), ('A+N', 'N'), ('A+R', 'A'), ('A+R', 'R'), ('N+R', 'N'), ('N+R', 'R')) s(key, member)
    ON s.member = d.contestant_id GROUP BY 1, 2, 3),
chances AS (SELECT election_id, coalition_key, avg(CAST(held >= majority AS INTEGER)) AS p FROM held GROUP BY 1, 2)"""


@query("top_coalitions", with_ctes("""
SELECT election_id, coalition_key, round(p, 9) AS majority_probability,
       CAST(row_number() OVER (PARTITION BY election_id ORDER BY p DESC, coalition_key) AS INTEGER) AS place FROM chances""", DRAWS, HELD))
def _(t: Tables):
    found = draw_ops.coalitions(t.draws, ["election_id"], CONTESTANTS, "majority")
    ranked = ranking.rank_coalitions(found, ["election_id"])
    return ranked.select("election_id", "coalition_key", rnd("majority_probability").alias("majority_probability"), "place")


@query("set_equal", with_ctes("""
SELECT election_id, coalition_key, round(p, 9) AS majority_probability FROM chances WHERE coalition_key = 'A+R'""", DRAWS, HELD))
def _(t: Tables):
    found = draw_ops.coalitions(t.draws, ["election_id"], CONTESTANTS, "majority")
    members = found.withColumn("members", F.reverse(F.split("coalition_key", r"\+")))
    chosen = revisions.match_member_set(members, "members", ["R", "A"])
    return chosen.select("election_id", "coalition_key", rnd("majority_probability").alias("majority_probability"))
