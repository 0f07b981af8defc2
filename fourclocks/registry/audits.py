"""Audits of evaluation evidence over orders that stand for records, with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fourclocks.bindings import Tables
from fourclocks.plans import audit
from fourclocks.registry import query

#: An order's remainder by this number says which fault is planted into its evidence.
TURNS = 29


def evidence(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Records and revisions: every order cites one revision of fundamentals, two of polls and one of its result."""
    turn, key, day = F.col("o_orderkey") % TURNS, F.col("o_orderkey").cast("string"), F.col("o_orderdate").cast("date")
    name = {c: F.concat(F.lit(c), key) for c in ("f", "p", "q", "r", "x")}
    second = F.date_add(day, F.when(turn == 4, 51).otherwise(20))  # a poll of after the cut-off
    base = t.orders.select("o_orderkey", turn.alias("turn"), day.alias("day"), *[v.alias(k) for k, v in name.items()], second.alias("second"))
    records = base.select(
        F.lit("orders").alias("series_id"), F.col("o_orderkey").cast("string").alias("election_id"), F.date_add("day", 50).alias("forecast_as_of"), F.date_add("day", 60).alias("election_date"),
        F.date_add("day", 5).alias("fundamentals_available_at"), F.date_add("day", 70).alias("result_available_at"), F.col("f").alias("fundamentals_revision_id"),
        F.col("r").alias("result_revision_id"), F.array("p", "q").alias("polling_revision_ids"), F.array(F.date_add("day", 10), F.col("second")).alias("polling_snapshot_dates"))

    def revision(ident: str, role: str, at):
        return F.struct(F.col(ident).alias("id"), F.lit(role).alias("role"), at.alias("at"))

    late = F.date_add("day", F.when(F.col("turn") == 5, 71).otherwise(70))  # the record states another date
    own = [revision("f", "fundamentals", F.date_add("day", 5)), revision("p", "poll", F.date_add("day", 10)), revision("q", "poll", F.col("second")), revision("r", "result", late)]
    twice = F.when(F.col("turn") == 11, F.array(own[0])).otherwise(F.slice(F.array(own[0]), 1, 0))
    unused = F.when(F.col("turn") == 2, F.array(revision("x", "poll", F.date_add("day", 10)))).otherwise(F.slice(F.array(own[0]), 1, 0))
    cut = F.filter(F.array(*own), lambda r: ~((F.col("turn") == 1) & (r["role"] == "fundamentals")))
    each = base.select("turn", F.explode(F.concat(cut, twice, unused)).alias("r")).select("turn", "r.*")
    first, turn = F.col("role") == "fundamentals", F.col("turn")
    body = F.concat(F.lit("body of "), F.col("id"))
    planted = lambda n, value, normal: F.when(first & (turn == n), value).otherwise(normal)
    revisions = each.select(
        "id", planted(8, "http://a.example/x", F.lit("https://a.example/x")).alias("source_url"), planted(9, " ", F.lit("CC-BY")).alias("license"), F.lit("https://a.example/l").alias("license_url"),
        F.lit("office").alias("authority"), F.when(first & (turn == 3), "poll").when((F.col("role") == "result") & (turn == 14), "gossip").otherwise(F.col("role")).alias("role"),
        F.date_sub("at", 2).alias("observed_at"), F.date_sub("at", 1).alias("released_at"), F.col("at").alias("available_at"), F.date_add("at", planted(10, F.lit(-1), F.lit(1))).alias("retrieved_at"),
        planted(7, "XYZ", F.sha2(planted(6, "other bytes", body), 256)).alias("sha256"), planted(13, F.lit(None), F.sha2(body, 256)).alias("object_sha256"),
        F.when(first & (turn == 12), "hearsay").when(F.col("role") == "poll", F.when(turn == 15, "retrospective_compilation").otherwise(audit.ARCHIVE)).otherwise(audit.OFFICIAL).alias("vintage_proof"))
    return records, revisions


def planted(turn: int, rule: str, mark: str, owned: bool) -> str:
    owner = "CAST(o_orderkey AS VARCHAR)" if owned else "''"
    return f"SELECT '{rule}' AS rule, '{mark}' || o_orderkey AS revision_id, {owner} AS election_id FROM orders WHERE o_orderkey % {TURNS} = {turn}"


FAULTS = (
    (1, "unknown", "f", True), (2, "unreferenced", "x", False), (3, "role", "f", True), (4, "late", "q", True), (5, "availability", "r", True), (6, "hash", "f", False), (7, "digest", "f", False),
    (7, "hash", "f", False), (8, "source_url", "f", False), (9, "license", "f", False), (10, "chronology", "f", False), (11, "unique", "f", False), (12, "vintage_proof", "f", False),
    (13, "object", "f", False), (14, "role", "r", True), (14, "role_name", "r", False),
)


@query("job_evidence_audit", "\nUNION ALL ".join(planted(*f) for f in FAULTS))
def _(t: Tables):
    out = audit.evidence_audit(*evidence(t))
    return out.select("rule", "revision_id", F.coalesce("election_id", F.lit("")).alias("election_id"))


@query("job_evidence_provenance", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS election_id, o_orderkey % {TURNS} NOT IN (1, 12, 15) AS provenance_verified FROM orders""")
def _(t: Tables):
    return audit.provenance_verified(*evidence(t)).select("election_id", "provenance_verified")


@query("job_evidence_snapshots", f"""
SELECT 'snapshot_before_cutoff' AS rule, CAST(o_orderkey AS VARCHAR) AS election_id FROM orders WHERE o_orderkey % {TURNS} = 4
UNION ALL SELECT 'ordered_snapshots', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % {TURNS} = 16
UNION ALL SELECT 'one_revision_each', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % {TURNS} = 17
UNION ALL SELECT 'two_snapshots', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % {TURNS} IN (18, 19)
UNION ALL SELECT 'normalised', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % {TURNS} = 20
UNION ALL SELECT 'one_dimension', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % {TURNS} IN (21, 22)
UNION ALL SELECT 'stable_dimension', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % {TURNS} = 22""")
def _(t: Tables):
    records, _ = evidence(t)
    turn = F.col("election_id").cast("long") % TURNS
    dates, ids = F.col("polling_snapshot_dates"), F.col("polling_revision_ids")
    plain = F.array(F.lit(0.6), F.lit(0.4))
    vectors = F.when(turn == 18, F.array(plain)).when(turn == 19, F.array(plain, plain, plain)).when(turn == 21, F.array(plain, F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)))).otherwise(F.array(plain, plain))
    actual = F.when(turn == 20, F.array(F.lit(0.6), F.lit(0.5))).when(turn == 22, F.array(F.lit(0.6), F.lit(0.3), F.lit(0.1))).otherwise(plain)
    made = records.withColumns({
        "polling_snapshot_dates": F.when(turn == 16, F.reverse(dates)).when(turn == 18, F.slice(dates, 1, 1)).when(turn == 19, dates).otherwise(dates),
        "polling_revision_ids": F.when(turn.isin(17, 18), F.slice(ids, 1, 1)).when(turn == 19, F.concat(ids, F.array(F.lit("z")))).otherwise(ids),
        "polling_snapshots": vectors, "actual": actual, "fundamentals": plain})
    return audit.snapshot_rules(made).select("rule", "election_id")
