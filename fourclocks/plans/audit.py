"""Audit of evaluation records against the source revisions that they cite.

Citations shrink to one row per revision, role and stated date before they meet the revision table, so a revision that a third
of all records cite is one row there. One full join then shows both sides: cited but unknown, known but not cited, and where
both are there, wrong roles, dates and cut-offs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourclocks.operators.contracts import violations

OWNER = ["series_id", "election_id", "forecast_as_of"]
# The fields, roles and vintage proofs of a source revision.
REVISION_FIELDS = (
    "source_url", "license", "license_url", "authority", "role", "observed_at", "released_at", "available_at", "retrieved_at", "sha256", "vintage_proof",
)
ROLES = ("fundamentals", "poll", "result")
ARCHIVE, OFFICIAL = "contemporaneous_archive", "official_release"
PROOFS = (ARCHIVE, OFFICIAL, "retrospective_compilation")


def citations(records: DataFrame) -> DataFrame:
    """One row per cited revision of a record: owner, id, role, stated (the availability that the record states) and cutoff
    (null where the revision may be newer, as results are)."""
    cut = F.col("forecast_as_of")
    polls = F.transform(
        F.arrays_zip("polling_revision_ids", "polling_snapshot_dates"),
        lambda p: F.struct(p["polling_revision_ids"].alias("id"), F.lit("poll").alias("role"), p["polling_snapshot_dates"].alias("stated"), cut.alias("cutoff")),
    )
    single = F.array(
        F.struct(F.col("fundamentals_revision_id").alias("id"), F.lit("fundamentals").alias("role"), F.col("fundamentals_available_at").alias("stated"), cut.alias("cutoff")),
        F.struct(F.col("result_revision_id").alias("id"), F.lit("result").alias("role"), F.col("result_available_at").alias("stated"), F.lit(None).cast("date").alias("cutoff")),
    )
    return records.select(*OWNER, F.explode(F.concat(single, F.coalesce(polls, F.slice(single, 1, 0)))).alias("c")).select(*OWNER, "c.*")


def revision_rules(revisions: DataFrame) -> DataFrame:
    """Broken rules of the revision table itself: (id, rule). ``object_sha256`` is the digest of the stored bytes, null where
    there are none."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    clocks = [F.col(c).cast("date") for c in ("observed_at", "released_at", "available_at", "retrieved_at")]
    absent = F.lit(False)
    for name in REVISION_FIELDS:
        absent = absent | F.col(name).isNull()
    rules = {
        "fields": ~absent,
        "digest": F.col("sha256").rlike("^[0-9a-f]{64}$"),
        "source_url": F.col("source_url").startswith("https://"),
        "license_url": F.col("license_url").startswith("https://"),
        "license": ~blank("license") & ~blank("authority"),
        "object": F.col("object_sha256").isNotNull(),
        "hash": F.col("object_sha256").isNull() | F.col("object_sha256").eqNullSafe(F.col("sha256")),
        "role_name": F.col("role").isin(*ROLES),
        "vintage_proof": F.col("vintage_proof").isin(*PROOFS),
        "chronology": (clocks[0] <= clocks[1]) & (clocks[1] <= clocks[2]) & (clocks[2] <= clocks[3]),
    }
    own = violations(revisions, ["id"], rules)
    twice = revisions.groupBy("id").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    return own.unionByName(twice.select("id", F.lit("unique").alias("rule")))


def coverage_rules(cited: DataFrame, revisions: DataFrame) -> DataFrame:
    """Broken rules between citations and revisions: id, rule and, but for unused revisions, role and stated.

    unknown, unreferenced, role, availability (the record states another date) and late (available after the cut-off).
    Repeated ids count by their first declaration; ``revision_rules`` names them.
    """
    once = revisions.groupBy("id").agg(
        F.min(F.struct(F.col("role").alias("own_role"), F.col("available_at").cast("date").alias("own_at"))).alias("r"), F.count("*").alias("declared")
    )
    used = cited.groupBy("id", "role", "stated").agg(F.min("cutoff").alias("cutoff"), F.count("*").alias("uses"))
    both = used.join(once, "id", "full").select("id", "role", "stated", "cutoff", "uses", "declared", "r.own_role", "r.own_at")
    known = F.col("uses").isNotNull() & F.col("declared").isNotNull()
    found = F.array_compact(
        F.array(
            F.when(F.col("declared").isNull(), "unknown"),
            F.when(F.col("uses").isNull(), "unreferenced"),
            F.when(known & ~F.col("own_role").eqNullSafe(F.col("role")), "role"),
            F.when(known & ~F.col("own_at").eqNullSafe(F.col("stated")), "availability"),
            F.when(known & (F.col("own_at") > F.col("cutoff")), "late"),
        )
    )
    return both.select("id", "role", "stated", "own_at", F.explode(found).alias("rule"))


def evidence_audit(records: DataFrame, revisions: DataFrame) -> DataFrame:
    """Every broken rule: rule, revision_id and the owner of the citation (null for rules of the revision alone)."""
    cited = citations(records)
    broken = coverage_rules(cited, revisions)
    owned = broken.where(F.col("rule") != "unreferenced").withColumnsRenamed({"role": "_role", "stated": "_stated", "id": "_id"})
    same = (F.col("id") == F.col("_id")) & (F.col("role") == F.col("_role")) & F.col("stated").eqNullSafe(F.col("_stated"))
    met = cited.join(owned, same).where((F.col("rule") != "late") | (F.col("own_at") > F.col("cutoff")))
    nobody = [F.lit(None).cast(records.schema[c].dataType).alias(c) for c in OWNER]
    alone = revision_rules(revisions).unionByName(broken.where(F.col("rule") == "unreferenced").select("id", "rule"))
    return met.select("rule", F.col("id").alias("revision_id"), *OWNER).unionByName(alone.select("rule", F.col("id").alias("revision_id"), *nobody))


def provenance_verified(records: DataFrame, revisions: DataFrame) -> DataFrame:
    """Per record whether polls come from archives of their time, fundamentals and results from those or official releases."""
    proofs = revisions.groupBy("id").agg(F.min("vintage_proof").alias("proof"))
    fit = F.when(F.col("role") == "poll", F.col("proof") == ARCHIVE).otherwise(F.col("proof").isin(ARCHIVE, OFFICIAL))
    return citations(records).join(proofs, "id", "left").groupBy(*OWNER).agg(F.bool_and(F.coalesce(fit, F.lit(False))).alias("provenance_verified"))


def snapshot_rules(records: DataFrame, keys: Sequence[str] = OWNER) -> DataFrame:
    """Broken rules of the snapshots of a record (``polling_snapshots``: one vector each) and of the table's dimension."""
    dates, size = F.col("polling_snapshot_dates"), F.size("polling_snapshots")
    widths = F.concat(F.array(F.size("actual"), F.size("fundamentals")), F.transform("polling_snapshots", F.size))

    def sound(vector: Column) -> Column:
        total = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x)
        return F.forall(vector, lambda x: x.between(0, 1)) & (F.abs(total - 1) <= 0.001)

    rules = {
        "two_snapshots": (size >= 2) & (size == F.size(dates)),
        "one_revision_each": (F.size("polling_revision_ids") == 0) | (F.size("polling_revision_ids") == size),
        "ordered_snapshots": F.array_sort(dates) == dates,
        "snapshot_before_cutoff": F.forall(dates, lambda d: d <= F.col("forecast_as_of")),
        "one_dimension": F.size(F.array_distinct(widths)) == 1,
        "normalised": sound(F.col("actual")) & sound(F.col("fundamentals")) & F.forall("polling_snapshots", sound),
    }
    own = violations(records, list(keys), rules)
    # the dimension of most records is the table's
    usual = records.groupBy(F.size("actual").alias("n")).agg(F.count("*").alias("c")).agg(F.max_by("n", F.struct("c", "n")).alias("usual"))
    odd = records.crossJoin(F.broadcast(usual)).where(F.size("actual") != F.col("usual"))  # one row
    return own.unionByName(odd.select(*keys, F.lit("stable_dimension").alias("rule")))
