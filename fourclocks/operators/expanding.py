"""Statistics of growing prefixes, without an array that grows with them.

Sums of a prefix are running totals over segments. An order statistic of a prefix is found in a count tree: values become
ranks of their key, ranks are numbers to the base ``FAN``, and a level of the tree counts, per node and place in the order,
how many values so far go to each child. A query walks down one digit a level. Every level is one running total over
segments, so it works on a hot key as on many small ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fourclocks.operators.segments import balanced_segments, running_totals
from fourclocks.session import cut_lineage

#: Children of a node of the count tree.
FAN = 16


def prefix_values(values: DataFrame, queries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The value of a rank among the values of a key up to a place.

    values: keys, ``at`` (long, the place) and ``value``. queries: keys, ``at``, ``id`` (long, unique) and ``rank`` (from 1,
    counted over the values at or before ``at``). Returns keys, id and value; a rank beyond the prefix finds nothing. Keys
    must not be null.
    """
    rows = cut_lineage(values.select(*keys, "at", "value", F.monotonically_increasing_id().alias("tie")))
    ranked = running_totals(rows, keys, ["value", "tie"], {"_rank": F.lit(1).cast("long")}, balanced_segments(rows, ["value", "tie"]))
    ranked = cut_lineage(ranked.withColumn("code", F.col("_rank") - 1).drop("_rank"))
    most = ranked.agg(F.max("code")).first()[0]
    if most is None:
        return queries.select(*keys, "id", F.lit(None).cast(values.schema["value"].dataType).alias("value")).limit(0)
    depth = 1
    while FAN**depth <= most:
        depth += 1
    zero = F.lit(0).cast("long").alias("_node")
    # values of a place stand before its queries
    items = ranked.select(*keys, "at", F.lit(0).alias("kind"), "tie", zero, "code", F.lit(None).cast("long").alias("rank")).unionByName(
        queries.select(*keys, "at", F.lit(1).alias("kind"), F.col("id").alias("tie"), zero, F.lit(None).cast("long").alias("code"), F.col("rank").cast("long").alias("rank"))
    )
    order = ["at", "kind", "tie"]
    items = cut_lineage(items)
    segment = balanced_segments(items, order)
    for level in range(depth):
        unit = FAN ** (depth - 1 - level)
        digit = F.floor(F.col("code") / F.lit(float(unit))) % FAN
        totals = {f"_n{d}": (F.coalesce(digit == d, F.lit(False))).cast("long") for d in range(FAN)}
        counted = running_totals(items, [*keys, "_node"], order, totals, segment)
        counts = F.array(*[F.col(f"_n{d}") for d in range(FAN)])
        sums = F.aggregate(
            counts, F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("upto")),
            lambda acc, n: F.struct((acc["sum"] + n).alias("sum"), F.concat(acc["upto"], F.array(acc["sum"] + n)).alias("upto")),
        )["upto"]
        walked = counted.withColumn("_upto", F.when(F.col("kind") == 1, sums))
        turn = F.size(F.filter("_upto", lambda n: n < F.col("rank")))  # children whose values all rank before
        below = F.when(turn > 0, F.element_at("_upto", F.greatest(turn, F.lit(1)))).otherwise(F.lit(0))
        walked = walked.withColumn("_turn", F.when(F.col("kind") == 1, turn).otherwise(digit).cast("long"))
        items = cut_lineage(
            walked.where(F.col("_turn") < FAN).select(
                *keys, "at", "kind", "tie", (F.col("_node") * FAN + F.col("_turn")).alias("_node"), "code", F.when(F.col("kind") == 1, F.col("rank") - below).alias("rank")
            )
        )
    found = items.where(F.col("kind") == 1).select(*keys, F.col("tie").alias("id"), F.col("_node").alias("code"))
    return found.join(ranked.select(*keys, "code", "value"), [*keys, "code"]).select(*keys, "id", "value")


def prefix_medians(values: DataFrame, places: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact median of the values up to each place: keys, at, median. values: keys, at, value; places: keys, at, n (how many
    values lie at or before it). A place without values has no row."""
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    asked = places.where(F.col("n") > 0).select(*keys, "at", F.explode(F.array(F.struct(F.lit(0).alias("side"), low.alias("rank")), F.struct(F.lit(1).alias("side"), high.alias("rank")))).alias("q"))
    queries = asked.select(*keys, "at", (F.col("at") * 2 + F.col("q.side")).alias("id"), F.col("q.rank").alias("rank"))
    found = prefix_values(values, queries, keys)
    return found.groupBy(*keys, F.floor(F.col("id") / 2).alias("at")).agg(F.avg("value").alias("median"))

