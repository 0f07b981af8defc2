"""Ordered computations per key that never put a whole key into one task.

A key's rows are cut into segments by their order columns. Windows run inside a segment only; one
summary row per segment (a map-side combined aggregate) carries the state across segments. The
only window over a whole key sees the summaries: at most one row per segment.
Segments come from a clock (``time_segment``: one a minute, say) or from sampled splitters of the whole order tuple
(``balanced_segments``), which cut a hot second as well as a hot day. Keys and the segment column must not be null.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fourclocks.functions.text import bind

SEG = "_segment"
#: Rows that are sampled for each segment that is to come out.
SAMPLED = 32


def time_segment(clock: Column, seconds: int = 60) -> Column:
    return F.floor(F.unix_micros(clock.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def _plain(name: str, kind: T.DataType) -> tuple[Column, str]:
    """An order column as a value that survives the way through the driver, and its type."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp")), "bigint"
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("long"), "bigint"
    if isinstance(kind, T.IntegralType):
        return F.col(name).cast("long"), "bigint"
    return F.col(name), kind.simpleString()


def balanced_segments(df: DataFrame, order: Sequence[str], segments: int | None = None) -> Column:
    """Number of a row's segment: how many sampled splitters of the order tuple it does not lie before.

    The sample takes the rows of the smallest hashes of the tuple, ``SAMPLED`` for each segment (default: four segments for
    each shuffle partition), so the driver sees a bounded number of small tuples and two runs see the same ones. Splitters
    are looked up in two steps, so that a row is compared with about twice the root of their number. Order columns must be
    orderable and not null; a table of few rows has few segments.
    """
    wanted = segments or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = [_plain(c, df.schema[c].dataType) for c in order]
    names = [f"c{i}" for i in range(len(order))]
    keys = df.select(*[c.alias(n) for n, (c, _) in zip(names, plain)])
    chosen = sorted(tuple(r) for r in keys.orderBy(F.xxhash64(*names), *names).limit(SAMPLED * wanted).collect())
    splitters = [chosen[i * len(chosen) // wanted] for i in range(1, wanted)] if chosen else []
    splitters = sorted(set(splitters))
    if not splitters:
        return F.lit(0).cast("long")
    step = max(1, int(len(splitters) ** 0.5))
    shelves = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    kind = "struct<" + ", ".join(f"{n}: {k}" for n, (_, k) in zip(names, plain)) + ">"
    text = json.dumps([[dict(zip(names, s)) for s in shelf] for shelf in shelves], ensure_ascii=False)
    table = F.from_json(F.lit(text), f"array<array<{kind}>>")
    here = F.struct(*[c.alias(n) for n, (c, _) in zip(names, plain)])

    def on_shelf(at):
        """The shelf (how many begin at or before the row) and the row are looked up once for all their uses."""
        inside = F.size(F.filter(F.element_at(table, F.greatest(at["shelf"], F.lit(1))), lambda s: s <= at["row"]))
        return F.when(at["shelf"] == 0, 0).otherwise((at["shelf"] - 1) * step + inside)

    def found(row):
        return F.struct(F.size(F.filter(table, lambda s: s[0] <= row)).alias("shelf"), row.alias("row"))

    return bind(bind(here, found), on_shelf).cast("long")


def with_segment(df: DataFrame, segment: Column) -> DataFrame:
    return df.withColumn(SEG, segment)


def _segment_window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, SEG).orderBy(*order)


def _carry_window(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(SEG)


def previous_values(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, str],
    segment: Column,
) -> DataFrame:
    """Add, per ``values`` item (new name -> column), the value of the key's preceding row."""
    seg = with_segment(df, segment)
    held = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    tails = (
        seg.groupBy(*keys, SEG)
        .agg(F.max_by(held, F.struct(*order)).alias("_tail"))
        .withColumn("_carry", F.lag("_tail").over(_carry_window(keys)))
        .drop("_tail")
    )
    w = _segment_window(keys, order)
    local = seg.withColumn("_rn", F.row_number().over(w)).withColumn("_near", F.lag(held).over(w))
    joined = local.join(tails, [*keys, SEG])
    picked = joined.withColumn("_prev", F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_near")))
    return picked.select(*df.columns, *[F.col("_prev")[n].alias(n) for n in values])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, Column],
    segment: Column,
) -> DataFrame:
    """Add running sums (including the current row) of ``totals`` (new name -> summand)."""
    seg = with_segment(df, segment).withColumns({f"_x_{name}": summand for name, summand in totals.items()})
    carried = seg.groupBy(*keys, SEG).agg(*[F.sum(f"_x_{n}").alias(f"_s_{n}") for n in totals])
    before = _carry_window(keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(
        *keys, SEG, *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in totals]
    )
    w = _segment_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    local = seg.select("*", *[F.sum(f"_x_{n}").over(w).alias(f"_r_{n}") for n in totals])
    # null-safe, so that rows with a null key keep their place
    carried = carried.withColumnsRenamed({c: f"_k_{c}" for c in [*keys, SEG]})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*keys, SEG]])
    joined = local.join(carried, same)
    return joined.select(*df.columns, *[(F.col(f"_r_{n}") + F.col(f"_c_{n}")).alias(n) for n in totals])


def trailing_count(
    df: DataFrame, key: str, clock: str, seconds: int = 60, count_name: str = "hits"
) -> DataFrame:
    """Hits per key in the ``seconds`` up to each second that has hits, both ends included.

    Hits collapse to one row per (key, second) first. Each such row then also visits the next
    bucket, so a frame never has to look outside its own (key, bucket) group.
    """
    per_second = (
        df.groupBy(key, F.floor(F.col(clock).cast("timestamp").cast("double")).cast("long").alias("second"))
        .agg(F.count("*").alias("_n"))
    )
    bucket = F.floor(F.col("second") / seconds).cast("long")
    spread = per_second.withColumn("_b", F.explode(F.array(bucket, bucket + 1)))
    w = Window.partitionBy(key, "_b").orderBy("second").rangeBetween(-seconds, 0)
    return (
        spread.withColumn(count_name, F.sum("_n").over(w))
        .where(F.col("_b") == bucket)
        .select(key, "second", F.col("_n").alias("hits_in_second"), count_name)
    )
