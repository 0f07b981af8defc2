"""Views that turn the order, customer and event tables into the operators' domain inputs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourclocks.functions.shares import remainder_seats

CONTESTANTS = ("A", "N", "R")
PARTIES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
POLL_CUTOFF = "1998-06-30 00:00:00"
EVENT_CUTOFF = "2024-01-20 12:00:00"
MODES = {"1-URGENT": "live_phone", "2-HIGH": "mixed", "3-MEDIUM": "online", "4-NOT SPECIFIED": "ivr"}


def ts(text: str):
    return F.lit(text).cast("timestamp")


class Tables:
    """Lazy handles on the parquet tables of one folder, and the domain views over them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    # polls -------------------------------------------------------------------------------

    @cached_property
    def poll_amounts(self) -> DataFrame:
        """Quantities per order and flag, as columns; partial sums absorb a hot order."""
        flag, qty = F.col("l_returnflag"), F.col("l_quantity")
        return self.lineitem.groupBy(F.col("l_orderkey").alias("poll_id")).agg(
            *[F.sum(F.when(flag == c, qty).otherwise(0.0)).alias(f"q{c}") for c in CONTESTANTS],
            F.sum(qty).alias("sample_size"),
            F.count("*").alias("lines"),
        )

    @cached_property
    def poll_headers(self) -> DataFrame:
        mode = F.lit("unknown")
        for key, value in MODES.items():
            mode = F.when(F.col("o_orderpriority") == key, value).otherwise(mode)
        day = F.col("o_orderdate").cast("date")
        available = F.date_add(day, (F.col("o_orderkey") % 14).cast("int"))
        customers = self.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
        return self.orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("poll_id"),
            F.col("c_nationkey").alias("election_id"),
            F.col("o_custkey").alias("pollster"),
            mode.alias("mode"),
            day.alias("fieldwork_end"),
            available.cast("timestamp").alias("available_at"),
            F.col("c_mktsegment").alias("sponsor"),
            F.col("o_orderpriority").alias("scenario_id"),
        )

    @cached_property
    def polls(self) -> DataFrame:
        shares = [F.col(f"q{c}") / F.col("sample_size") for c in CONTESTANTS]
        return (
            self.poll_headers.join(self.poll_amounts, "poll_id")
            .withColumn("shares", F.array(*shares))
            .drop(*[f"q{c}" for c in CONTESTANTS])
        )

    @cached_property
    def poll_results(self) -> DataFrame:
        """Long detail; a contestant without quantity has no row."""
        grouped = self.lineitem.groupBy(
            F.col("l_orderkey").alias("poll_id"), F.col("l_returnflag").alias("contestant_id")
        ).agg(F.sum("l_quantity").alias("qty"))
        totals = self.poll_amounts.select("poll_id", "sample_size")
        return grouped.join(totals, "poll_id").select(
            "poll_id", "contestant_id", (F.col("qty") / F.col("sample_size")).alias("share")
        )

    @cached_property
    def house_effects(self) -> DataFrame:
        """Pollsters of one sponsor lean to the first contestant."""
        return self.customer.where(F.col("c_mktsegment") == "BUILDING").select(
            F.col("c_custkey").alias("pollster"),
            F.array(F.lit(0.02), F.lit(-0.02), F.lit(0.0)).alias("effect"),
        )

    # observations, feed, runs --------------------------------------------------------------

    @cached_property
    def observations(self) -> DataFrame:
        clock = F.col("ts").cast("timestamp")
        return self.events.select(
            F.col("event_id").alias("revision_id"),
            F.col("user_id").alias("jurisdiction_id"),
            F.col("event_type").alias("metric"),
            "value",
            F.date_trunc("day", clock).alias("observed_at"),
            clock.alias("available_at"),
            (clock + F.make_dt_interval(mins=(F.col("event_id") % 60).cast("int"))).alias("retrieved_at"),
            F.get_json_object("props", "$.k").cast("int").alias("revision"),
        )

    @cached_property
    def feed(self) -> DataFrame:
        """Result feed as reported: the value stands for a vote count that may fall back."""
        return self.events.select(
            F.col("event_id"),
            F.col("user_id").alias("unit_id"),
            F.col("event_type").alias("contestant_id"),
            F.floor("value").cast("long").alias("votes"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
            F.col("ts").cast("timestamp").alias("reported_at"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        return self.events.select(
            "event_id",
            F.col("event_type").alias("job"),
            (F.col("user_id") % 10).alias("scope"),
            F.col("ts").cast("timestamp").alias("occurred_at"),
            F.when(F.col("value") < 5, "failure").otherwise("success").alias("status"),
            "value",
            "user_id",
        )

    # votes and draws -------------------------------------------------------------------------

    @cached_property
    def votes(self) -> DataFrame:
        """Votes per nation and segment; orders shrink to one row per customer before the join."""
        per_customer = self.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
        index = F.lit(len(PARTIES))
        for i, p in enumerate(PARTIES):
            index = F.when(F.col("party") == p, F.lit(i)).otherwise(index)
        return (
            self.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
            .join(per_customer, "c_custkey")
            .groupBy(F.col("c_nationkey").alias("contest_id"), F.col("c_mktsegment").alias("party"))
            .agg(F.sum("n").alias("votes"))
            .withColumn("seats", F.col("contest_id") + 10)
            .withColumn("party_index", index)
        )

    @cached_property
    def draws(self) -> DataFrame:
        """One draw per order: shares by flag, seats by largest remainder, turnout by fill."""
        shares = [F.col("shares")[i] for i in range(len(CONTESTANTS))]
        seats_total = F.col("election_id") + 10
        return self.polls.select(
            F.col("poll_id").alias("run_id"),
            "election_id",
            "scenario_id",
            "shares",
            F.array(*remainder_seats(shares, seats_total)).alias("seats"),
            (F.floor(seats_total / 2) + 1).cast("int").alias("majority"),
            (F.col("sample_size") / (F.col("lines") * 50.0)).alias("turnout"),
        )

    # election history ------------------------------------------------------------------------

    @cached_property
    def order_amounts(self) -> DataFrame:
        """Revenue per order and flag: the one pass over the fact tables behind the history.

        Lines shrink to one row per order before the join.
        """
        flag, price = F.col("l_returnflag"), F.col("l_extendedprice")
        per_order = self.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            *[F.sum(F.when(flag == c, price).otherwise(0.0)).alias(f"v{c}") for c in CONTESTANTS]
        )
        dated = self.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
        return dated.join(per_order, "o_orderkey").drop("o_orderkey")

    @cached_property
    def daily_amounts(self) -> DataFrame:
        """Revenue per order date and flag; the result is bounded by the calendar."""
        return self.order_amounts.groupBy("day").agg(*[F.sum(f"v{c}").alias(f"v{c}") for c in CONTESTANTS])

    @cached_property
    def daily_amounts_by_nation(self) -> DataFrame:
        """The same with a series for each nation; days of a customer shrink to one row before the join."""
        per_customer = self.order_amounts.groupBy("o_custkey", "day").agg(*[F.sum(f"v{c}").alias(f"v{c}") for c in CONTESTANTS])
        nations = self.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("series_id"))
        return per_customer.join(nations, "o_custkey").groupBy("series_id", "day").agg(*[F.sum(f"v{c}").alias(f"v{c}") for c in CONTESTANTS])
