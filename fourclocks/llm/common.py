"""Shared helpers: materialised tables in the shared folder, and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fourclocks.session import shared_folder

#: The white space of the contracts: blank and U+0009 to U+000D.
WHITE = b" \t\n\x0b\x0c\r"
#: Hash bits of a sieve, as a power of two, at most.
SIEVE = 25


def keep(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors.

    The folder carries the application id, so one delete per application cleans up. Tables of whole ``texts`` are written
    as zstd, which takes much less disk than the default.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path, compression="zstd" if texts else None)
    return spark.read.schema(df.schema).parquet(path)


def fresh(spark: SparkSession, name: str) -> str:
    """The path of a folder in the shared folder that does not exist yet."""
    return f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def whole_text(column: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sieve(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``hit``: false where the key is null or no row of ``keys`` has it, true where one has it, and now and then
    where none has.

    Rows that an equi join on the key can leave alone need no shuffle then. The keys, a table that is written already, become
    hash bits, 16 a key but 2 ** ``SIEVE`` at most, in words of 64 that are broadcast: 2 ** 19 rows of two numbers at most.
    With more than two million keys more rows are hit; none is lost.
    """
    bits = min(SIEVE, max(16, (16 * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.join(F.broadcast(words), word == F.col("_word"), "left")
    hit = F.col(key).isNotNull() & (F.coalesce("_bits", F.lit(0)).bitwiseAND(bit) != 0)
    return met.withColumn("hit", hit).drop("_word", "_bits")


def components(nodes_of_edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node of ``edges`` (columns a, b), as (id, component).

    Star contraction: each round links every larger neighbour of a node, then every smaller one, to the smallest known
    neighbour, until no edge changes. A round is two aggregates and joins over the edges; nothing is collected.
    Edges of a hot node are reduced by ``min`` before the shuffle; the joins on it are left to AQE to split.
    """
    a, b = F.col("a"), F.col("b")
    edges = keep(
        nodes_of_edges.where(a != b).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct(), "edges"
    )
    state = None
    while True:
        # large star: every neighbour above a node hangs on the smallest id around that node
        around = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).groupBy("n").agg(F.min("m").alias("m"))
        large = edges.join(around, edges["lo"] == around["n"], "left").select(
            F.coalesce("m", "lo").alias("lo"), "hi"
        )
        tied = edges.join(around, edges["hi"] == around["n"]).select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        edges = keep(large.unionByName(tied).where("lo < hi").distinct(), "edges")
        # done when every edge is (root, leaf): no node is both
        check = edges.agg(F.count("*"), F.sum(F.hash("lo", "hi").cast("long"))).first()
        if check == state:
            break
        state = check
    return edges.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("component")).unionByName(
        edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    )
