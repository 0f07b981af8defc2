"""The corpus pipeline: toxicity, exact and near deduplication, secrets, packing. Part of the subpackage ``llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourclocks.llm import exact_dedup, minhash, queries, secrets, toxicity
from fourclocks.llm.common import keep, sieve, table
from fourclocks.llm.labels import remainder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the cut; null and empty texts stay."""
    training = remainder("doc_id", 4) != 2
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", training)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text_in"))
    scored = toxicity.score(rows, model, "_id", "_text_in", "row")
    return scored.where(F.col("score") < queries.CUT).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of texts that are equal without white space: the longest, then the smallest id, null last.

    Null texts count as empty, and empty texts are one group. Of rows that are equal in text and id exactly one stays. An empty
    table gives an empty result."""
    return exact_dedup.equal_texts(docs, payload=True).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every component of five-word shingle sets that are 0.8 or more similar, of the smallest id; rows without an
    id stay. Rows have numbers of their own, so rows that share an id are judged and dropped one by one."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id")
    own = F.struct("doc_id", F.monotonically_increasing_id().alias("n"))
    rows = keep(rows.select("row", F.when(F.col("doc_id").isNotNull(), own).alias("key")), "numbered", texts=True)  # numbers are dealt once
    gone = minhash.near_duplicates(rows.select("key", "row.text"), size=5, percent=80, id_col="key").where(~F.col("kept")).select("key")
    gone = keep(gone, "gone")
    judged = sieve(rows, gone, "key")
    doubtful = judged.where("hit").join(gone, "key", "left_anti")
    return judged.where("NOT hit").select("row.*").unionByName(doubtful.select("row.*"))  # rows without a hit stay, unshuffled


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced; ``n_chars`` follows the text. Null texts stay null, repeated rows stay."""
    return secrets.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences, a row per piece.

    A null text counts as empty and has one piece, its end id. Repeated rows and rows without an id have places of their own;
    pieces of one length take places in any order. An empty table gives an empty result."""
    return queries.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The first stage is a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; every stage's rows are written and read again before the next one."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = keep(docs, f"stage-{name}", texts=True)
    return docs
