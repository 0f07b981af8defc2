"""Near-duplicate detection by one-permutation hashing with optimal densification.

Shingle sets are hashed once into bins; empty bins borrow from a filled bin that only the bin's number chooses. Bands of
bins are buckets. A bucket gives star-shaped candidates: pivots against members of another component, never all pairs.
A pair is only emitted if its parity sketches allow the wanted similarity, which loses nothing: flipping bit ``h mod m``
for every shingle makes the bits in which two sketches differ a lower bound of the symmetric difference.
Links are confirmed on full sets. A bucket stays open until its members are one component or each was a pivot, so a
bucket of any size is settled exactly, and pairs that a component already joins are never tested.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fourclocks.llm.common import components, keep, sieve, whole_text

_U = np.uint64
_CACHE = 300_000
_RANK = 40  # bits of the random rank by which pivots are chosen
_MORE = 16  # times as many pivots of a bucket in each round
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (fixed public constants of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word(word: bytes) -> int:
    known = _words.get(word)
    if known is None:
        if len(_words) >= _CACHE:
            _words.clear()
        known = _words[word] = xxhash.xxh3_64_intdigest(word)
    return known


def shingles(text: str, size: int) -> np.ndarray:
    """The set of ``size``-word shingles of a whole text as sorted distinct 64-bit hashes.

    A-Z are lower-cased; words are cut at blanks and U+0009 to U+000D. A shorter text is one shingle of all its words,
    one without words is empty.
    """
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, _U)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], _U)
    codes = np.fromiter(map(_word, words), _U, len(words))
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        value = codes[:n]
        for k in range(1, size):
            value = _mix(value) + codes[k : k + n]
        return np.unique(_mix(value))


@lru_cache(maxsize=4)
def _donors(bins: int) -> np.ndarray:
    """For each bin, the order in which it looks for a filled one; the same for all documents."""
    keys = np.arange(bins * bins, dtype=_U).reshape(bins, bins)
    with np.errstate(over="ignore"):
        return np.argsort(_mix(keys * _U(0x9E3779B97F4A7C15) + _U(1)), axis=1, kind="stable")


def bands(values: np.ndarray, count: int, rows: int) -> np.ndarray:
    """Bucket keys of a set: ``count`` bands of ``rows`` bins each, as signed 64-bit integers; none for an empty set."""
    bins = count * rows
    if not len(values):
        return np.empty(0, np.int64)
    place = ((values >> _U(32)) * _U(bins)) >> _U(32)  # monotone, so the first value of a bin is its smallest
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    at = place[first].astype(np.int64)
    signature, filled = np.zeros(bins, _U), np.zeros(bins, bool)
    signature[at], filled[at] = values[first], True
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _donors(bins)[empty]
        signature[empty] = signature[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    with np.errstate(over="ignore"):
        grid, key = signature.reshape(count, rows), np.arange(1, count + 1, dtype=_U)
        for r in range(rows):
            key = _mix(key * _U(0x9E3779B97F4A7C15) + grid[:, r])
    return key.view(np.int64)


def parity(values: np.ndarray) -> np.ndarray:
    """Parity sketch of a set: as many bits as the power of two at or above its size (64 at least), in signed longs."""
    bits = max(64, 1 << max(0, len(values) - 1).bit_length())
    odd = np.bincount((values & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def signatures(docs: DataFrame, size: int, count: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, digest, bands, sketch) of every row; ``digest`` names the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), size) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([bands(s, count, rows) for s in sets], pa.list_(pa.int64())),
                    pa.array([parity(s) for s in sets], pa.list_(pa.int64())),
                ],
                names=["id", "n", "digest", "bands", "sketch"],
            )

    out = T.StructType([docs.select(F.col(id_col).alias("id")).schema[0], *T._parse_datatype_string("n long, digest binary, bands array<long>, sketch array<long>")])
    return docs.select(F.col(id_col), whole_text(text_col).alias("_text")).mapInArrow(run, out)


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, count: int = 32, rows: int = 7, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: the id, n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= ``percent`` * union of their shingle sets; component_id is the
    smallest id reachable. Null and empty texts have no shingles and link with nothing. Equal sets are one node, so a
    group of copies costs one row. Rows with a null id are kept, without a component; rows that share an id are
    judged each by its own text. Candidates miss a pair at the threshold with probability (1 - s ** rows) ** count: 4e-6 at 0.85 and
    5e-4 at 0.8. Other columns are ignored; an empty table gives an empty result.
    """
    signed = keep(signatures(docs, size, count, rows, id_col, text_col), "signatures")
    some = signed.where(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = some.groupBy("digest").agg(F.min_by(F.struct("id", "n", "bands", "sketch"), "id").alias("r")).select("digest", "r.*")
    classes = keep(classes, "classes")
    spread = classes.select("id", "n", F.explode("bands").alias("bucket"))
    rank = F.pmod(F.xxhash64("id"), F.lit(1 << _RANK))
    shared = spread.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("c"), F.min(rank).alias("least"))
    shared = shared.where("lo < hi").select("bucket", "c", "least")
    members = keep(spread.join(shared, "bucket").join(classes.select("id", "sketch"), "id"), "members")
    ids = keep(members.select("id").distinct(), "holders")
    texts = sieve(docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("_text")), ids, "id")
    holders = texts.where("hit").drop("hit").join(ids, "id", "left_semi")  # the texts of other rows are not shuffled
    sets = keep(_sets(holders, size), "sets")
    links = _settle(members, sets, percent)
    reached = components(links)
    named = classes.select("digest", F.col("id").alias("rep")).join(reached, F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    return (
        signed.select("id", "n", "digest")
        .join(named, "digest", "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
            F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
        )
    )


def _sets(holders: DataFrame, size: int) -> DataFrame:
    kind = holders.schema["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shingles(t.as_py(), size).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.int64()))], names=["id", "set"])

    return holders.mapInArrow(run, T.StructType([kind, *T._parse_datatype_string("set array<long>")]))


def _apart(a: str, b: str):
    """Bits in which two sketches differ; the longer one is folded to the other's length."""

    def folded(x: str, other: str):
        half = (F.size(x) / 2).cast("int")
        short = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > F.size(other), short).otherwise(F.col(x))

    return F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda p, q: p.bitwiseXOR(q)), F.lit(0), lambda n, x: n + F.bit_count(x))


def _settle(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) that join everything the buckets can join."""
    spark = members.sparkSession
    kind = members.schema["id"].dataType.simpleString()
    links = spark.createDataFrame([], f"a {kind}, b {kind}")
    rank = F.pmod(F.xxhash64("id"), F.lit(1 << _RANK))

    def pivot(want: int):
        """The member of least rank and, by rank, about ``want`` members of the bucket."""
        return (rank == F.col("least")) | (rank / F.lit(float(1 << _RANK)) * F.col("c") < want) if want > 1 else rank == F.col("least")

    want, before, rows = 1, 0, members.withColumn("label", F.col("id"))
    while True:
        p = rows.where(pivot(want) & ~pivot(before) if before else pivot(want))
        p = p.select("bucket", F.col("id").alias("p"), F.col("n").alias("pn"), F.col("label").alias("pl"), F.col("sketch").alias("ps"))
        m = rows.where(~pivot(before)) if before else rows
        m = m.select("bucket", "id", "n", "label", "sketch", pivot(want).alias("also"))
        total = F.col("n") + F.col("pn")
        fits = F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent
        near = _apart("ps", "sketch") * (100 + percent) <= total * (100 - percent)
        once = ~F.col("also") | (F.col("p") < F.col("id"))
        pairs = p.join(m, "bucket").where((F.col("pl") != F.col("label")) & once & fits & near)
        pairs = pairs.select(F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b")).distinct()
        left, right = (sets.select(F.col("id").alias(c), F.col("set").alias(f"s{c}")) for c in "ab")
        common = F.size(F.array_intersect("sa", "sb"))
        linked = pairs.join(left, "a").join(right, "b").where(common * 100 >= (F.size("sa") + F.size("sb") - common) * percent)
        links = keep(links.unionByName(linked.select("a", "b")), "links")
        # a bucket whose members were all pivots is settled, and one whose members are one component
        rows = members.where(F.col("c") > want).join(components(links), "id", "left").withColumn("label", F.coalesce("component", "id"))
        open_ = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
        rows = keep(rows.join(open_, "bucket").select("bucket", "id", "n", "c", "least", "sketch", "label"), "open")
        if rows.isEmpty():
            return links
        before, want = want, want * _MORE
