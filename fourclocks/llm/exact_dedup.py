"""Exact deduplication by a content sort.

Sampled splitters range-partition the normalised texts, Spark's external sort puts equal texts next to each other, and
each row is compared in full with its neighbour. Splitters are drawn on a bounded key (the first characters, a hash of
the whole normalised text and a hash of the id), so the driver never sees long texts and a group of copies of any size
is cut over several partitions. Only the first and the last run of a partition can go on in another one; these at most
two runs a partition are merged by their digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fourclocks.llm.common import keep, whole_text

HEAD = 24
_SPACE = r"[\x20\x09-\x0D]+"


def _later(a: tuple, b: tuple) -> bool:
    """Whether (length, id) ``b`` is to be kept rather than ``a``: longer text first, then the smaller id, null last."""
    if a[0] != b[0]:
        return b[0] > a[0]
    return b[1] is not None and (a[1] is None or b[1] < a[1])


def _runs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Compare neighbours of one sorted partition; memory holds one batch and the rows of the open run."""
    part = TaskContext.get().partitionId()
    last: str | None = None
    run: list[pa.RecordBatch] = []  # rows of the open run
    first = True

    def judged(rows: pa.RecordBatch, keep_id, keep_chars, size, kept, digest, edge: bool) -> pa.RecordBatch:
        n = rows.num_rows
        made = {"keep_id": keep_id, "keep_chars": keep_chars, "group_size": size, "kept": kept, "text_sha256": digest}
        made |= {"part": [part] * n, "edge": [edge] * n}
        columns = [
            pa.array(made[f.name], f.type) if f.name in made else rows.column(f.name).cast(f.type) for f in schema
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def close(edge: bool) -> Iterator[pa.RecordBatch]:
        rows = [(c, i, k, at) for k, b in enumerate(run) for at, (i, c) in enumerate(zip(*(b.column(x).to_pylist() for x in ("_id", "_chars"))))]
        best = rows[0]
        for row in rows:
            if _later(best, row):
                best = row
        digest = hashlib.sha256(last.encode()).hexdigest()
        for k, b in enumerate(run):
            n = b.num_rows
            kept = [k == best[2] and at == best[3] for at in range(n)]
            yield judged(b, [best[1]] * n, [best[0]] * n, [len(rows)] * n, kept, [digest] * n, edge)

    for batch in batches:
        norms, ids, chars = (batch.column(c).to_pylist() for c in ("_norm", "_id", "_chars"))
        rows = batch.drop_columns(["_norm"])
        starts = [i for i, norm in enumerate(norms) if norm != (norms[i - 1] if i else last)]
        if not starts:
            run.append(rows)
            continue
        if starts[0]:
            run.append(rows.slice(0, starts[0]))
        if run:
            yield from close(first)
            first, run = False, []
        keep_id, keep_chars, size, kept, digest = [], [], [], [], []
        whole = starts if not first else starts[1:]  # the partition's first run is at its edge
        for lo, hi in zip(whole, whole[1:]):
            best = lo
            for i in range(lo + 1, hi):
                if _later((chars[best], ids[best]), (chars[i], ids[i])):
                    best = i
            n = hi - lo
            keep_id += [ids[best]] * n
            keep_chars += [chars[best]] * n
            size += [n] * n
            kept += [i == best for i in range(lo, hi)]
            digest += [hashlib.sha256(norms[lo].encode()).hexdigest()] * n
        if first and len(starts) > 1:
            run, last, first = [rows.slice(starts[0], starts[1] - starts[0])], norms[starts[0]], False
            yield from close(True)
        if size:
            yield judged(rows.slice(whole[0], len(size)), keep_id, keep_chars, size, kept, digest, False)
        run, last = [rows.slice(starts[-1])], norms[-1]
    if run:
        yield from close(True)


def equal_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", payload: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256; with ``payload`` also ``row``, the input row.

    Texts are equal when identical without white space (blank, U+0009 to U+000D); null counts as empty. Of equal texts
    the one with the most characters stays, then the smallest id (a null id last). Exactly one row of a group has
    ``kept``, also where rows or ids repeat. Other columns are ignored, so their names cannot clash; an empty table
    gives an empty result.
    """
    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.struct("*") if payload else F.lit(None).cast("int")).alias("_payload"),
        F.char_length(text).cast("long").alias("_chars"),
        F.regexp_replace(text, _SPACE, "").alias("_norm"),
    ).select(
        "*",
        F.substring("_norm", 1, HEAD).alias("_head"),
        F.xxhash64("_norm").alias("_hash"),
        F.xxhash64("_id", "_chars").alias("_salt"),
    )
    partitions = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(partitions, "_head", "_hash", "_salt").sortWithinPartitions("_head", "_hash", "_norm")
    kinds = {f.name: f.dataType for f in ordered.schema}
    out = T.StructType(
        [
            T.StructField("_id", kinds["_id"]),
            T.StructField("_payload", kinds["_payload"]),
            T.StructField("keep_id", kinds["_id"]),
            T.StructField("keep_chars", T.LongType()),
            T.StructField("group_size", T.LongType()),
            T.StructField("kept", T.BooleanType()),
            T.StructField("text_sha256", T.StringType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("edge", T.BooleanType()),
        ]
    )

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        return _runs(batches, to_arrow_schema(out))

    judged = keep(ordered.drop("_head", "_hash", "_salt").mapInArrow(neighbours, out), "sorted", texts=payload)
    # runs at a partition's edge: at most two a partition, merged by digest and given back to their rows
    order = F.struct((-F.col("keep_chars")).alias("n"), F.col("keep_id").isNull().alias("u"), F.col("keep_id").alias("id"), F.col("part").alias("p"))
    merged = judged.where("edge").groupBy(F.col("text_sha256").alias("m_sha")).agg(F.min(order).alias("m"), F.count("*").alias("m_size"))
    # proven bound: two rows of about 150 bytes for each partition of the sort
    joined = judged.join(F.broadcast(merged), F.col("edge") & (F.col("text_sha256") == F.col("m_sha")), "left")
    at_edge = F.col("m_size").isNotNull()
    return joined.select(
        F.col("_id").alias(id_col),
        *([F.col("_payload").alias("row")] if payload else []),
        F.when(at_edge, F.col("m.id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(at_edge, F.col("m_size")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("kept") & (~at_edge | (F.col("part") == F.col("m.p")))).alias("kept"),
        "text_sha256",
    )
