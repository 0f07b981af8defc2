"""Best-fit packing of token sequences with certified bin counts.

Documents become pieces of at most ``width`` tokens. Full pieces are sequences of their own; the others are dealt over
partitions and packed best-fit decreasing. Dual feasible functions give a lower bound on the bins that a partition's
pieces need; where the packing meets it, the partition is certified. Partitions with a gap exchange the documents of
their unfilled bins and pack them again, as long as the total falls. Then the bound of all pieces together decides: while
it shows a gap, the unfilled bins of certified partitions are exchanged as well.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fourclocks.llm import bpe
from fourclocks.llm.common import keep, whole_text

#: Characters whose class may differ between releases of the two tokenizer libraries, and what may be a special token.
_RARE = regex.compile(r"[\x1C-\x1F\U00010000-\U0010FFFF]|<\|")


class Tokens:
    """Ids of the ``tokenizers`` file; tiktoken with the same vocabulary does the texts on which both agree by rule."""

    def __init__(self, json_file: str, rank_file: str | None, pattern: str) -> None:
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_file)
        self.fast = bpe.encoding(rank_file, pattern) if rank_file else None

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or _RARE.search(text):
            return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return bpe.encode(text, self.fast)


@lru_cache(maxsize=2)
def _tokens(json_file: str, rank_file: str | None, pattern: str) -> Tokens:
    return Tokens(json_file, rank_file, pattern)


def cut(length: int, width: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a sequence: all full but the first, which takes what is over."""
    head = length % width or min(length, width)
    return [(0, head)] + [(s, width) for s in range(head, length, width)]


def document_pieces(
    docs: DataFrame,
    json_file: str,
    rank_file: str | None,
    pattern: str,
    end_id: int,
    width: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked, its ids.

    A document is its token ids and then ``end_id``; null text counts as empty, so each row has at least one piece.
    Repeated rows stay apart, a null id is carried along, other columns are ignored.
    """
    fields = [docs.select(F.col(id_col).alias("id")).schema[0], T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    fields += [T.StructField("ids", T.BinaryType())] if with_ids else []
    out = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        coder, schema, tail = _tokens(json_file, rank_file, pattern), to_arrow_schema(out), np.asarray([end_id], "<u4")
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for key, text in zip(batch.column(0), batch.column(1)):
                raw = np.concatenate([coder.ids(text.as_py()), tail]).tobytes()
                for k, (start, n) in enumerate(cut(len(raw) // 4, width)):
                    part = raw[4 * start : 4 * (start + n)]
                    for column, value in zip(rows, (key.as_py(), k, start, n, zlib.crc32(part), part)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, schema)], schema=schema)

    return docs.select(F.col(id_col), whole_text(text_col).alias("_text")).mapInArrow(run, out)


def best_fit(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: the bin and the offset of each size, and the number of bins.

    Bins wait in a stack for each room that is left; a bit mask of the rooms in use finds the tightest fit.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(width + 1)]
    mask, count = 0, 0
    for i in order.tolist():
        size = int(sizes[i])
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
        else:
            room, chosen, count = width, count, count + 1
        bins[i], offsets[i] = chosen, width - room
        left = room - size
        if left:
            if not stacks[left]:
                mask |= 1 << left
            stacks[left].append(chosen)
    return bins, offsets, count


def lower_bound(sizes: np.ndarray, width: int) -> int:
    """The largest bound of three families of dual feasible functions over all their parameters.

    Sizes are summed as a histogram, so the work is bounded by width squared: (a) identity, (b) drop sizes below k and
    round sizes above width - k up to a whole bin, (c) floor((m + 1) * size / width) with exact fits kept, for small m.
    """
    return counted_bound(np.bincount(sizes, minlength=width + 1).astype(np.int64), width) if len(sizes) else 0


def counted_bound(count: np.ndarray, width: int) -> int:
    """The same of a histogram: ``count[s]`` pieces of size s, 0 to ``width``."""
    size = np.arange(width + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // width)
    above = np.cumsum(count[::-1])[::-1]  # pieces of at least so many tokens
    weight = np.cumsum((count * size)[::-1])[::-1]
    for k in range(1, width // 2 + 1):
        large = int(above[width - k + 1]) if width - k + 1 <= width else 0
        middle = int(weight[k]) - (int(weight[width - k + 1]) if width - k + 1 <= width else 0)
        best = max(best, large + -(-middle // width))
    for m in range(1, 64):
        scaled = (m + 1) * size
        value = np.where(scaled % width == 0, scaled * m // (m + 1), (scaled // width) * width)  # times width / m
        best = max(best, -(-int((count * value).sum()) // (m * width)))
    return best


def pack(pieces: DataFrame, width: int, rounds: int = 3, per_partition: int = 20_000) -> DataFrame:
    """Add sequence_id and offset to pieces (any columns, with ``length`` between 1 and ``width``).

    A partition packs about ``per_partition`` pieces; their keys are hashes, so no document, source or group is hot.
    Each round deals the pieces of unfilled bins anew over fewer partitions, first of those with a gap, then of all while
    the joint bound is not met, and is accepted only where bins are saved. Sequence numbers are unique over all.
    Ties and repeated rows get places of their own; an empty table gives an empty result.
    """
    full = F.col("length") == width
    base = keep(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    todo = base.where(~full).select("_row", "length")
    sizes = np.zeros(width + 1, np.int64)
    for r in todo.groupBy("length").count().collect():  # at most ``width`` rows
        sizes[r["length"]] = r["count"]
    joint = counted_bound(sizes, width)
    schema = "_row long, length long, turn int, part int, bin long, offset long, used long, gap long"

    def dealt(rows: DataFrame, count: int, turn: int) -> DataFrame:
        parts = max(1, -(-count // (per_partition * 2**turn)))

        def fill(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["length", "_row"], ascending=[False, True], ignore_index=True)
            own = frame["length"].to_numpy(np.int64)
            bins, offsets, made = best_fit(own, width)
            used = np.bincount(bins, own, minlength=made).astype(np.int64)
            places = {"_row": frame["_row"], "length": own, "turn": np.int32(turn), "part": np.int32(key[0]), "bin": bins, "offset": offsets}
            return pd.DataFrame({**places, "used": used[bins], "gap": np.int64(made - lower_bound(own, width))})

        salted = rows.select("_row", "length", F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(parts)).cast("int").alias("part"))
        return keep(salted.repartition(parts, "part").groupBy("part").applyInPandas(fill, schema), "packed")

    def bins_of(rows: DataFrame) -> int:
        return rows.where(F.col("offset") == 0).count()

    placed, turn, together = dealt(todo, int(sizes.sum()), 0), 0, False
    while turn < rounds and bins_of(placed) > joint:
        loose = F.col("used") < width
        loose = loose if together else loose & (F.col("gap") > 0)
        again = placed.where(loose)
        n = again.count()
        retry = dealt(again, n, turn + 1) if n else None
        turn += n > 0
        if n and bins_of(retry) < bins_of(again):
            placed = placed.where(~loose).unionByName(retry)
        elif together:
            break
        else:
            together = True
    # sequence numbers: turn and partition above, bin below; full pieces take the negative numbers
    number = F.shiftleft(F.col("turn").cast("long"), 58) + F.shiftleft(F.col("part").cast("long"), 28) + F.col("bin")
    placed = placed.select("_row", number.alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
    shared = base.where(~full).join(placed, "_row")
    alone = base.where(full).select("*", (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(alone).drop("_row")
