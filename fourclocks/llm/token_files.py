"""Token ids in binary files: patched frame-of-reference blocks with an index of block starts.

A file holds the ids of a run of documents in ascending document order, cut into blocks of ``BLOCK`` ids that do not care
for document ends. A block stores its minimum, every id less that minimum in as many bits as the ``SHARE`` quantile of its
values needs, and the values that need more in a list of exceptions. The last record is the index: where every block
starts, and the ids and token counts of the documents. All of it is written and read through Spark, so files may lie in
any store that Spark reaches, and a task that is lost is done again.

Layout (little-endian): records, each followed by one newline byte. Record 0 is ``MAGIC`` and the file's number (8 bytes);
then runs of whole blocks; then the index: an Arrow stream with columns key and n, the block starts (8 bytes each), the
number of ids, of the stream's bytes and of blocks (8 bytes each), ``MAGIC``. A block is minimum (4), count of ids (4),
bits (2), count of exceptions (2), packed words (8 x 8 x bits bytes), exception positions (2 each) and values (4 each).
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fourclocks.llm.common import keep, whole_text
from fourclocks.llm.packing import _tokens

MAGIC = b"PFR1"
#: Ids of a block, share of them that the width must hold, and blocks that are packed or read at once.
BLOCK, SHARE, GROUP = 512, 0.9, 2048
_HEAD, _TAIL = struct.Struct("<IIHH"), struct.Struct("<QQQ4s")
_LANES = BLOCK // 64


def pack_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """Rows of ``BLOCK`` values below ``2 ** bits`` as rows of bytes: 64 values fill ``bits`` words, lowest bits first."""
    columns = values.astype(np.uint64).reshape(-1, 64).T.copy()
    words = np.zeros((bits, columns.shape[1]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        if bits:
            words[word] |= columns[i] << np.uint64(shift)
            if shift + bits > 64:
                words[word + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(len(values), -1)


def unpack_bits(rows: np.ndarray, bits: int) -> np.ndarray:
    """The values of ``pack_bits``, as rows of ``BLOCK``."""
    if not bits:
        return np.zeros((len(rows), BLOCK), np.uint32)
    words = rows.reshape(-1).view("<u8").reshape(-1, bits).T.astype(np.uint64, order="C")
    out = np.empty((64, words.shape[1]), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        value = words[word] >> np.uint64(shift)
        if shift + bits > 64:
            value |= words[word + 1] << np.uint64(64 - shift)
        out[i] = value & mask
    return np.ascontiguousarray(out.T).reshape(len(rows), BLOCK)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of a run of ids (unsigned 32-bit); only the last one may be short."""
    if not len(ids):
        return []
    count = -(-len(ids) // BLOCK)
    padded = np.full(count * BLOCK, ids[-1], np.uint32)
    padded[: len(ids)] = ids
    rows = padded.reshape(count, BLOCK)
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    # the smallest width that holds SHARE of the block's values
    limit = np.partition(rest, int(SHARE * BLOCK) - 1, axis=1)[:, int(SHARE * BLOCK) - 1]
    bits = np.ceil(np.log2(limit.astype(np.float64) + 1)).astype(np.int64)
    cut = ((np.uint64(1) << bits.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    over = rest > cut[:, None]
    where, place = np.nonzero(over)
    bounds = np.searchsorted(where, np.arange(count + 1))
    values = rest[over].astype("<u4")
    place = place.astype("<u2")
    packed: list[np.ndarray | None] = [None] * count
    for width in np.unique(bits).tolist():
        chosen = np.flatnonzero(bits == width)
        for at, row in zip(chosen.tolist(), pack_bits(rest[chosen] & cut[chosen][:, None], width)):
            packed[at] = row
    out = []
    for k in range(count):
        a, b = bounds[k], bounds[k + 1]
        head = _HEAD.pack(int(low[k]), min(BLOCK, len(ids) - k * BLOCK), int(bits[k]), int(b - a))
        out.append(b"".join((head, packed[k].tobytes(), place[a:b].tobytes(), values[a:b].tobytes())))
    return out


def decode_blocks(content: bytes | memoryview, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at ``starts``, one after the other."""
    heads = [_HEAD.unpack_from(content, s) for s in starts.tolist()]
    if not heads:
        return np.empty(0, np.uint32)
    low, counts, bits, extra = (np.array(x, np.int64) for x in zip(*heads))
    raw = np.frombuffer(content, np.uint8)
    rows = np.empty((len(heads), BLOCK), np.uint32)
    body = starts.astype(np.int64) + _HEAD.size
    for width in np.unique(bits).tolist():
        chosen = np.flatnonzero(bits == width)
        size = _LANES * 8 * width
        taken = raw[body[chosen][:, None] + np.arange(size)]
        rows[chosen] = unpack_bits(taken, width)
    for k in np.flatnonzero(extra).tolist():
        at, n = int(body[k]) + _LANES * 8 * int(bits[k]), int(extra[k])
        rows[k, np.frombuffer(content, "<u2", n, at)] = np.frombuffer(content, "<u4", n, at + 2 * n)
    rows += low.astype(np.uint32)[:, None]
    return rows.reshape(-1) if (counts == BLOCK).all() else np.concatenate([r[:n] for r, n in zip(rows, counts.tolist())])


class FileWriter:
    """Turns documents into the records of one file; holds at most ``GROUP`` blocks of ids beside the index."""

    def __init__(self, number: int, key_type: pa.DataType) -> None:
        self.key_type = key_type
        self.at, self.total = 0, 0
        self.keys: list = []
        self.counts: list[int] = []
        self.starts: list[int] = []
        self.held: list[np.ndarray] = []
        self.size = 0
        self.opening = self._record(MAGIC + struct.pack("<q", number))

    def _record(self, raw: bytes) -> bytes:
        self.at += len(raw) + 1
        return raw

    def add(self, key, ids: np.ndarray) -> Iterator[bytes]:
        if self.opening:
            yield self.opening
            self.opening = b""
        self.keys.append(key)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= GROUP * BLOCK:
            yield from self._flush(False)

    def _flush(self, last: bool) -> Iterator[bytes]:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for at in range(0, whole, GROUP * BLOCK):
            blocks = encode_blocks(ids[at : min(whole, at + GROUP * BLOCK)])
            sizes = np.cumsum([0] + [len(b) for b in blocks])
            self.starts += (self.at + sizes[:-1]).tolist()
            yield self._record(b"".join(blocks))
        self.total += whole
        self.held, self.size = ([ids[whole:].copy()], len(ids) - whole) if whole < len(ids) else ([], 0)

    def close(self) -> Iterator[bytes]:
        if not self.keys:
            return
        yield from self._flush(True)
        sink = io.BytesIO()
        table = pa.table({"key": pa.array(self.keys, self.key_type), "n": pa.array(self.counts, pa.int64())})
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        documents = sink.getvalue()
        starts = np.array(self.starts, "<u8").tobytes()
        yield self._record(documents + starts + _TAIL.pack(self.total, len(documents), len(self.starts), MAGIC))


class FileReader:
    """Reads a file's ids: whole, by document or from any place; blocks outside the wanted range are not touched."""

    def __init__(self, content: bytes) -> None:
        self.content = memoryview(content)
        end = len(content) - 1
        if len(content) < _TAIL.size + 13 or bytes(self.content[:4]) != MAGIC:
            raise ValueError("not a token file")
        self.total, documents, blocks, magic = _TAIL.unpack_from(self.content, end - _TAIL.size)
        if magic != MAGIC:
            raise ValueError("token file without an index: it was cut")
        at = end - _TAIL.size - 8 * blocks
        self.starts = np.frombuffer(self.content, "<u8", blocks, at)
        table = pa.ipc.open_stream(self.content[at - documents : at]).read_all()
        self.keys, self.counts = table.column("key"), table.column("n").to_numpy()
        self.number = struct.unpack_from("<q", self.content, 4)[0]

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` to ``end`` (exclusive) of the file."""
        if begin >= end:
            return np.empty(0, np.uint32)
        first = begin // BLOCK
        found = decode_blocks(self.content, self.starts[first : -(-end // BLOCK)])
        return found[begin - first * BLOCK : end - first * BLOCK]

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(place in the file, part of its ids) of every document in order; long documents come in several parts."""
        ends = np.cumsum(self.counts)
        at, place, step = 0, 0, GROUP * BLOCK
        while place < len(ends):
            window = self.ids(at, min(self.total, at + step))
            begin = at
            while place < len(ends):
                stop = min(int(ends[place]), begin + len(window))
                yield place, window[at - begin : stop - begin]
                at = stop
                if stop < ends[place]:
                    break
                place += 1
                if at == begin + len(window) and place < len(ends) and ends[place] > at:
                    break


def write_files(docs: DataFrame, path: str, json_file: str, rank_file: str | None, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 1 << 25) -> None:
    """Encode all documents, each followed by ``end_id``, into files below ``path``, in ascending id order.

    Null ids come first; rows of one id by their text's hash, equal rows in any order; a null text counts as empty (its end id
    alone). Other columns are ignored. Documents are range-partitioned, so a file holds one range; files number at least the
    shuffle partitions and grow with the text, ``file_bytes`` of it each. An empty table writes no file.
    """
    spark = docs.sparkSession
    text = whole_text(text_col)
    total = docs.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // file_bytes))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = ["id", "hash", "row"]
    ordered = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("id", "text")
    kind = ordered.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        coder, tail = _tokens(json_file, rank_file, pattern), np.asarray([end_id], "<u4")
        out = FileWriter(TaskContext.get().partitionId(), to_arrow_type(kind))
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                for raw in out.add(key.as_py(), np.concatenate([coder.ids(text.as_py()), tail])):
                    yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["raw"])
        for raw in out.close():
            yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["raw"])

    # the text writer puts down the bytes as they are, and a newline after each record
    ordered.mapInArrow(run, "raw binary").select(F.col("raw").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read_files(spark: SparkSession, path: str, key_type: T.DataType, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: the id, start (ids of all documents before it), n_tokens and ids_crc32.

    The driver sees one count for each file, as it does when it lists them.
    """
    # the id under a name of its own, so that no name can clash
    inner = T.StructType([T.StructField("id", key_type)] + [T.StructField(c, T.LongType()) for c in ("number", "begin", "n_tokens", "ids_crc32")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(inner)
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                if not raw:
                    continue
                file = FileReader(raw)
                crc = [0] * len(file.counts)
                for place, part in file.documents():
                    crc[place] = zlib.crc32(part.astype("<u4").tobytes(), crc[place])
                begin = np.concatenate([[0], np.cumsum(file.counts)[:-1]])
                columns = [file.keys.combine_chunks(), pa.array([file.number] * len(crc)), pa.array(begin), pa.array(file.counts), pa.array(crc)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    found = keep(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, inner), "read-back")
    totals = found.groupBy("number").agg(F.sum("n_tokens").alias("ids")).collect()  # one row for each file
    bases, base = [], 0
    for row in sorted(totals, key=lambda r: r["number"]):
        bases.append((row["number"], base))
        base += row["ids"]
    before = spark.createDataFrame(bases, "number long, base long")
    return found.join(before, "number").select(F.col("id").alias(id_col), (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
