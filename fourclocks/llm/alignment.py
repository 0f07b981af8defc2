"""Alignment of the tokens that two tokenizers cut a text into.

Both sides tile the bytes of ``space + text``. Byte offsets where tokens of both sides end cut a document into groups. The
links, all pairs of tokens whose bytes overlap, come from an as-of search: the start of a token finds the covering token of
the other side, in both directions. Documents lie one behind the other in a frame, so one search serves them all; long ones
are cut at group ends into several parts, so a frame stays bounded whatever the length of a document (but for a single group).

Counts of id pairs over the corpus take a second pass: the first one stores for each document its distinct pairs with their
number of links, partial sums of the pairs are added up in Spark, and the table of sums comes back in slices of at most
``SLICE`` pairs, each broadcast for one pass over the stored pairs. Sums of the slices add up to the whole result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fourclocks.llm import bpe
from fourclocks.llm.common import keep, whole_text
from fourclocks.llm.packing import _RARE

#: Bytes of text that one frame aligns, pairs of ids that a broadcast slice holds, and partial sums that a task holds.
FRAME, SLICE, PARTIAL = 1 << 20, 1 << 21, 1 << 20
#: Ids of the second side stay below this factor in a pair's number.
WIDTH = 1 << 17
#: Bits of a pair's number; those above them name a document of a frame.
PAIR = 39
_BYTE = regex.compile(r"<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """The byte of every character of the byte-level alphabet: printable ones stand for themselves, others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Sides:
    """The two tokenizers: ids of a text, and the bytes of every id."""

    def __init__(self, json_file: str, rank_file: str | None, pattern: str, piece_file: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_file)
        self.exact.encode_special_tokens = True  # their strings in a text are plain text
        self.fast = bpe.encoding(rank_file, pattern) if rank_file else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        table = byte_alphabet()
        entries = [self.exact.id_to_token(i) for i in range(self.exact.get_vocab_size())]
        # entries outside the alphabet are special tokens, which no text encodes to
        self.a_bytes = [bytes(table[c] for c in e) if e is not None and all(c in table for c in e) else (e or "").encode() for e in entries]
        self.b_bytes = []
        for i in range(self.pieces.get_piece_size()):
            piece = self.pieces.id_to_piece(i)
            byte = _BYTE.fullmatch(piece)
            self.b_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        # with one table of bytes, ids of the fast coder tile a text wherever their sizes add up to it: its tokens are slices
        self.tiles = self.fast is not None and self.fast.n_vocab <= len(self.a_bytes) and all(self._same(i) for i in range(self.fast.n_vocab))
        self.a_sizes = np.array([len(b) for b in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(b) for b in self.b_bytes], np.int64)
        self.a_table, self.b_table = (np.array([*x, None], object)[:-1] for x in (self.a_bytes, self.b_bytes))  # looked up by array
        names_a, names_b = [str(i) for i in range(len(self.a_bytes))], [str(i) for i in range(len(self.b_bytes))]
        # texts of the ids with the sign that follows: within a run, after the last of a run
        self.names = np.array([n + "," for n in names_a] + [n + "|" for n in names_a] + [n + "," for n in names_b] + [n + ";" for n in names_b], object)

    def _same(self, i: int) -> bool:
        """Whether the fast coder's token of an id, if it has one, has the bytes of the other file's entry."""
        try:
            return self.fast.decode_single_token_bytes(i) == self.a_bytes[i]
        except KeyError:
            return True

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none where the text is empty or the bytes of a side are not space + text."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not text:
            return none
        spaced = " " + text
        exact = self.fast is None or _RARE.search(spaced) is not None
        if exact:
            a = self.exact.encode(spaced, add_special_tokens=False).ids
        else:
            a = bpe.encode(spaced, self.fast)
        a, b = np.asarray(a, np.int64), np.asarray(self.pieces.encode(text, num_threads=1), np.int64)
        raw = spaced.encode()
        whole = self.a_sizes[a].sum() == len(raw) if self.tiles and not exact else b"".join(self.a_table[a].tolist()) == raw
        if not whole or b"".join(self.b_table[b].tolist()) != raw:
            return none
        return a, b


@lru_cache(maxsize=2)
def _sides(json_file: str, rank_file: str | None, pattern: str, piece_file: str) -> Sides:
    return Sides(json_file, rank_file, pattern, piece_file)


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both lists of ends that occur in both, ascending."""
    size = max(a_ends[-1:].tolist() + b_ends[-1:].tolist(), default=0) + 1
    ends_a, ends_b = np.zeros(size, bool), np.zeros(size, bool)
    ends_a[a_ends], ends_b[b_ends] = True, True
    return np.flatnonzero(ends_b[a_ends]), np.flatnonzero(ends_a[b_ends])


def groups_text(a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, names: np.ndarray, a_count: int, b_count: int) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of the groups that end at the given places, in order."""
    end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    end_a[a_last], end_b[b_last] = 1, 1
    group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
    before = np.concatenate([[0], b_last + 1])  # tokens of b before a group
    until = a_last + 1  # tokens of a up to a group's end
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + before[group_a]] = a + a_count * end_a
    out[np.arange(len(b)) + until[group_b]] = 2 * a_count + b + b_count * end_b
    return "".join(names[out].tolist())[:-1]


def links(start_a: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the overlapping tokens of both sides, which tile the same bytes.

    Starts ascend over the whole frame and every part begins with a token of either side, so the token that covers a start
    is the last one of the frame that begins no later.
    """
    begins_a, begins_b = np.zeros((2, max(start_a[-1], start_b[-1]) + 1), np.int32)
    begins_a[start_a], begins_b[start_b] = 1, 1
    more = np.flatnonzero(begins_a[start_b] == 0)  # starts of b alone; pairs of equal starts come with those of a
    covered = np.cumsum(begins_b)[start_a] - 1  # the token of b that covers each start of a
    covering = np.cumsum(begins_a)[start_b] - 1
    return np.concatenate([np.arange(len(start_a)), covering[more]]), np.concatenate([covered, more])


class Frame:
    """Tokens of several documents, or parts of one, waiting to be aligned together."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.bytes = 0

    def add(self, owner: int, a: np.ndarray, b: np.ndarray, a_starts: np.ndarray, b_starts: np.ndarray, size: int) -> None:
        # starts of one frame ascend: each part begins where the one before it ends
        shift = self.bytes - int(a_starts[0])
        self.parts.append((owner, a, b, a_starts + shift, b_starts + shift))
        self.bytes += size

    def pairs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per owner: its distinct pair numbers, ascending, and their links."""
        of_part = np.array([p[0] for p in self.parts])
        place = np.cumsum(np.concatenate([[0], of_part[1:] != of_part[:-1]]))  # owners ascend; their parts are neighbours
        a, b, start_a, start_b = (np.concatenate([p[k] for p in self.parts]) for k in (1, 2, 3, 4))
        at_a, at_b = links(start_a, start_b)
        # one number holds owner and pair: a frame has fewer than 2 ** 24 owners, an id of the first side below 2 ** 22
        pair = np.repeat(place, [len(p[1]) for p in self.parts])[at_a] << PAIR | a[at_a] * WIDTH + b[at_b]
        pair.sort()
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        count = np.diff(np.concatenate([new, [len(pair)]]))
        pair = pair[new]
        bounds = np.searchsorted(pair, np.arange(place[-1] + 2) << PAIR)
        pair &= (1 << PAIR) - 1
        for owner, lo, hi in zip(of_part[np.flatnonzero(np.diff(place, prepend=-1))].tolist(), bounds, bounds[1:]):
            yield owner, pair[lo:hi], count[lo:hi]


def align(texts: list[str], sides: Sides) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
    """Per text: n_a, n_b, n_groups, n_links, groups digest, its distinct pair numbers and their links.

    Frames are filled up to ``FRAME`` bytes; results come in the order of the texts.
    """
    heads: list[list] = []
    found: list[list[tuple[np.ndarray, np.ndarray]]] = []
    frame = Frame()

    def settle() -> None:
        nonlocal frame
        if frame.parts:
            for owner, pair, count in frame.pairs():
                found[owner].append((pair, count))
        frame = Frame()

    def ready() -> Iterator[tuple]:
        for head, parts in zip(heads, found):
            if len(parts) > 1:  # a long text came in several frames
                both = np.concatenate([p[0] for p in parts])
                pair, at = np.unique(both, return_inverse=True)
                parts = [(pair, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64))]
            pair, count = parts[0] if parts else (np.empty(0, np.int64), np.empty(0, np.int64))
            yield (*head[:3], int(count.sum()), head[3], pair, count)
        heads.clear()
        found.clear()

    for text in texts:
        a, b = sides.ids(text)
        heads.append([len(a), len(b), 0, ""])
        found.append([])
        if len(a):
            a_ends, b_ends = np.cumsum(sides.a_sizes[a]), np.cumsum(sides.b_sizes[b])
            last_a, last_b = common_ends(a_ends, b_ends)
            told = groups_text(a, b, last_a, last_b, sides.names, len(sides.a_sizes), len(sides.b_sizes))
            heads[-1][2:] = [len(last_a), hashlib.sha256(told.encode()).hexdigest()]
            a_starts, b_starts = a_ends - sides.a_sizes[a], b_ends - sides.b_sizes[b]
            done_a = done_b = begin = 0
            while done_a < len(a):
                # up to the last group end inside the frame's room, one group at least
                room = begin + max(1, FRAME - frame.bytes)
                k = int(np.searchsorted(a_ends[last_a], room, side="right")) - 1
                k = max(k, int(np.searchsorted(last_a, done_a)))
                to_a, to_b, end = int(last_a[k]) + 1, int(last_b[k]) + 1, int(a_ends[last_a[k]])
                frame.add(len(heads) - 1, a[done_a:to_a], b[done_b:to_b], a_starts[done_a:to_a], b_starts[done_b:to_b], end - begin)
                done_a, done_b, begin = to_a, to_b, end
                if frame.bytes >= FRAME:
                    settle()
        if not frame.parts:
            yield from ready()
    settle()
    yield from ready()


def _sums(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pair, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return pair, np.bincount(at, np.concatenate(counts), minlength=len(pair)).astype(np.int64)


def first_pass(docs: DataFrame, files: tuple[str, str | None, str, str], id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their pairs (row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, counts), and partial sums of
    the pairs (pair, n); both written once."""
    kind = docs.select(F.col(id_col).alias("id")).schema[0]
    out = T.StructType(
        [T.StructField("row", T.LongType()), kind]
        + [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]
        + [T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.BinaryType()), T.StructField("counts", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        sides, schema = _sides(*files), to_arrow_schema(out)
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def partial() -> pa.RecordBatch:
            nonlocal size
            pair, count = _sums(*held)
            columns = [pa.nulls(1, f.type) for f in schema][:-2] + [pa.array([pair.astype("<i8").tobytes()], pa.binary()), pa.array([count.astype("<i8").tobytes()], pa.binary())]
            held[0], held[1], size = [], [], 0
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            texts = [t.as_py() for t in batch.column("_text")]
            rows, ids, at = batch.column("_row"), batch.column("_id"), 0
            results: list[tuple] = []

            def told(results: list[tuple], at: int) -> pa.RecordBatch:
                n = len(results)
                plain = [pa.array([r[k] for r in results], schema.field(2 + k).type) for k in range(5)]
                packed = [pa.array([r[5].astype("<i8").tobytes() for r in results], pa.binary()), pa.array([r[6].astype("<u4").tobytes() for r in results], pa.binary())]
                first = [rows.slice(at, n), ids.slice(at, n)]
                return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*first, *plain, *packed], schema)], schema=schema)

            for result in align(texts, sides):
                results.append(result)
                held[0].append(result[5])
                held[1].append(result[6])
                size += len(result[5])
                if size >= PARTIAL:
                    yield partial()
                if len(results) == 512:
                    yield told(results, at)
                    at, results = at + 512, []
            if results:
                yield told(results, at)
        if size:
            yield partial()

    source = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    both = keep(source.mapInArrow(run, out), "aligned")
    return both.where(F.col("row").isNotNull()), _unpacked(both.where(F.col("row").isNull()))


def _unpacked(packed: DataFrame) -> DataFrame:
    """(pair, n) rows of packed partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair, count in zip(batch.column(0), batch.column(1)):
                columns = [pa.array(np.frombuffer(x.as_py(), "<i8")) for x in (pair, count)]
                yield pa.RecordBatch.from_arrays(columns, names=["pair", "n"])

    return packed.select("pairs", "counts").mapInArrow(run, "pair long, n long")


def pair_counts(partial: DataFrame) -> DataFrame:
    """pair, n (links of the pair corpus-wide) and best (no pair of its second id has more); written once."""
    summed = partial.groupBy("pair").agg(F.sum("n").alias("n"))
    summed = keep(summed.withColumn("b", F.col("pair") % WIDTH), "pairs")
    most = summed.groupBy("b").agg(F.max("n").alias("most"))
    return keep(summed.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def weigh(coded: DataFrame, counts: DataFrame) -> DataFrame:
    """Per row of ``coded``: n_best and count_sum.

    The pair table is cut into slices by a hash so that each holds ``SLICE`` pairs or little more; a slice is collected,
    broadcast (about 17 bytes a pair) and meets all documents in one pass, and the passes' sums are added.
    """
    spark = coded.sparkSession
    slices = max(1, -(-counts.count() // SLICE))
    passes = None
    for number in range(slices):
        part = counts.where(F.pmod(F.xxhash64("pair"), F.lit(slices)) == number).toArrow()
        pair = part.column("pair").to_numpy()
        order = np.argsort(pair)
        table = spark.sparkContext.broadcast((pair[order], part.column("n").to_numpy()[order], part.column("best").to_numpy(zero_copy_only=False)[order]))
        met = coded.select("row", "pairs", "counts").mapInArrow(_meeting(table), "row long, n_best long, count_sum long")
        passes = met if passes is None else passes.unionByName(met)
    if slices == 1:
        return passes
    return passes.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def _meeting(table):
    """A pass over documents' pairs with one slice of the pair table; pairs of other slices count nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, top = table.value
        for batch in batches:
            sizes = np.array([len(x) // 8 for x in (v.as_py() for v in batch.column(1))], np.int64)
            pair = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8")
            count = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").astype(np.int64)
            best, summed = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
            if len(known) and len(pair):
                at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
                hit = known[at] == pair
                best = np.where(hit & top[at], count, 0)
                summed = np.where(hit, count * total[at], 0)
            ends = np.cumsum(sizes)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (best, summed)]
            columns = [pa.array(s[ends] - s[ends - sizes], pa.int64()) for s in sums]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", "n_best", "count_sum"])

    return run


def align_documents(docs: DataFrame, json_file: str, rank_file: str | None, pattern: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A text that is null or empty, or whose tokens of a side do not join to space + text, has no tokens: zeros, and '' for the
    digest. Repeated rows count each; a null id is carried along; other columns are ignored; an empty table gives an empty
    result.
    """
    coded, partial = first_pass(docs, (json_file, rank_file, pattern, piece_file), id_col, text_col)
    weights = weigh(coded, pair_counts(partial))
    joined = coded.select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(weights, "row")
    return joined.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
