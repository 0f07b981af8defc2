"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are cut before encoding, at places where every split pattern of this family ends a match whatever follows:
after a letter that a character of another ASCII class follows, and before the last character of a long run of white
space. Pieces therefore encode to the same ids as the whole text, and no call sees an unbounded one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fourclocks.llm.common import whole_text

#: Characters from which on a text is cut, and the white-space run that is encoded as one piece of its own.
LONG, RUN = 65_536, 4_096
#: A letter, then an ASCII character that can neither continue its match nor belong to it.
_SAFE = regex.compile(r"(?<=[A-Za-z])(?=[\x09-\x0D\x20-\x40\x5B-\x60\x7B-\x7E])")
_SPACES = regex.compile(r"[\x09-\x0D\x20]{%d,}" % RUN)


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (lines of base64 token and rank); one per Python worker."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(rank_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[tuple[str, bool]]:
    """Consecutive parts of a text that encode independently; True marks a run of white space that is one match."""
    at = 0
    for run in _SPACES.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        begin = run.start()
        if begin and text[begin - 1].isspace():  # other white space before it belongs to the same match: not one piece
            continue
        if end < len(text) and text[run.end() : run.end() + 1].isspace():
            continue
        yield from ((part, False) for part in _cut(text[at:begin]))
        yield text[begin:end], True
        at = end
    yield from ((part, False) for part in _cut(text[at:]))


def _cut(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > LONG:
        place = _SAFE.search(text, at + LONG)
        if place is None:
            break
        yield text[at : place.start()]
        at = place.start()
    if at < len(text):
        yield text[at:]


def encode(text: str, coder: tiktoken.Encoding) -> np.ndarray:
    """Ids of a whole text as little-endian unsigned 32-bit integers, special tokens never used."""
    if len(text) <= RUN:
        return np.asarray(coder.encode_ordinary(text), dtype="<u4")
    out = [
        coder._encode_single_piece(part) if run else coder.encode_ordinary(part)  # noqa: SLF001
        for part, run in pieces(text)
    ]
    return np.concatenate([np.asarray(ids, dtype="<u4") for ids in out]) if out else np.empty(0, "<u4")


def decode(ids: np.ndarray, coder: tiktoken.Encoding) -> bytes:
    """The raw bytes of the ids; they need not be valid UTF-8 where a sequence was cut."""
    return coder.decode_bytes(ids.tolist())


def encode_documents(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """Per row: the id, ``ids`` (binary, little-endian unsigned 32-bit; if asked), n_tokens and two digests.

    The digests are those of the id bytes and of the bytes that the ids decode to. A null text counts as empty (no ids);
    repeated rows stay; other columns are ignored; an empty table gives an empty result. No shuffle.
    """
    out = T.StructType(
        [docs.select(F.col(id_col).alias(id_col)).schema[0]]
        + ([T.StructField("ids", T.BinaryType())] if with_ids else [])
        + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        coder, schema = encoding(rank_file, pattern), to_arrow_schema(out)
        for batch in batches:
            coded, counts, first, second = [], [], [], []
            for text in batch.column(1):
                ids = encode(text.as_py(), coder)
                raw = ids.tobytes()
                if with_ids:
                    coded.append(raw)
                counts.append(len(ids))
                first.append(hashlib.sha256(raw).hexdigest())
                second.append(hashlib.sha256(decode(ids, coder)).hexdigest())
            columns = [batch.column(0), *([pa.array(coded, pa.binary())] if with_ids else []), counts, first, second]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
            )

    return docs.select(F.col(id_col), whole_text(text_col).alias("_text")).mapInArrow(run, out)


def decode_documents(coded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: the id and ``bytes``, the raw bytes of the id sequence in ``ids_col`` (null gives null)."""
    out = T.StructType([coded.select(F.col(id_col)).schema[0], T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(rank_file, pattern)
        for batch in batches:
            raw = [None if x is None else decode(np.frombuffer(x, "<u4"), coder) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=[id_col, "bytes"])

    return coded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, out)
