"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts inside Spark tasks. The trees are fitted on a bounded sample of labelled rows, grown
level by level from gradient histograms, and flattened into arrays that numpy walks for all rows and trees at once.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fourclocks.llm.common import whole_text
from fourclocks.llm.labels import counts, labelled

_MARKS = b"!?.,;:#$%&*@|/\\<>{}[]()\"'=+-_~^`"
_PIECE = 1 << 20  # texts are compressed in pieces of so many bytes


def statistics(text: str) -> list[float]:
    """Shares of bytes, words, lines and sentences of a whole text; an empty text has zeros."""
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * N_STATISTICS
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    words = text.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    tally = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    sentences = [x for x in text.split(".") if x.strip()]
    ends = sum(1 for w in words if not w[-1].isalnum())
    packed = sum(len(zlib.compress(raw[i : i + _PIECE], 1)) for i in range(0, n, _PIECE))
    return [
        math.log1p(n),
        math.log1p(len(words)),
        float(sizes.mean()),
        float(sizes.std()),
        float(sizes.max()),
        len(tally) / m,
        max(tally.values(), default=0) / m,
        ends / m,
        sum(1 for w in words if w.isupper()) / m,
        sum(1 for w in words if w[0].isupper()) / m,
        sum(1 for w in words if w.isdigit()) / m,
        len(lines),
        len(set(lines)) / max(1, len(lines)),
        sum(1 for x in lines if len(x) < 40) / max(1, len(lines)),
        len(set(sentences)) / max(1, len(sentences)),
        n / max(1, len(sentences)),
        packed / n,
        float(seen[65:91].sum()),
        float(seen[97:123].sum()),
        float(seen[48:58].sum()),
        float(seen[128:].sum()),
        float(seen[32]),
        float(seen[10]),
        *[float(seen[c]) for c in _MARKS],
    ]


N_STATISTICS = 23 + len(_MARKS)


@dataclass(frozen=True)
class Trees:
    """All nodes of all trees in flat arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 3.0, least: float = 5.0) -> Trees:
    """Boosted logistic trees; every level adds up gradients in (node, feature, bin) histograms."""
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)] if n else [np.empty(0)] * k
    coded = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if n else np.zeros((0, k), np.int64)
    share = float(np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)) if n else 0.5
    base = math.log(share / (1 - share))
    raw = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def new() -> int:
        for column, item in ((feature, 0), (threshold, np.inf), (value, 0.0)):
            column.append(item)
        left.append(len(feature) - 1)
        right.append(len(feature) - 1)
        return len(feature) - 1

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = weight * (p - y), weight * p * (1 - p)
        at, level = np.zeros(n, np.int64), [new()]
        roots.append(level[0])
        at[:] = level[0]
        for step in range(depth + 1):
            slot = np.full(len(feature), -1)
            slot[level] = np.arange(len(level))
            mine = np.flatnonzero(slot[at] >= 0)
            key = slot[at[mine]]
            total_g, total_h = (np.bincount(key, v[mine], minlength=len(level)) for v in (g, h))
            gain, where, cut = np.zeros(len(level)), np.zeros(len(level), int), np.zeros(len(level), int)
            if step < depth:
                for j in range(k):
                    width = len(cuts[j]) + 1
                    if width < 2:
                        continue
                    spot = key * width + coded[mine, j]
                    sg, sh = (np.bincount(spot, v[mine], minlength=len(level) * width).reshape(-1, width).cumsum(axis=1)[:, :-1] for v in (g, h))
                    rg, rh = total_g[:, None] - sg, total_h[:, None] - sh
                    better = sg**2 / (sh + ridge) + rg**2 / (rh + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                    better[(sh < least * 0.05) | (rh < least * 0.05)] = 0
                    best = better.argmax(axis=1)
                    top = better[np.arange(len(level)), best]
                    take = top > gain + 1e-9
                    gain, where, cut = np.where(take, top, gain), np.where(take, j, where), np.where(take, best, cut)
            following = []
            for i, node in enumerate(level):
                if gain[i] > 1e-3:
                    a, b = new(), new()
                    feature[node], threshold[node], left[node], right[node] = int(where[i]), float(cuts[where[i]][cut[i]]), a, b
                    rows = mine[key == i]
                    at[rows] = np.where(x[rows, where[i]] <= threshold[node], a, b)
                    following += [a, b]
                else:
                    value[node] = float(-rate * total_g[i] / (total_h[i] + ridge))
            if not following:
                break
            level = following
        raw += np.asarray(value)[at]
    arrays = (np.asarray(feature, np.int64), np.asarray(threshold), np.asarray(left, np.int64), np.asarray(right, np.int64), np.asarray(value))
    return Trees(*(a if len(a) else np.zeros(1, a.dtype) for a in arrays), np.asarray(roots, np.int64), depth + 1, base)


def document_statistics(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """id, the columns ``more`` and ``x`` (the statistics) of every row."""
    out = T.StructType([*docs.select(id_col, *more).schema, T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(t.as_py()) for t in batch.column("_text")], pa.list_(pa.float64()))
            rest = [batch.column(c) for c in (id_col, *more)]
            yield pa.RecordBatch.from_arrays([*rest, x], names=[id_col, *more, "x"])

    return docs.select(F.col(id_col), *more, whole_text(text_col).alias("_text")).mapInArrow(run, out)


def train(docs: DataFrame, labels: DataFrame, target: str, training, most: tuple[int, int] = (6_000, 6_000), id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Fit on at most ``most`` rows of label 0 and 1 (documented bounds); weights put the sample back to the true shares.

    Without labelled rows the model is a constant 0.5.
    """
    sample = labelled(docs, labels, target, training, most, id_col, text_col)
    rows = document_statistics(sample, "id", "text", "y").select("id", "y", "x").collect()  # at most ``most`` rows of numbers
    rows.sort(key=lambda r: (r["id"], r["x"]))
    y = np.array([r["y"] for r in rows], float)
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), N_STATISTICS)
    zeros, ones = counts(labels, target, training, id_col)
    got = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
    scale = len(rows) / max(1, zeros + ones)
    weight = np.where(y == 1, ones / got[1], zeros / got[0]) * scale
    return fit(x, y, weight)


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row, null and empty texts too; rows repeat as they come, other columns are ignored."""
    out = T.StructType([docs.select(id_col).schema[0], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column("_text")], float).reshape(-1, N_STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], names=[id_col, "score"])

    return docs.select(F.col(id_col), whole_text(text_col).alias("_text")).mapInArrow(run, out)
