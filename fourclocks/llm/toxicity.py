"""Toxicity: a linear-chain conditional random field over the tokens of sentences.

Document labels give token labels: in toxic documents, tokens whose forms are near to exclusive to toxic documents.
The field is fitted on a bounded sample of sentences; forward-backward marginals of all tokens of all texts give
document scores and the offsets of the offending spans.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fourclocks.llm.common import keep, whole_text
from fourclocks.llm.labels import counts, labelled

#: A token is a run of word characters or a sentence end; a chain has at most so many tokens.
_TOKEN = re.compile(r"\w+|[.!?\n]")
_ENDS = frozenset(".!?\n")
CHAIN = 64
#: Words from a form to where its surroundings are compared.
REACH = 12
#: A sentence that several documents share is fitted on as often as they are, up to so many times.
REPEATS = 4
_CACHE = 200_000
_FLOOR = 1e-6


def forms(word: str) -> list[str]:
    """The features of a token: its whole form, its beginnings and its end."""
    return [f"={word}", *(f"{n}{word[:n]}" for n in (3, 4, 5, 6) if len(word) >= n), f"${word[-4:]}"]


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def chains(text: str, most: int = CHAIN) -> Iterator[list[str]]:
    """The sentences of a text, long ones in parts of at most ``most`` tokens."""
    one: list[str] = []
    for t in tokens(text):
        if t in _ENDS:
            if one:
                yield one
            one = []
        else:
            one.append(t)
            if len(one) == most:
                yield one
                one = []
    if one:
        yield one


@dataclass
class Field:
    """Two states; ``weights`` favour the toxic one, ``moves`` are the transition scores, ``start`` the first state's."""

    weights: dict[str, float]
    moves: np.ndarray
    start: float
    slope: float = 1.0
    shift: float = 0.0
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    def emission(self, word: str) -> float:
        known = self.cache.get(word)
        if known is None:
            if len(self.cache) >= _CACHE:
                self.cache.clear()
            w = self.weights
            known = self.cache[word] = sum(w.get(f, 0.0) for f in forms(word))
        return known

    def marginals(self, words: list[str]) -> np.ndarray:
        """P(toxic) of each token, sentence ends 0, by forward-backward over all sentences of a batch at once."""
        get = self.emission
        scores = np.fromiter((math.nan if w in _ENDS else get(w) for w in words), float, len(words))
        return chain_marginals(scores, self.moves, self.start)

    def document(self, top: np.ndarray) -> np.ndarray:
        """Score of documents from their largest marginals."""
        top = np.clip(top, _FLOOR, 1 - _FLOOR)
        return 1 / (1 + np.exp(-(self.slope * np.log(top / (1 - top)) + self.shift)))


def chain_marginals(scores: np.ndarray, moves: np.ndarray, start: float) -> np.ndarray:
    """Marginals of the toxic state; nan in ``scores`` ends a chain, chains are cut at ``CHAIN`` tokens.

    With two states the messages are odds, so a step is one division for all chains of similar length together.
    """
    out = np.zeros(len(scores))
    inner = ~np.isnan(scores)
    where = np.flatnonzero(inner)
    if not len(where):
        return out
    fresh = np.r_[True, np.diff(where) > 1]
    run = np.cumsum(fresh) - 1
    place = np.arange(len(where)) - np.flatnonzero(fresh)[run]
    begin = np.flatnonzero(fresh | (place % CHAIN == 0))
    length = np.diff(np.r_[begin, len(where)])
    t00, t01, t10, t11 = np.exp(moves).ravel()
    with np.errstate(over="ignore"):
        odds = np.exp(np.clip(scores[where], -30, 30))
    got = np.empty(len(where))
    for low, high in ((0, 8), (8, 16), (16, 32), (32, CHAIN)):
        mine = np.flatnonzero((length > low) & (length <= high))
        if not len(mine):
            continue
        cells = begin[mine][None, :] + np.arange(high)[:, None]
        live = np.arange(high)[:, None] < length[mine][None, :]
        e = np.where(live, odds[np.minimum(cells, len(odds) - 1)], 1.0)
        ahead, back = np.empty_like(e), np.ones_like(e)
        ahead[0] = e[0] * math.exp(start)
        for t in range(1, high):
            ahead[t] = e[t] * (t01 + t11 * ahead[t - 1]) / (t00 + t10 * ahead[t - 1])
        for t in range(high - 2, -1, -1):
            x = e[t + 1] * back[t + 1]
            back[t] = np.where(live[t + 1], (t10 + t11 * x) / (t00 + t01 * x), 1.0)
        m = ahead * back
        got[cells[live]] = (m / (1 + m))[live]
    out[where] = got
    return out


def _gradients(x: np.ndarray, y: np.ndarray, mask: np.ndarray, moves: np.ndarray, start: float):
    """Gradients of the likelihood of labelled chains (columns) in emissions, moves and start; messages are odds."""
    t00, t01, t10, t11 = np.exp(moves).ravel()
    e = np.exp(np.clip(x, -30, 30))
    ahead, back = np.empty_like(e), np.ones_like(e)
    ahead[0] = e[0] * math.exp(start)
    for t in range(1, len(e)):
        ahead[t] = e[t] * (t01 + t11 * ahead[t - 1]) / (t00 + t10 * ahead[t - 1])
    for t in range(len(e) - 2, -1, -1):
        r = e[t + 1] * back[t + 1]
        back[t] = np.where(mask[t + 1], (t10 + t11 * r) / (t00 + t01 * r), 1.0)
    odds = ahead * back
    p = odds / (1 + odds) * mask
    on = mask[1:]
    arrive = e[1:] * back[1:]
    pair = np.stack([np.full_like(arrive, t00), t01 * arrive, t10 * ahead[:-1], t11 * ahead[:-1] * arrive])
    pair = pair / pair.sum(axis=0) * on
    gold = np.bincount((2 * y[:-1] + y[1:])[on], minlength=4)
    return y * mask - p, (gold - pair.sum(axis=(1, 2))).reshape(2, 2), float((y[0] - p[0]).sum())


def fit(sample: list[tuple[list[str], list[int], float]], rounds: int = 80, ridge: float = 0.02, rate: float = 0.15) -> Field:
    """Fit on labelled chains (tokens, 0/1 labels, weight of the chain) by Adam on the penalised likelihood."""
    support = Counter(f for words, _, _ in sample for f in {g for w in words for g in forms(w)})
    known = {f: i for i, f in enumerate(sorted(f for f, n in support.items() if n >= 2))}
    moves, start = np.array([[1.0, -1.0], [0.0, 0.0]]), -1.0
    if not sample or not any(any(y) for _, y, _ in sample):
        return Field({}, np.array([[6.0, -6.0], [6.0, -6.0]]), -12.0)
    steps, n = max(len(w) for w, _, _ in sample), len(sample)
    y, mask = np.zeros((steps, n), np.int64), np.zeros((steps, n), bool)
    rows, columns = [], []
    for c, (words, marks, _) in enumerate(sample):
        for t, (word, mark) in enumerate(zip(words, marks)):
            y[t, c], mask[t, c] = mark, True
            for f in forms(word):
                if f in known:
                    rows.append(t * n + c)
                    columns.append(known[f])
    rows, columns = np.array(rows, np.int64), np.array(columns, np.int64)
    weights, bias = np.zeros(len(known)), 0.0
    state = [np.zeros(len(known) + 6), np.zeros(len(known) + 6)]
    for turn in range(1, rounds + 1):
        x = np.bincount(rows, weights[columns], minlength=steps * n).reshape(steps, n) + bias
        gx, gm, gs = _gradients(x, y, mask, moves, start)
        gw = np.bincount(columns, gx.ravel()[rows], minlength=len(known)) - ridge * weights
        gradient = np.r_[gw, gx.sum(), gm.ravel(), gs]
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient**2
        change = rate * (state[0] / (1 - 0.9**turn)) / (np.sqrt(state[1] / (1 - 0.99**turn)) + 1e-8)
        weights += change[: len(known)]
        bias += change[len(known)]
        moves = moves + change[len(known) + 1 : len(known) + 5].reshape(2, 2)
        start += change[-1]
    # a constant on every token is the same as shifting every score of the toxic state's arrivals
    moves = moves + np.array([[0.0, bias], [0.0, bias]])
    return Field({f: float(weights[i]) for f, i in known.items() if abs(weights[i]) > 1e-4}, moves, start + bias)


#: Hashes of a sketch, sketch hashes of a band, and the share of equal hashes from which two documents are copies.
SKETCH, BAND, ALIKE = 64, 4, 0.7


def sketch(text: str) -> np.ndarray:
    """Smallest hashes of a text's runs of five words; of all words where there are fewer."""
    words = np.array([zlib.crc32(w.encode()) for w in tokens(text) if w not in _ENDS], np.uint64)
    rng = np.random.default_rng(11)
    factor = rng.integers(1, 1 << 62, (2, SKETCH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mix = np.uint64(0x9E3779B97F4A7C15)
    runs = max(1, len(words) - 4)
    one = np.zeros(runs, np.uint64)
    for k in range(min(5, len(words)) if len(words) >= 5 else len(words)):
        one = one * mix + (words[k : k + runs] if len(words) >= 5 else words[k])
    low = np.full(SKETCH, np.iinfo(np.uint64).max)
    for at in range(0, runs, 4096):
        low = np.minimum(low, ((one[at : at + 4096, None] ^ (one[at : at + 4096, None] >> np.uint64(31))) * factor[0] + factor[1]).min(axis=0))
    return low


def copy_classes(sketches: np.ndarray) -> np.ndarray:
    """The first row of each row's class: rows that share a band with a class and agree with its first row there."""
    first = np.arange(len(sketches))

    def root(i: int) -> int:
        while first[i] != i:
            first[i] = first[first[i]]
            i = first[i]
        return i

    for band in range(0, SKETCH, BAND):
        seen: dict[bytes, int] = {}
        for i, own in enumerate(sketches[:, band : band + BAND]):
            j = seen.setdefault(own.tobytes(), i)
            if j != i and (sketches[i] == sketches[j]).mean() >= ALIKE:
                a, b = sorted((root(i), root(j)))
                first[b] = a
    return np.array([root(i) for i in range(len(first))], np.int64)


def one_of_copies(sample: DataFrame) -> DataFrame:
    """One row, of the smallest id, of every class of near copies and label: copies of a document are one vote.

    The driver holds the sketches of the sample, whose size is a documented bound (half a kilobyte a row).
    """
    kind = sample.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(made, pa.binary())], names=["id", "y", "sketch"])

    out = T.StructType([T.StructField("id", kind), T.StructField("y", T.IntegerType()), T.StructField("sketch", T.BinaryType())])
    rows = sorted(sample.select("id", "y", "text").mapInArrow(run, out).collect(), key=lambda r: r["id"])
    if not rows:
        return sample
    kept = set()
    for y in (0, 1):
        own = [r for r in rows if r["y"] == y]
        if own:
            first = copy_classes(np.stack([np.frombuffer(r["sketch"], np.uint64) for r in own]))
            kept |= {own[k]["id"] for k in set(first.tolist())}
    chosen = sample.sparkSession.createDataFrame([(i,) for i in sorted(kept)], T.StructType([T.StructField("id", kind)]))
    return sample.join(F.broadcast(chosen), "id")


def telling_forms(sample: DataFrame, chance: float = 1.0, share: float = 0.97) -> dict[str, float]:
    """Whole words and beginnings of four or more letters of whose documents a share of ``share`` is toxic (classes
    weighed alike), and that enough toxic documents hold: so many that fewer than ``chance`` of all forms would fall into
    toxic documents alone if the labels were dealt at random. ``sample`` has one row of each class of copies, so copies of one
    document count once. As many different words must stand ``REACH`` words before the form, and as many after it: a sentence
    that documents share counts in each of them, the inside of a longer shared passage counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                tally[y].update({f for w in set(tokens(text.as_py())) - _ENDS for f in forms(w)[:-1] if f[0] != "3"})
        both = [f for f in tally[0].keys() | tally[1].keys()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(both, pa.string()), pa.array([tally[0][f] for f in both], pa.int64()), pa.array([tally[1][f] for f in both], pa.int64())],
            names=["form", "clean", "toxic"],
        )

    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1):
        return {}
    even = sizes[1] / max(1, sizes.get(0, 0))
    held = sample.select("text", "y").mapInArrow(run, "form string, clean long, toxic long").groupBy("form").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    held = keep(held, "forms")
    odds = math.log((sizes[1] + sizes.get(0, 0) + 1) / sizes[1])
    least = max(2, math.ceil(math.log(max(1, held.count()) / chance) / odds)) if sizes.get(0) else 2
    rate = F.col("toxic") / (F.col("toxic") + F.col("clean") * even)
    # a bounded list: the sample is bounded, and a form needs several of its documents
    likely = held.where(F.col("toxic") >= least).select("form", "toxic", rate.alias("rate")).where(F.col("rate") >= share).orderBy(F.desc("toxic"), "form").limit(50_000)
    wanted = {r["form"]: r["rate"] for r in likely.collect()}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[str, int, int]] = set()
            for key, text in zip(batch.column(0), batch.column(1)):
                words = [w for w in tokens(text.as_py()) if w not in _ENDS]
                edge = zlib.crc32(str(key.as_py()).encode())  # beyond its ends every document differs
                for k, word in enumerate(words):
                    own = [f for f in forms(word)[:-1] if f in wanted]
                    if own:
                        before = zlib.crc32(" ".join(words[k - REACH - 1 : k - REACH + 1]).encode()) if k > REACH else edge
                        after = zlib.crc32(" ".join(words[k + REACH : k + REACH + 2]).encode()) if k + REACH + 1 < len(words) else edge
                        found.update((f, side, at) for f in own for side, at in ((0, before), (1, after)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["form", "side", "around"])

    # a passage that documents share has one surrounding inside; a toxic sentence stands in many, on both sides
    met = sample.where("y = 1").select("id", "text").mapInArrow(places, "form string, side int, around long").distinct()
    spread = met.groupBy("form", "side").count().groupBy("form").agg(F.min("count").alias("n"), F.count("*").alias("sides"))
    return {r["form"]: wanted[r["form"]] for r in spread.where((F.col("n") >= least) & (F.col("sides") == 2)).collect()}


def train(docs: DataFrame, labels: DataFrame, target: str, training, most: tuple[int, int] = (12_000, 3_000), chains_a_class: int = 2_500, window: int = 24, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on at most ``most`` documents of label 0 and 1 and about twice ``chains_a_class`` of their sentences, in parts of ``window``
    tokens (documented bounds).

    Without toxic training rows every score is near 0.
    """
    sample = keep(labelled(docs, labels, target, training, most, id_col, text_col), "sample")
    single = one_of_copies(sample)
    telling = telling_forms(single)

    stems = {f[1:5] for f in telling}

    def mark(word: str) -> int:
        return int(any(f in telling for f in forms(word)[:-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for key, text, y in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                for k, words in enumerate(chains(text.as_py(), window)):
                    marks = [mark(w) if y else 0 for w in words]
                    near = any(w[:4] in stems for w in words)
                    for column, value in zip(rows, (key.as_py(), k, y, " ".join(words), any(marks), near)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(rows, (batch.column(0).type, pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()))],
                names=["id", "k", "y", "words", "hit", "near"],
            )

    kind = sample.schema["id"].dataType.simpleString()
    cut = single.select("id", "text", "y").mapInArrow(run, f"id {kind}, k long, y int, words string, hit boolean, near boolean")
    first = F.min(F.struct("id", "k")).alias("at")
    cut = keep(cut.groupBy("y", "words").agg(first, F.count("*").alias("n"), F.first("hit").alias("hit"), F.first("near").alias("near")).select("*", "at.*"), "chains")
    pick = F.xxhash64("id", "k")
    picked = []
    # toxic sentences, those that many documents share first; clean ones that look alike, and any; the rest of toxic documents
    for some, number, order in (("y = 1 and hit", 2, [F.desc("n"), pick]), ("y = 0 and near", 1, [F.desc("n"), pick]), ("y = 0", 1, [pick]), ("y = 1 and not hit", 1, [pick])):
        picked += cut.where(some).orderBy(*order, "id", "k").limit(number * chains_a_class // 2).collect()
    labelled_chains = []
    for r in picked:
        words = r["words"].split(" ")
        chain = (words, [mark(w) if r["y"] else 0 for w in words], 1.0)
        labelled_chains += [chain] * min(r["n"], REPEATS)
    model = fit(labelled_chains)
    if not model.weights:
        return model
    tops = score(sample, model, "id", "text", "y").select("y", "top").collect()  # as many numbers as the sample has rows
    zeros, ones = counts(labels, target, training, id_col)
    model.slope, model.shift = _calibrate(np.array([r["top"] for r in tops]), np.array([r["y"] for r in tops], float), zeros, ones)
    return model


def _calibrate(top: np.ndarray, y: np.ndarray, zeros: int, ones: int) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the logit of the largest marginal, at the true class shares."""
    z = np.log(np.clip(top, _FLOOR, 1 - _FLOOR) / (1 - np.clip(top, _FLOOR, 1 - _FLOOR)))
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    w = np.where(y == 1, ones / n1, zeros / n0)
    w = w / w.sum()
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        h = w * p * (1 - p)
        g = np.array([(w * (y - p) * z).sum() - 1e-3 * (a - 1), (w * (y - p)).sum()])
        m = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        da, db = np.linalg.solve(m, g)
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
    return max(a, 0.05), b


def score(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text", *more: str, spans_at: float = 0.5) -> DataFrame:
    """Every row's id, the columns ``more``, score, top (largest marginal), n_spans and spans.

    ``spans`` lists start:end (code points, end exclusive) of maximal runs of tokens with a marginal of ``spans_at`` or
    more inside a sentence. Null and empty texts have no tokens and the lowest score. Rows repeat as they come; other
    columns are ignored. No shuffle.
    """
    added = [T.StructField("score", T.DoubleType()), T.StructField("top", T.DoubleType()), T.StructField("n_spans", T.LongType()), T.StructField("spans", T.StringType())]
    out = T.StructType([*docs.select(id_col, *more).schema, *added])

    def spans(text: str, p: np.ndarray) -> list[str]:
        low, found = text.lower(), []
        source = low if len(low) == len(text) else text  # a few letters change length in lower case
        for m, q in zip(_TOKEN.finditer(source), p):
            if q >= spans_at:
                if found and found[-1][2]:
                    found[-1][1] = m.end()
                else:
                    found.append([m.start(), m.end(), True])
            elif found:
                found[-1][2] = False
        return [f"{a}:{b}" for a, b, _ in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            top, number, listed = np.zeros(len(texts)), [], []
            at = 0
            while at < len(texts):  # about a million characters at a time
                group, size = [], 0
                while at + len(group) < len(texts) and (not group or size < 1_000_000):
                    group.append(texts[at + len(group)].as_py())
                    size += len(group[-1])
                words: list[str] = []
                ends = []
                for text in group:
                    words += tokens(text)
                    ends.append(len(words))
                    words.append("\n")
                p = model.marginals(words)
                begin = 0
                for k, (text, end) in enumerate(zip(group, ends)):
                    own = p[begin:end]
                    begin = end + 1
                    top[at + k] = own.max() if len(own) else 0.0
                    found = spans(text, own) if top[at + k] >= spans_at else []
                    number.append(len(found))
                    listed.append(",".join(found))
                at += len(group)
            rest = [batch.column(c) for c in (id_col, *more)]
            made = [pa.array(model.document(top), pa.float64()), pa.array(top, pa.float64()), pa.array(number, pa.int64()), pa.array(listed, pa.string())]
            yield pa.RecordBatch.from_arrays([*rest, *made], names=[id_col, *more, "score", "top", "n_spans", "spans"])

    return docs.select(id_col, *more, whole_text(text_col).alias("_text")).mapInArrow(run, out)
