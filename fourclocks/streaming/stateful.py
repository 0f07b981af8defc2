"""Keyed state that outlives a restart: last known good rows, bounded buffers, rates, heartbeats.

State lives in the query's checkpoint. A key's rows of one trigger are held as one number a column and row while they are
put in order, and judged in chunks; the source's trigger limits (files or offsets per trigger) bound them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SOURCE_DRIFT = "source_drift"


def use_keyed_state(spark: SparkSession) -> None:
    """Arbitrary state needs the RocksDB provider that ships with Spark."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)


#: Rows of a key that are judged at a time, once its columns are in order.
CHUNK = 1 << 16


def _columns(rows: Iterator[pd.DataFrame], names: Sequence[str]) -> list[np.ndarray]:
    """The named columns of a key's rows of a trigger, in the order of the last two.

    Frames are let go as they come: what is held is one array a column (8 bytes a row each).
    """
    parts: list[list[np.ndarray]] = [[] for _ in names]
    for frame in rows:
        for part, name in zip(parts, names):
            values = frame[name]
            part.append(values.to_numpy("datetime64[us]").astype(np.int64) if values.dtype.kind == "M" else values.to_numpy())
    columns = [np.concatenate(p) for p in parts]
    order = np.lexsort((columns[-1], columns[-2]))
    return [c[order] for c in columns]


def _frames(total: int, make: Callable[[slice], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for at in range(0, total, CHUNK):
        yield make(slice(at, min(total, at + CHUNK)))


def good_rows(votes: np.ndarray, fractions: np.ndarray, last: tuple[int, float] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows do not fall behind the last good one, and that one's votes and fraction after each row.

    While no row falls behind the running maxima of both columns, all rows are good and the maxima are the state; a chunk
    where one does is stepped through.
    """
    v, f = np.maximum.accumulate(votes), np.maximum.accumulate(fractions)
    if last is not None:
        v, f = np.maximum(v, last[0]), np.maximum(f, last[1])
    good = (votes >= v) & (fractions >= f)
    if good.all():
        return good, v, f
    best_v, best_f = (votes[0], fractions[0]) if last is None else last
    out_v, out_f, ok = [], [], []
    for one, share in zip(votes.tolist(), fractions.tolist()):
        fine = one >= best_v and share >= best_f
        if fine:
            best_v, best_f = one, share
        ok.append(fine)
        out_v.append(best_v)
        out_f.append(best_f)
    return np.array(ok, bool), np.array(out_v, votes.dtype), np.array(out_f, float)


class MonotonicResults(StatefulProcessor):
    """Keep the last known good row per key; flag rows that fall behind it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType(
            [
                T.StructField("votes", T.LongType()),
                T.StructField("reporting_fraction", T.DoubleType()),
                T.StructField("reported_us", T.LongType()),
            ]
        )
        self.good = handle.getValueState("last_known_good", schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        votes, fractions, times, ids = _columns(rows, ["votes", "reporting_fraction", "reported_at", "event_id"])
        last = self.good.get()  # none for a new key; each call is a round trip to the state store
        # rows older than the last good one of earlier triggers are behind it; from the first newer one on, time only rises
        early = 0 if last is None else int(np.searchsorted(times, last[2]))
        ok, best_v, best_f = (np.empty(len(votes), d) for d in (bool, votes.dtype, float))
        if early:
            ok[:early], best_v[:early], best_f[:early] = False, last[0], last[1]
        state = None if last is None else (last[0], last[1])
        for at in range(early, len(votes), CHUNK):
            part = slice(at, at + CHUNK)
            ok[part], best_v[part], best_f[part] = good_rows(votes[part], fractions[part], state)
            end = min(len(votes), at + CHUNK) - 1
            state = best_v[end].item(), best_f[end].item()
        if ok.any():
            newest = int(times[np.flatnonzero(ok)[-1]])
            self.good.update((int(state[0]), float(state[1]), newest))
        unit, contestant = key
        yield from _frames(
            len(votes),
            lambda s: pd.DataFrame(
                {
                    "unit_id": unit, "contestant_id": contestant, "event_id": ids[s], "accepted": ok[s], "votes": best_v[s],
                    "reporting_fraction": best_f[s], "warning": np.where(ok[s], "", SOURCE_DRIFT),
                }
            ),
        )

    def close(self) -> None:
        pass


MONOTONIC_SCHEMA = (
    "unit_id long, contestant_id string, event_id long, accepted boolean, votes long, "
    "reporting_fraction double, warning string"
)


def monotonic_results(stream: DataFrame) -> DataFrame:
    """Each row with the last known good values after it and a warning where it was refused.

    Needs unit_id, contestant_id, event_id, votes, reporting_fraction, reported_at.
    """
    return stream.groupBy("unit_id", "contestant_id").transformWithStateInPandas(
        statefulProcessor=MonotonicResults(), outputStructType=MONOTONIC_SCHEMA, outputMode="Append", timeMode="None"
    )


def newest_of_frame(frame: pd.DataFrame, key: str, size: int) -> pd.DataFrame:
    """The newest ``size`` rows of each key of a frame; ``n`` says how many rows a kept one stands for (the oldest kept one
    also for those that are left out)."""
    frame = frame.sort_values([key, "at", "event_id"], kind="stable", ignore_index=True)
    rank = frame.groupby(key, sort=False, dropna=False).cumcount(ascending=False).to_numpy()
    total = frame.groupby(key, sort=False, dropna=False)["event_id"].transform("size").to_numpy()
    kept = rank < size
    n = np.where(rank == size - 1, total - size + 1, 1)
    return frame.assign(n=n)[kept]


class LatestBuffer(StatefulProcessor):
    """Newest ``size`` events per subscriber by (published, id); older ones are dropped and counted.

    Only the buffer and one arriving frame are held: each frame is merged with what is there and cut to ``size`` again.
    """

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField("at", T.DoubleType()), T.StructField("event_id", T.LongType())]
        self.held = handle.getListState("held", T.StructType(fields))
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.held.get()) if self.held.exists() else []
        at, ids = np.array([h[0] for h in held], float), np.array([h[1] for h in held], np.int64)
        seen = self.seen.get()[0] if self.seen.exists() else 0
        for frame in rows:
            seen += int(frame["n"].sum())
            at, ids = np.concatenate([at, frame["at"].to_numpy(float)]), np.concatenate([ids, frame["event_id"].to_numpy(np.int64)])
            order = np.lexsort((ids, at))[-self.size :]
            at, ids = at[order], ids[order]
        self.held.put(list(zip(at.tolist(), ids.tolist())))
        self.seen.update((seen,))
        yield pd.DataFrame({"subscriber": [key[0]], "held": [ids.tolist()], "buffered": [len(ids)], "dropped": [seen - len(ids)]})

    def close(self) -> None:
        pass


def latest_buffer(stream: DataFrame, key: str, size: int = 100) -> DataFrame:
    """The buffer of every subscriber that a trigger brought events for, oldest first, and how many it dropped so far.

    Needs ``event_id`` and ``at`` (epoch seconds of publication). Each task cuts its frames to ``size`` rows a subscriber
    before the shuffle, so a hot one receives at most ``size`` rows a frame. Whatever order events come in, late ones too,
    the newest ``size`` by (at, event_id) stay.
    """
    kind = stream.schema[key].dataType.simpleString()

    def newest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield newest_of_frame(frame, "subscriber", size)

    cut = stream.select(stream[key].alias("subscriber"), "at", "event_id").mapInPandas(newest, f"subscriber {kind}, at double, event_id long, n long")
    return cut.groupBy("subscriber").transformWithStateInPandas(
        statefulProcessor=LatestBuffer(size),
        outputStructType=f"subscriber {kind}, held array<long>, buffered int, dropped long",
        outputMode="Update",
        timeMode="None",
    )


def allowed_hits(at: np.ndarray, recent: list[float], limit: int, seconds: float) -> tuple[np.ndarray, list[float]]:
    """Which of the ascending hits a sliding limit lets through, and the last ``limit`` accepted times.

    A hit passes unless ``limit`` accepted ones lie less than ``seconds`` before it. Refused hits are skipped in one step: the
    next one that passes is the first that lies ``seconds`` after the oldest of the last ``limit``.
    """
    allowed = np.zeros(len(at), bool)
    if limit <= 0:
        return allowed, []
    times = at.tolist()
    ring: deque[float] = deque(recent, maxlen=limit)
    i, n = 0, len(times)
    while i < n:
        if len(ring) == limit and not ring[0] <= times[i] - seconds:
            # the test is the same as a row's own, at the first place where it can hold
            i = max(i + 1, int(np.searchsorted(at - seconds, ring[0], side="left")))
            continue
        allowed[i] = True
        ring.append(times[i])
        i += 1
    return allowed, list(ring)


class AcceptedRate(StatefulProcessor):
    """Sliding limit that counts accepted hits only."""

    def __init__(self, limit: int, seconds: int) -> None:
        self.limit = limit
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hits = handle.getListState("hits", T.StructType([T.StructField("at", T.DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, ids = _columns(rows, ["at", "event_id"])
        recent = [row[0] for row in self.hits.get()] if self.hits.exists() else []
        flags = np.empty(len(at), bool)
        for begin in range(0, len(at), CHUNK):
            part = slice(begin, begin + CHUNK)
            flags[part], recent = allowed_hits(at[part], recent, self.limit, self.seconds)
        self.hits.put([(x,) for x in recent])
        yield from _frames(len(at), lambda s: pd.DataFrame({"client": key[0], "event_id": ids[s], "allowed": flags[s]}))

    def close(self) -> None:
        pass


def accepted_rate(stream: DataFrame, key: str, limit: int = 120, seconds: int = 60) -> DataFrame:
    """Per hit whether it was allowed. Needs event_id and ``at`` in epoch seconds."""
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=AcceptedRate(limit, seconds),
        outputStructType="client long, event_id long, allowed boolean",
        outputMode="Append",
        timeMode="None",
    )


class Heartbeat(StatefulProcessor):
    """Emit a heartbeat when a key stays silent; events themselves pass through."""

    def __init__(self, seconds: int) -> None:
        self.milliseconds = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", T.StructType([T.StructField("at", T.LongType())]))

    def _arm(self, now: int) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        self.due.update((now + self.milliseconds,))
        self.handle.registerTimer(now + self.milliseconds)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        count = sum(len(frame) for frame in rows)
        self._arm(timerValues.getCurrentProcessingTimeInMs())
        yield pd.DataFrame({"subscriber": [key[0]], "kind": ["events"], "n": [count]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        self._arm(timerValues.getCurrentProcessingTimeInMs())
        yield pd.DataFrame({"subscriber": [key[0]], "kind": ["heartbeat"], "n": [0]})

    def close(self) -> None:
        pass


def heartbeats(stream: DataFrame, key: str, seconds: int = 20) -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=Heartbeat(seconds),
        outputStructType="subscriber long, kind string, n long",
        outputMode="Append",
        timeMode="ProcessingTime",
    )
