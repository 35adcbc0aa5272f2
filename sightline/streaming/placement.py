"""Bucket assignment by event time: each batch of events goes to the first open bucket of its index that its times overlap
and that has room, else to a new one. Late batches find an older bucket, or open one for their own time.

State is kept by (index, lane): a lane is one of several writers of an index, each with buckets of its own, so that a hot
index is dealt over as many tasks as it has lanes. Batch jobs and streams place batches by the same rule."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BATCH = ["_index", "lane", "batch", "arrival", "low", "high", "n"]
PLACED = "_index string, lane int, batch string, seq long, start_time timestamp, end_time timestamp"
STATE = "next long, starts array<long>, ends array<long>, counts array<long>, seqs array<long>, lasts array<long>"
MINUTE = 60_000_000


@dataclass(frozen=True)
class Limits:
    """Times in microseconds. start_delta: a bucket starts so long before its first event; duration: its least length; most: events
    after which it takes no batch; open: buckets of a lane, at this number the one that waited longest closes; over, idle: a bucket closes when it
    ended longer ago than `over` and had no batch for longer than `idle`."""

    start_delta: int = 10 * MINUTE
    duration: int = 60 * MINUTE
    most: int = 100_000
    open: int = 5
    over: int = 60 * MINUTE
    idle: int = 10 * MINUTE


class Lane:
    """Open buckets of one index and lane as [start, end, events, seq, last arrival]."""

    def __init__(self, limits: Limits, state: tuple | None = None):
        self.limits = limits
        self.next, self.buckets = (0, []) if state is None else (state[0], [list(b) for b in zip(*state[1:], strict=True)])

    def state(self) -> tuple:
        return (self.next, *([b[k] for b in self.buckets] for k in range(5)))

    def close(self, now: int) -> None:
        self.buckets = [b for b in self.buckets if not (b[1] < now - self.limits.over and b[4] < now - self.limits.idle)]

    def place(self, arrival: int, low: int, high: int, n: int) -> tuple[int, int, int]:
        self.close(arrival)
        fit = next((b for b in self.buckets if low <= b[1] and high > b[0] and b[2] < self.limits.most), None)
        if fit is None:
            start = low - self.limits.start_delta
            fit = [start, max(start + self.limits.duration, high), 0, self.next, arrival]
            self.buckets.append(fit)
            self.next += 1
        fit[2] += n
        fit[4] = arrival
        if len(self.buckets) >= self.limits.open:
            self.buckets.remove(min(self.buckets, key=lambda b: b[4]))
        return fit[3], fit[0], fit[1]


def _micros(x: pd.Series) -> list[int]:
    return pd.to_datetime(x, utc=True).astype("datetime64[us, UTC]").astype("int64").tolist()


def _placed(lane: Lane, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["arrival", "batch"])
    got = [lane.place(*x) for x in zip(_micros(rows["arrival"]), _micros(rows["low"]), _micros(rows["high"]), rows["n"].tolist(), strict=True)]
    times = lambda k: pd.to_datetime([g[k] for g in got], unit="us", utc=True)
    return pd.DataFrame({"_index": key[0], "lane": key[1], "batch": rows["batch"].tolist(), "seq": [g[0] for g in got], "start_time": times(1), "end_time": times(2)})


def batches_of(events: DataFrame, batch: str, arrival: str, lanes: int = 1) -> DataFrame:
    """Summaries of batches of events (_index, _time, and columns for a batch and its arrival): BATCH. lanes: writers that batches are dealt to."""
    lane = F.pmod(F.xxhash64("_index", F.col(batch)), F.lit(lanes)).cast("int") if lanes > 1 else F.lit(0)
    one = events.groupBy("_index", F.col(batch).cast("string").alias("batch")).agg(F.max(arrival).alias("arrival"), F.min("_time").alias("low"), F.max("_time").alias("high"), F.count("*").alias("n"))
    return one.withColumn("lane", lane).select(BATCH)


def place(batches: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """batches (BATCH) -> PLACED: taken in the order of arrival and name. A task takes the summaries of one index and lane."""
    return batches.select(BATCH).groupBy("_index", "lane").applyInPandas(lambda key, rows: _placed(Lane(limits), key, rows), PLACED)


def place_stream(batches: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """place over a stream of batches: open buckets are kept as state from one micro-batch to the next. Time is that of arrival, so
    buckets close when the next batch comes; a lane without more batches holds a few open ones, which cost a row of state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lane = Lane(limits, tuple(state.get) if state.exists else None)
        rows = pd.concat(frames, ignore_index=True)
        out = _placed(lane, key, rows)
        state.update(lane.state())
        yield out

    keyed = batches.select(BATCH).groupBy("_index", "lane")
    return keyed.applyInPandasWithState(step, PLACED, STATE, "append", GroupStateTimeout.NoTimeout)
