"""Live forms of the operators over streams of events.

Each keeps a bounded state a device: a recording's queue, three numbers of a window, a generation.
Events of a device within a micro-batch are taken in their order; late ones beyond a watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.trace import Recorder
from ..schema import MAX_READ

RECORD_SECONDS = 3600


def recorded(reads: DataFrame, cap: int = MAX_READ, room: int = 65536) -> DataFrame:
    """(device, layer_index, offset, count, dropped): what a recording of (device, ordinal, layer_index, offset, count) lets go of.

    A record leaves when a later one can't join it; so the last of each device stays until its next read.
    The state is that last record and the numbers kept and dropped, however long the recording.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        layer, offset, count, kept, dropped = state.get if state.exists else (-1, -1, -1, 0, 0)
        own = Recorder(cap, room)
        own.dropped = dropped
        if count >= 0:
            own.queue.append([layer, offset, count])
        gone = max(0, kept - len(own.queue))
        own.room = room - gone
        for rows in sorted((r for f in frames for r in f[["ordinal", "layer_index", "offset", "count"]].itertuples(index=False)), key=lambda r: r[0]):
            own.add(int(rows[1]), int(rows[2]), int(rows[3]))
        out = own.queue[:-1]
        if own.queue:
            state.update((*own.queue[-1], gone + len(own.queue), own.dropped))
        yield pd.DataFrame([(key[0], *q, own.dropped) for q in out], columns=["device", "layer_index", "offset", "count", "dropped"])

    kind = "device long, layer_index long, offset long, count long, dropped long"
    return reads.groupBy("device").applyInPandasWithState(step, kind, "layer_index long, offset long, count long, kept long, dropped long", "append", GroupStateTimeout.NoTimeout)


def admission_window(samples: DataFrame, start: int = 4, low: int = 1, high: int = 64, step: int = 1, rise: int = 150, down: int = 50, floor: int = 1_000_000) -> DataFrame:
    """(device, samples, baseline, window) after each micro-batch of latencies (device, ordinal, nanos)."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, base, window = state.get if state.exists else (0, 0, min(max(start, low), high))
        for _, nanos in sorted((int(r[0]), max(int(r[1]), floor)) for f in frames for r in f[["ordinal", "nanos"]].itertuples(index=False)):
            if n:
                window = max(low, window * down // 100) if nanos > base * rise // 100 else min(high, window + step)
                base = (base * 7 + nanos) // 8
            else:
                base = nanos
            n += 1
        state.update((n, base, window))
        yield pd.DataFrame([(key[0], n, base, window)], columns=["device", "samples", "baseline", "window"])

    return samples.groupBy("device").applyInPandasWithState(fold, "device long, samples long, baseline long, window long", "samples long, baseline long, window long", "update", GroupStateTimeout.NoTimeout)


def in_window(events: DataFrame, starts: DataFrame, most_seconds: int = RECORD_SECONDS) -> DataFrame:
    """A stream's events (device, ts) inside each device's recording window; `starts` (device, start_ts, seconds) is a static table."""
    end = F.timestamp_seconds(F.unix_timestamp("start_ts") + F.least(F.greatest("seconds", F.lit(1)), F.lit(most_seconds)))
    return events.join(starts.withColumn("end_ts", end), "device").filter("ts >= start_ts and ts < end_ts").select(*events.columns)


def rates(reads: DataFrame, late: str = "10 seconds") -> DataFrame:
    """(device, second, bytes) of reads (device, ts, count), each second once it can't change any more."""
    sums = reads.withWatermark("ts", late).groupBy("device", F.window("ts", "1 second").alias("w")).agg(F.sum("count").alias("bytes"))
    return sums.select("device", F.col("w.start").alias("second"), "bytes")


def first_flights(fetches: DataFrame, late: str = "1 minute") -> DataFrame:
    """Fetches (key, ts, ...) without those of a key that is already on its way."""
    return fetches.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])


def current(events: DataFrame) -> DataFrame:
    """Events (device, seq, generation, ...) that are not of an earlier generation than their device has had, in order of seq."""

    names = events.columns

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else -1
        rows = pd.concat(list(frames)).sort_values("seq")
        top = rows["generation"].cummax().clip(lower=newest)
        state.update((int(top.iloc[-1]),))
        yield rows.loc[rows["generation"] >= top, names]

    return events.groupBy("device").applyInPandasWithState(keep, events.schema, "generation long", "append", GroupStateTimeout.NoTimeout)
