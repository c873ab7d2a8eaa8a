"""Writable upper layers: allocation, discards, compaction, admission and recovery of logs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..schema import DATA_START, MAX_LENGTH, MAX_LOG
from . import intervals, overlay


def discards(ranges: DataFrame, cap: int = MAX_LENGTH) -> DataFrame:
    """Zero records of discarded ranges, none longer than the format allows."""
    return intervals.split(ranges.withColumn("zeroed", F.lit(True)), cap)


def compacted(log: DataFrame, dialect: str = "plain") -> DataFrame:
    """A fresh log of the live view: maximal runs that are also contiguous in the layer, numbered by offset."""
    live = intervals.coalesce(overlay.replay(log, dialect).select("device", "offset", "length", "moffset", "zeroed"))
    order = W.Window.partitionBy("device").orderBy("offset")
    return intervals.split(live).withColumn("seq", F.row_number().over(order).cast("long"))


def compaction_due(log: DataFrame, live: DataFrame, least: int = 4096) -> DataFrame:
    """(device, records, threshold, due): a log is compacted from max(least, twice its live segments and 16) records on."""
    sizes = log.groupBy("device").agg(F.count("*").alias("records")).join(live.groupBy("device").agg(F.count("*").alias("live")), "device", "left")
    threshold = F.greatest(F.lit(least), F.coalesce("live", F.lit(0)) * 2 + 16)
    return sizes.select("device", "records", threshold.cast("long").alias("threshold"), (F.col("records") >= threshold).alias("due"))


def admitted(log: DataFrame, room: int = MAX_LOG) -> DataFrame:
    """Records that still fit a log's room, in order."""
    order = W.Window.partitionBy("device").orderBy("seq")
    return log.withColumn("rank_", F.row_number().over(order)).filter(F.col("rank_") <= room).drop("rank_")


def usable_prefix(stamps: DataFrame) -> DataFrame:
    """(device, generation, bytes) from stamps (device, generation, bytes, verified, committed): the longest verified prefix, else the committed one."""
    out = stamps.groupBy("device", "generation").agg(F.max(F.when(F.col("verified"), F.col("bytes"))).alias("v"), F.max(F.when(F.col("committed"), F.col("bytes"))).alias("c"))
    return out.select("device", "generation", F.coalesce("v", "c").alias("bytes")).filter("bytes is not null")


def resized(requests: DataFrame) -> DataFrame:
    """Resizes (device, ordinal, size) in order with accepted and the size after: none shrinks a device, an equal one changes nothing."""
    order = W.Window.partitionBy("device").orderBy("ordinal")
    before = F.max("size").over(order.rowsBetween(W.Window.unboundedPreceding, -1))
    now = F.max("size").over(order.rowsBetween(W.Window.unboundedPreceding, 0))
    return requests.withColumn("accepted", F.col("size") >= F.coalesce(before, F.lit(0))).withColumn("now", now)


class Upper:
    """One device's writable layer: which sectors it owns and where; a fold, as each write's places depend on the writes before."""

    def __init__(self, start: int = DATA_START):
        self.end = start
        self.starts: list[int] = []
        self.segments: dict[int, tuple[int, int, bool]] = {}  # start: (length, place, zeroed)

    def _touching(self, low: int, high: int) -> list[tuple[int, int, int, bool]]:
        i = max(0, int(np.searchsorted(self.starts, low, "right")) - 1)
        out = []
        while i < len(self.starts) and self.starts[i] < high:
            a = self.starts[i]
            n, place, zeroed = self.segments[a]
            if a + n > low:
                out.append((a, n, place, zeroed))
            i += 1
        return out

    def _replace(self, low: int, high: int, fresh: list[tuple[int, int, int, bool]]) -> None:
        for a, n, place, zeroed in self._touching(low, high):
            at = int(np.searchsorted(self.starts, a))
            del self.starts[at]
            del self.segments[a]
            if a < low:
                fresh.append((a, low - a, place, zeroed))
            if a + n > high:
                fresh.append((high, a + n - high, place if zeroed else place + high - a, zeroed))
        for a, n, place, zeroed in fresh:
            self.starts.insert(int(np.searchsorted(self.starts, a)), a)
            self.segments[a] = (n, place, zeroed)

    def write(self, offset: int, length: int) -> list[tuple[int, int, int, bool]]:
        """(offset, length, place, in_place) of each part: data that is there is written in place, all else is appended."""
        out = []
        for low in range(offset, offset + length, MAX_LENGTH):
            high, at = min(low + MAX_LENGTH, offset + length), low
            parts: list[tuple[int, int, int, bool]] = []
            for a, n, place, zeroed in self._touching(low, high):
                if zeroed:
                    continue
                if a > at:
                    parts.append((at, a - at, self.end, False))
                    self.end += a - at
                begin, end = max(at, a), min(a + n, high)
                parts.append((begin, end - begin, place + begin - a, True))
                at = end
            if at < high:
                parts.append((at, high - at, self.end, False))
                self.end += high - at
            if not all(p[3] for p in parts):
                self._replace(low, high, [(a, n, place, False) for a, n, place, _ in parts])
            out += parts
        return out

    def discard(self, offset: int, length: int) -> None:
        for low in range(offset, offset + length, MAX_LENGTH):
            high = min(low + MAX_LENGTH, offset + length)
            self._replace(low, high, [(low, high - low, DATA_START, True)])


def allocated(requests: DataFrame, start: int = DATA_START) -> DataFrame:
    """(device, seq, offset, length, moffset, in_place) of writes and discards (device, seq, offset, length, zeroed): where each part goes.

    A device's requests stream through one task in order (sorted within partitions, so they spill);
    memory holds its live segments, at most a million by the format.
    """

    def run(batches):
        device, upper = None, Upper(start)
        for batch in batches:
            rows = []
            for d, s, o, n, z in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if d != device:
                    device, upper = d, Upper(start)
                if z:
                    upper.discard(o, n)
                else:
                    rows += [(d, s, *part) for part in upper.write(o, n)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(),) * 5 + (pa.bool_(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["device", "seq", "offset", "length", "moffset", "in_place"])

    ready = requests.select(*(F.col(c).cast("long").alias(c) for c in ("device", "seq", "offset", "length")), F.col("zeroed").cast("boolean").alias("zeroed")).filter("length > 0")
    return ready.repartition("device").sortWithinPartitions("device", "seq").mapInArrow(run, "device long, seq long, offset long, length long, moffset long, in_place boolean")
