"""Access traces: filters, recording with coalescing, bounded replay and its statistics.

A trace is (device, ordinal, op, layer_index, count, offset); ordinal is its order.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import bits
from ..schema import MAX_READ


def _order() -> W.WindowSpec:
    return W.Window.partitionBy("device").orderBy("ordinal")


def conforming(trace: DataFrame) -> DataFrame:
    """Records that a writer may emit."""
    return trace.filter((F.col("op") == "R") & F.col("count").between(1, MAX_READ) & (F.col("offset") >= 0))


def eligible(layers: Column, most: int = MAX_READ) -> Column:
    """Whether a replay takes a record: a read of a known layer with a count in bounds."""
    return (F.col("op") == "R") & (F.col("layer_index") < layers) & (F.col("layer_index") >= 0) & F.col("count").between(1, most) & (F.col("offset") >= 0)


def tapped(reads: DataFrame, base: Column) -> DataFrame:
    """Full on-demand reads (read_class, result, count, offset), moved behind a wrapper header of `base` bytes."""
    end = F.col("offset") + F.col("count")
    kept = reads.filter((F.col("read_class") == "ondemand") & (F.col("result") == F.col("count")) & (F.col("count") > 0) & (end > base))
    return kept.withColumn("count", end - F.greatest("offset", base)).withColumn("offset", F.greatest(F.col("offset") - base, F.lit(0)))


def chunks(trace: DataFrame, cap: int = MAX_READ) -> DataFrame:
    """Records cut to at most `cap` bytes; part numbers keep the order."""
    parts = trace.filter("count > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), bits.div(F.col("count") - 1, cap))))
    return parts.withColumn("offset", F.col("offset") + F.col("part") * cap).withColumn("count", F.least(F.lit(cap).cast("long"), F.col("count") - F.col("part") * cap))


class Recorder:
    """The pending queue of one recording: whole chunks join the tail where they continue it; a full queue drops."""

    def __init__(self, cap: int = MAX_READ, room: int = 65536):
        self.cap, self.room, self.queue, self.dropped = cap, room, [], 0

    def add(self, layer: int, offset: int, count: int) -> None:
        while count > 0:
            size = min(count, self.cap)
            tail = self.queue[-1] if self.queue else None
            if tail and tail[0] == layer and tail[1] + tail[2] == offset and tail[2] + size <= self.cap:
                tail[2] += size
            elif len(self.queue) >= self.room:
                self.dropped += 1
            else:
                self.queue.append([layer, offset, size])
            offset += size
            count -= size

    def rows(self, device: int | None) -> pa.RecordBatch:
        columns = [[device] * len(self.queue), range(len(self.queue)), *([q[i] for q in self.queue] for i in range(3)), [self.dropped] * len(self.queue)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["device", "ordinal", "layer_index", "offset", "count", "dropped"])


def record(trace: DataFrame, cap: int = MAX_READ, room: int = 65536) -> DataFrame:
    """(device, ordinal, layer_index, offset, count, dropped): what a recording of each device's reads keeps.

    A fold over the order, as each join decides the next.  A device's records stream through one task, which
    holds its queue of at most `room` rows.
    """

    def run(batches):
        device, own = None, Recorder(cap, room)
        for batch in batches:
            for d, layer, offset, count in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if d != device:
                    yield own.rows(device)
                    device, own = d, Recorder(cap, room)
                own.add(layer, offset, count)
        yield own.rows(device)

    reads = trace.select(*(F.col(c).cast("long").alias(c) for c in ("device", "ordinal", "layer_index", "offset", "count")))
    kind = "device long, ordinal long, layer_index long, offset long, count long, dropped long"
    return reads.repartition("device").sortWithinPartitions("device", "ordinal").mapInArrow(run, kind)


def replayed(trace: DataFrame, layers: Column, max_records: int, max_bytes: int, most: int = MAX_READ) -> DataFrame:
    """The trace with taken, eligible and processed per record, as a bounded replay would go.

    The replay ends before the record after `max_records`, before any record once the byte budget is
    met exactly, and at the first eligible record that exceeds what is left.  Sums of eligible counts only
    grow, so each end is a condition on a running sum, and the first one counts.
    """
    own = F.when(eligible(layers, most), F.col("count")).otherwise(0)
    upto = _order().rowsBetween(W.Window.unboundedPreceding, 0)
    marked = trace.withColumn("own", own).withColumn("rank", F.row_number().over(_order())).withColumn("total", F.sum("own").over(upto))
    stop = (F.col("rank") > max_records) | (F.col("total") - F.col("own") >= max_bytes) | (F.col("total") > max_bytes)
    marked = marked.withColumn("stopped", F.max(stop.cast("int")).over(upto) == 1)
    # the record that exceeds the budget itself still counts as looked at, but not as skipped
    return marked.select(*trace.columns, (F.col("own") > 0).alias("eligible"), "stopped", (~F.col("stopped") & (F.col("own") > 0)).alias("taken"))


def replay_stats(trace: DataFrame, layers: Column, max_records: int, max_bytes: int) -> DataFrame:
    """(device, records_total, records_replayed, records_skipped, bytes_requested, budget_exhausted)."""
    rows = replayed(trace, layers, max_records, max_bytes)
    return rows.groupBy("device").agg(
        F.count("*").alias("records_total"),
        F.count_if("taken").alias("records_replayed"),
        F.count_if(~F.col("stopped") & ~F.col("eligible")).alias("records_skipped"),
        F.coalesce(F.sum(F.when(F.col("taken"), F.col("count"))), F.lit(0)).alias("bytes_requested"),
        F.bool_or("stopped").alias("budget_exhausted"),
    )


def warm_up_stats(windows: DataFrame) -> DataFrame:
    """(device, layers_total, layers_warmed, windows_populated, windows_failed, windows_skipped, bytes_warmed) of window outcomes."""
    return windows.groupBy("device").agg(
        F.countDistinct("layer_index").alias("layers_total"),
        F.countDistinct(F.when(F.col("bytes") > 0, F.col("layer_index"))).alias("layers_warmed"),
        *(F.count_if(F.col("outcome") == o).alias(f"windows_{o}") for o in ("populated", "failed", "skipped")),
        F.sum("bytes").alias("bytes_warmed"),
    )


def in_window(events: DataFrame, starts: DataFrame, most_seconds: int = 3600) -> DataFrame:
    """Events (device, ts) inside each device's recording window (device, start_ts, seconds), lengths kept in 1..most_seconds."""
    end = F.timestamp_seconds(F.unix_timestamp("start_ts") + F.least(F.greatest("seconds", F.lit(1)), F.lit(most_seconds)))
    return events.join(starts.withColumn("end_ts", end), "device").filter("ts >= start_ts and ts < end_ts").drop("end_ts")
