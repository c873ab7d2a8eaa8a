"""Read admission: the latency-driven window as a fold, queue order, caps and counters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..schema import MAX_READ

#: Classes in the order of admission.
CLASSES = {"ondemand": 0, "prefetch": 1, "fill": 2}


def window_fold(samples: DataFrame, start: int = 4, low: int = 1, high: int = 64, step: int = 1, rise: int = 150, down: int = 50, floor: int = 1_000_000) -> DataFrame:
    """(device, samples, baseline, window) after latency samples (device, ordinal, nanos), in integer arithmetic.

    The first sample only anchors the baseline.  A sample above `rise` percent of it shrinks the window to `down`
    percent, any other grows it by `step`; then the baseline moves an eighth towards the sample.  A device's samples
    stream through one task in order, with three numbers of state.
    """
    order = samples.select(F.col("device").cast("long").alias("device"), "ordinal", F.greatest("nanos", F.lit(floor)).cast("long").alias("s"))

    def run(batches):
        device, n, base, window = None, 0, 0, 0
        for batch in batches:
            done = []
            for d, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if d != device or not n:
                    if n:
                        done.append((device, n, base, window))
                    device, n, base, window = d, 1, s, min(max(start, low), high)
                    continue
                window = max(low, window * down // 100) if s > base * rise // 100 else min(high, window + step)
                base, n = (base * 7 + s) // 8, n + 1
            yield folded(done)
        if n:
            yield folded([(device, n, base, window)])

    def folded(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["device", "samples", "baseline", "window"])

    return order.repartition("device").sortWithinPartitions("device", "ordinal").mapInArrow(run, "device long, samples long, baseline long, window long")


def admission_order(waiting: DataFrame) -> DataFrame:
    """Waiting reads (device, arrival, read_class) with their place: prefetch before fill, then by arrival."""
    rank = F.create_map(*[x for k, v in CLASSES.items() for x in (F.lit(k), F.lit(v))])
    order = W.Window.partitionBy("device").orderBy(F.try_element_at(rank, F.col("read_class")), "arrival")
    return waiting.withColumn("place", F.row_number().over(order))


def capped(requests: DataFrame, most: int = MAX_READ) -> DataFrame:
    """Request sizes: classes other than on-demand are cut to `most` bytes."""
    return requests.withColumn("capped", F.when(F.col("read_class") == "ondemand", F.col("count")).otherwise(F.least("count", F.lit(most))))


def class_counts(reads: DataFrame) -> DataFrame:
    return reads.groupBy("device", "read_class").agg(F.count("*").alias("n"), F.sum("count").alias("bytes"))


def over_rate(reads: DataFrame, bytes_per_second: int) -> DataFrame:
    """Seconds (device, second) in which reads (device, ts, count) exceed a rate."""
    second = F.date_trunc("second", F.col("ts"))
    return reads.groupBy("device", second.alias("second")).agg(F.sum("count").alias("bytes")).filter(F.col("bytes") > bytes_per_second)


def backoffs(failures: DataFrame, most: int = 64) -> DataFrame:
    """Failed fill attempts (device, attempt from 1) with the wait before the next: 2, 4, ... seconds, at most `most`."""
    shift = F.least(F.col("attempt"), F.lit(most.bit_length() - 1)).cast("int")
    return failures.withColumn("wait_s", F.call_function("shiftleft", F.lit(1).cast("long"), shift))


def single_flights(fetches: DataFrame) -> DataFrame:
    """Fetches (key, start, done) with the start of the flight that each joins: one that an earlier one of its key still covers joins it."""
    order = W.Window.partitionBy("key").orderBy("start", "done")
    reach = F.max("done").over(order.rowsBetween(W.Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") >= reach, F.lit(True))
    lead = F.last(F.when(fresh, F.col("start")), ignorenulls=True).over(order.rowsBetween(W.Window.unboundedPreceding, 0))
    return fetches.withColumn("flight", lead).withColumn("joined", ~fresh)


def counters(events: DataFrame) -> DataFrame:
    """(device, event, n): how often each kind of event occurred."""
    return events.groupBy("device", "event").agg(F.count("*").alias("n"))


def recoveries(events: DataFrame, most: int) -> DataFrame:
    """(device, generation, exits, given_up) of a device's events (device, ordinal, outcome); a generation begins when it runs, and more than `most` exits in one end it."""
    order = W.Window.partitionBy("device").orderBy("ordinal").rowsBetween(W.Window.unboundedPreceding, 0)
    rows = events.withColumn("generation", F.sum((F.col("outcome") == "running").cast("long")).over(order))
    return rows.groupBy("device", "generation").agg(F.count_if(F.col("outcome") == "exit").alias("exits")).withColumn("given_up", F.col("exits") > most)
