"""Interval algebra on segments (device, offset, length, ...), by windows over one device.

A device has at most a million live segments by the format, so a window's partition is bounded; its
frames are read in order and spill.  Half-open sector ranges throughout.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import bits
from ..schema import DATA_START, MAX_LENGTH
from .overlay import resolve
from .spread import spread, spread_together


# functions, as column expressions at import would need a running session


def _order() -> W.WindowSpec:
    return W.Window.partitionBy("device").orderBy("offset")


def _so_far() -> W.WindowSpec:
    return _order().rowsBetween(W.Window.unboundedPreceding, 0)


def _before() -> W.WindowSpec:
    return _order().rowsBetween(W.Window.unboundedPreceding, -1)


def _end() -> Column:
    return F.col("offset") + F.col("length")


def coalesce(segments: DataFrame, same: tuple[str, ...] = ("zeroed",), physical: bool = True) -> DataFrame:
    """Maximal runs: neighbours join where they touch, agree in `same`, and, for data, continue in the layer too."""
    segments = spread(segments, "device")
    breaks = F.lag(_end()).over(_order()) != F.col("offset")
    for name in same:
        breaks = breaks | ~F.col(name).eqNullSafe(F.lag(name).over(_order()))
    if physical:
        breaks = breaks | (~F.col("zeroed") & (F.lag(F.col("moffset") + F.col("length")).over(_order()) != F.col("moffset")))
    marked = segments.withColumn("run", F.coalesce(breaks, F.lit(True)).cast("long")).withColumn("run", F.sum("run").over(_so_far()))
    rest = [c for c in segments.columns if c not in ("device", "offset", "length")]
    return marked.groupBy("device", "run").agg(F.min("offset").alias("offset"), F.sum("length").alias("length"), *(F.min_by(c, "offset").alias(c) for c in rest)).drop("run")


def split(segments: DataFrame, cap: int = MAX_LENGTH) -> DataFrame:
    """Segments of at most `cap` sectors; data moves on in the layer, zeroes don't."""
    parts = segments.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), bits.div(F.col("length") - 1, cap))))
    ahead = F.col("part") * cap
    out = parts.withColumn("offset_", F.col("offset") + ahead).withColumn("length_", F.least(F.lit(cap).cast("long"), F.col("length") - ahead))
    if "moffset" in segments.columns:
        out = out.withColumn("moffset", F.when(F.col("zeroed"), F.col("moffset")).otherwise(F.col("moffset") + ahead))
    return out.drop("offset", "length", "part").withColumnsRenamed({"offset_": "offset", "length_": "length"}).select(*segments.columns)


def greedy_merge(segments: DataFrame, cap: int = MAX_LENGTH) -> DataFrame:
    """Joins whole neighbours in order while the joined length stays within `cap`; a fold, as earlier joins decide later ones.

    Needs (device, offset, length, moffset, zeroed, tag).  A device streams through one task in order, which holds one segment.
    """

    names = ["device", "offset", "length", "moffset", "zeroed", "tag"]
    kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int32()]

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def run(batches):
        last: list | None = None
        for batch in batches:
            out = []
            for device, offset, length, moffset, zeroed, tag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last and last[0] == device and last[1] + last[2] == offset and last[4] == zeroed and last[5] == tag and last[2] + length <= cap and (zeroed or last[3] + last[2] == moffset):
                    last[2] += length
                    continue
                if last:
                    out.append(last)
                last = [device, offset, length, moffset, zeroed, tag]
            yield batch_of(out)
        if last:
            yield batch_of([last])

    ready = segments.select(*(F.col(c).cast("long").alias(c) for c in names[:3]), F.coalesce("moffset", F.lit(-1)).cast("long").alias("moffset"), "zeroed", F.col("tag").cast("int").alias("tag"))
    merged = spread(ready, "device").sortWithinPartitions("device", "offset").mapInArrow(run, "device long, offset long, length long, moffset long, zeroed boolean, tag int")
    return merged.withColumn("moffset", F.when(~F.col("zeroed"), F.col("moffset")))


def clip(segments: DataFrame, low: Column, high: Column) -> DataFrame:
    """The parts of segments within [low, high); data moves on in the layer."""
    start, end = F.greatest(F.col("offset"), low), F.least(_end(), high)
    kept = segments.filter(start < end)
    out = kept.withColumn("start_", start).withColumn("length_", end - start)
    if "moffset" in segments.columns:
        out = out.withColumn("moffset", F.when(F.col("zeroed"), F.col("moffset")).otherwise(F.col("moffset") + F.col("start_") - F.col("offset")))
    return out.drop("offset", "length").withColumnsRenamed({"start_": "offset", "length_": "length"}).select(*segments.columns)


def cover(ranges: DataFrame) -> DataFrame:
    """(device, offset, length): the union of ranges that may overlap or touch."""
    order = W.Window.partitionBy("device").orderBy("offset", "length")
    reach = F.max(_end()).over(order.rowsBetween(W.Window.unboundedPreceding, -1))
    marked = spread(ranges.select("device", "offset", "length"), "device").withColumn("run", F.coalesce(F.col("offset") > reach, F.lit(True)).cast("long"))
    grouped = marked.withColumn("run", F.sum("run").over(order.rowsBetween(W.Window.unboundedPreceding, 0))).groupBy("device", "run").agg(F.min("offset").alias("offset"), F.max(_end()).alias("end"))
    return grouped.select("device", "offset", (F.col("end") - F.col("offset")).alias("length"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return cover(a.select("device", "offset", "length").unionByName(b.select("device", "offset", "length")))


#: Ranges up to LONG sectors meet in buckets of 2**NARROW, longer ones and all that they meet in buckets of 2**WIDE.
NARROW, WIDE, LONG = 8, 20, 1 << 14


def _bucketed(rows: DataFrame, mine: str) -> DataFrame:
    """Rows with every bucket that they touch: columns kind, shift and bucket; `mine` says whether a kind's first or second letter is this side's.

    A pair of ranges is of one kind: both short (ss), both long (ll) or one of each (sl, ls); so a long range makes
    few rows, and short ranges are compared with few others however many a device has.
    """
    other = {"a": "sl", "b": "ls"}[mine]
    kind = lambda name, shift: F.struct(F.lit(name).alias("kind"), F.lit(shift).alias("shift"))
    kinds = F.when(F.col("length") <= LONG, F.array(kind("ss", NARROW), kind(other, WIDE))).otherwise(F.array(kind(other[::-1], WIDE), kind("ll", WIDE)))
    shift = F.col("k.shift")
    first, last = (F.call_function("shiftright", x, shift) for x in (F.col("offset"), _end() - 1))
    out = rows.withColumn("k", F.explode(kinds)).withColumn("bucket", F.explode(F.sequence(first, last)))
    return out.withColumn("kind", F.col("k.kind")).withColumn("shift", F.col("k.shift")).drop("k")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """(device, offset, length, a_offset, b_offset) of every overlapping pair, by an equi-join on buckets of two widths.

    A pair that shares several buckets is taken in the one where its overlap begins.
    """
    left = _bucketed(a.select("device", "offset", "length"), "a").select("device", "kind", "shift", "bucket", F.col("offset").alias("a_offset"), _end().alias("a_end"))
    right = _bucketed(b.select("device", "offset", "length"), "b").select("device", "kind", "bucket", F.col("offset").alias("b_offset"), _end().alias("b_end"))
    left, right = spread_together(left, right, "device", "kind", "bucket")
    start, end = F.greatest("a_offset", "b_offset"), F.least("a_end", "b_end")
    pairs = left.join(right, ["device", "kind", "bucket"]).filter((start < end) & (F.call_function("shiftright", start, F.col("shift")) == F.col("bucket")))
    return pairs.select("device", start.alias("offset"), (end - start).alias("length"), "a_offset", "b_offset")


def complement(segments: DataFrame, sizes: DataFrame) -> DataFrame:
    """(device, offset, length): the holes of disjoint segments in devices of (device, sectors)."""
    edge = sizes.select("device", F.col("sectors").alias("offset"), F.lit(0).cast("long").alias("length"))
    marked = spread(segments.select("device", "offset", "length").unionByName(edge), "device")
    start = F.coalesce(F.lag(_end()).over(W.Window.partitionBy("device").orderBy("offset", "length")), F.lit(0))
    return marked.select("device", start.alias("start"), (F.col("offset") - start).alias("length")).filter("length > 0").withColumnRenamed("start", "offset")


def erase(segments: DataFrame, holes: DataFrame) -> DataFrame:
    """Segments without the sectors of `holes`; what is left is split around them."""
    both = segments.select("device", "offset", "length", "moffset", "zeroed", F.lit(0).alias("tag")).unionByName(holes.select("device", "offset", "length", F.lit(None).cast("long").alias("moffset"), F.lit(True).alias("zeroed"), F.lit(1).alias("tag")))
    return resolve(both, F.col("tag") * (1 << 40) + F.col("offset")).filter("tag = 0").drop("rank", "tag")


def splice(view: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """`view` with the sectors of `changed` replaced by what `fresh` has there."""
    return erase(view, changed).unionByName(clipped_to(fresh, changed))


def clipped_to(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """The parts of segments inside disjoint ranges of the same device."""
    inside = intersect(segments, ranges).select("device", "offset", "length", F.col("a_offset").alias("base"))
    own = segments.select("device", F.col("offset").alias("base"), "moffset", "zeroed")
    inside, own = spread_together(inside, own, "device", "base")
    return inside.join(own, ["device", "base"]).select("device", "offset", "length", F.when(F.col("zeroed"), F.col("moffset")).otherwise(F.col("moffset") + F.col("offset") - F.col("base")).alias("moffset"), "zeroed")


def aliases(segments: DataFrame) -> DataFrame:
    """Data segments that start before an earlier one ends in the layer."""
    order = W.Window.partitionBy("device").orderBy("moffset", "length", "offset").rowsBetween(W.Window.unboundedPreceding, -1)
    return segments.filter("not zeroed").withColumn("reach", F.max(F.col("moffset") + F.col("length")).over(order)).filter("moffset < reach").drop("reach")


def disorders(segments: DataFrame, index_end: Column, order: str = "ordinal") -> DataFrame:
    """Segments out of order or mapped outside the data region, with the reason."""
    last = F.lag(_end()).over(W.Window.partitionBy("device").orderBy(order))
    start, end = F.col("moffset"), F.col("moffset") + F.col("length")
    outside = F.when(F.col("zeroed"), (start < DATA_START) | (start > index_end)).otherwise((start < DATA_START) | (start >= index_end) | (end > index_end) | (F.col("length") == 0))
    return segments.withColumn("reason", F.when(last > F.col("offset"), "order").when(outside, "bounds")).filter("reason is not null")


def pack(segments: DataFrame, base: int = DATA_START) -> DataFrame:
    """Data laid out without gaps in logical order: `packed` is each data segment's new place in the layer."""
    size = F.when(F.col("zeroed"), 0).otherwise(F.col("length"))
    return segments.withColumn("packed", F.when(~F.col("zeroed"), F.lit(base) + F.coalesce(F.sum(size).over(_before()), F.lit(0))))


def pack_two(segments: DataFrame, tail: Column, base: int = DATA_START) -> DataFrame:
    """As `pack`, but data of the tail class comes after all other data."""
    size = F.when(F.col("zeroed"), 0).otherwise(F.col("length"))
    own = W.Window.partitionBy("device", "tail").orderBy("offset").rowsBetween(W.Window.unboundedPreceding, -1)
    front = F.sum(F.when(~F.col("tail"), size).otherwise(0)).over(W.Window.partitionBy("device"))
    place = F.lit(base) + F.coalesce(F.sum(size).over(own), F.lit(0)) + F.when(F.col("tail"), front).otherwise(0)
    return segments.withColumn("tail", tail).withColumn("packed", F.when(~F.col("zeroed"), place))


def export_plan(view: DataFrame) -> DataFrame:
    """A normal form of a live view for export: maximal runs by state, split to the format's length, data packed anew.

    It doesn't depend on how the view's segments were fragmented.
    """
    return pack(split(coalesce(view.select("device", "offset", "length", F.lit(None).cast("long").alias("moffset"), "zeroed"), physical=False)).drop("moffset"))


def geometry(plan: DataFrame) -> DataFrame:
    """(device, data_bytes, index_bytes, file_bytes) of packed segments: header, data, index and trailer regions."""
    data = F.sum(F.when(F.col("zeroed"), 0).otherwise(F.col("length"))) * 512
    sums = plan.groupBy("device").agg(data.alias("data_bytes"), (F.count("*") * 16).alias("index_bytes"))
    return sums.withColumn("file_bytes", bits.round_up(F.col("data_bytes") + 4096 + F.col("index_bytes"), 4096) + 4096)


def copied_up(writes: DataFrame, block: int = 8) -> DataFrame:
    """Writes widened to whole blocks of 8 sectors, as a first write to a block copies the rest of it."""
    start = F.col("offset") - F.pmod("offset", F.lit(block))
    return writes.withColumn("end_", bits.round_up(_end(), block)).withColumn("offset", start).withColumn("length", F.col("end_") - F.col("offset")).drop("end_")


def fully_data(view: DataFrame, ranges: DataFrame) -> DataFrame:
    """Ranges (device, offset, length) with is_data: whether data covers all of it."""
    own = ranges.select("device", "offset", "length").distinct().withColumn("range_end", _end())
    left = _bucketed(own, "a").select("device", "kind", "shift", "bucket", F.col("offset").alias("r_offset"), "range_end")
    right = _bucketed(view.filter("not zeroed").select("device", "offset", "length"), "b").select("device", "kind", "bucket", "offset", _end().alias("end"))
    left, right = spread_together(left, right, "device", "kind", "bucket")
    low, high = (F.call_function("shiftleft", x, F.col("shift")) for x in (F.col("bucket"), F.col("bucket") + 1))
    start, end = F.greatest("offset", "r_offset", low), F.least("end", "range_end", high)
    sums = left.join(right, ["device", "kind", "bucket"]).filter(start < end).groupBy("device", "r_offset", "range_end").agg(F.sum(end - start).alias("held"))
    out = own.join(sums.withColumnRenamed("r_offset", "offset"), ["device", "offset", "range_end"], "left")
    return out.select("device", "offset", "length", (F.coalesce("held", F.lit(0)) == F.col("length")).alias("is_data"))
