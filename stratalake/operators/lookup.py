"""Lookups of ranges in indexes: merged views, compressed blocks, cached extents, restart points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import bits
from ..schema import EXTENT_BYTES, SECTOR
from .overlay import GRANULE
from .spread import spread, spread_together


def read_plan(requests: DataFrame, sizes: DataFrame) -> DataFrame:
    """Byte reads (device, request, offset, count) as sector ranges with a status.

    Unaligned reads are refused ("invalid"), reads past the end return nothing ("end"), others are cut to the size.
    """
    joined = requests.join(sizes.select("device", (F.col("sectors") * SECTOR).alias("size")), "device")
    bad = (F.pmod("offset", F.lit(SECTOR)) != 0) | (F.pmod("count", F.lit(SECTOR)) != 0)
    count = F.greatest(F.least("count", F.col("size") - F.col("offset")), F.lit(0))
    status = F.when(bad, "invalid").when((F.col("offset") >= F.col("size")) | (F.col("count") == 0), "end").otherwise("read")
    taken = F.when(status == "read", count).otherwise(0)
    return joined.select("device", "request", status.alias("status"), bits.div(F.col("offset"), SECTOR).alias("start_sector"), bits.div(taken, SECTOR).alias("nr_sectors"))


def pieces(requests: DataFrame, view: DataFrame) -> DataFrame:
    """Each request (device, request, start_sector, nr_sectors) as pieces (offset, length, state, moffset) of a view.

    state is data, zero or hole.  Requests and segments meet in an equi-join on granules, so no
    request is compared with a whole device; pieces end at granules.
    """
    end = F.col("start_sector") + F.col("nr_sectors")
    own = requests.filter("nr_sectors > 0").select("device", "request", "start_sector", end.alias("end_sector"), F.explode(F.sequence(bits.div(F.col("start_sector"), GRANULE), bits.div(end - 1, GRANULE))).alias("bucket"))
    own = own.withColumn("low", F.greatest("start_sector", F.col("bucket") * GRANULE)).withColumn("high", F.least("end_sector", (F.col("bucket") + 1) * GRANULE))
    stop = F.col("offset") + F.col("length")
    there = view.withColumn("bucket", F.explode(F.sequence(bits.div(F.col("offset"), GRANULE), bits.div(stop - 1, GRANULE)))).select("device", "bucket", F.col("offset").alias("s"), stop.alias("e"), "moffset", "zeroed")
    start, finish = F.greatest("s", "low"), F.least("e", "high")
    asked, held = spread_together(own, there, "device", "bucket")
    hits = asked.join(held, ["device", "bucket"]).filter(start < finish).select("device", "request", "bucket", "low", "high", start.alias("offset"), finish.alias("stop"), F.when(F.col("zeroed"), "zero").otherwise("data").alias("state"), F.when(~F.col("zeroed"), F.col("moffset") + start - F.col("s")).alias("moffset"))
    # holes lie before each piece and after the last one of a request's granule; an empty piece at its end stands for the latter
    none = F.lit(None)
    ends = own.select("device", "request", "bucket", "low", "high", F.col("high").alias("offset"), F.col("high").alias("stop"), none.cast("string").alias("state"), none.cast("long").alias("moffset"))
    order = W.Window.partitionBy("device", "request", "bucket").orderBy("offset", "stop")
    all_ = spread(hits.unionByName(ends), "device", "request", "bucket").withColumn("from", F.coalesce(F.lag("stop").over(order), F.col("low")))
    # a row gives the hole before it and itself, so that the join and the window run once
    piece = lambda low, high, state, moffset: F.struct(low.alias("offset"), (high - low).alias("length"), state.alias("state"), moffset.alias("moffset"))
    hole = F.when(F.col("from") < F.col("offset"), piece(F.col("from"), F.col("offset"), F.lit("hole"), none.cast("long")))
    own = F.when(F.col("state").isNotNull(), piece(F.col("offset"), F.col("stop"), F.col("state"), F.col("moffset")))
    return all_.select("device", "request", F.explode(F.array_compact(F.array(hole, own))).alias("p")).select("device", "request", "p.*")


def as_of(points: DataFrame, entries: DataFrame, key: str, at: str, entry_at: str) -> DataFrame:
    """Each point with the last entry of its key at or before it, and the distance: one sorted pass over both."""
    rest = [c for c in entries.columns if c not in (key, entry_at)]
    kinds = {f.name: f.dataType for f in entries.schema}
    left = points.withColumn("entry_", F.lit(None).cast(f"struct<{entry_at}:long," + ",".join(f"{c}:{kinds[c].simpleString()}" for c in rest) + ">")).withColumn("side_", F.lit(1)).withColumn("at_", F.col(at))
    right = entries.select(F.col(key), F.struct(F.col(entry_at).cast("long").alias(entry_at), *rest).alias("entry_"), F.lit(0).alias("side_"), F.col(entry_at).alias("at_"))
    both = spread(left.unionByName(right, allowMissingColumns=True), key)
    order = W.Window.partitionBy(key).orderBy("at_", "side_").rowsBetween(W.Window.unboundedPreceding, 0)
    found = both.withColumn("entry_", F.last("entry_", ignorenulls=True).over(order)).filter("side_ = 1")
    return found.select(*points.columns, *(F.col(f"entry_.{c}").alias(f"entry_{c}" if c in points.columns else c) for c in (entry_at, *rest)), (F.col("at_") - F.col(f"entry_.{entry_at}")).alias("distance"))


def block_offsets(blocks: DataFrame, key: str, first: int = 512, block_size: int = 4096, checked: bool = False) -> DataFrame:
    """Offsets of compressed blocks (key, idx, comp_size) by prefix sums, as a group base and a 16-bit delta.

    A group has 65536 / block_size blocks.  `valid` is false where a size is too small or a delta doesn't fit.
    """
    group = 65536 // block_size
    order = W.Window.partitionBy(key).orderBy("idx").rowsBetween(W.Window.unboundedPreceding, -1)
    out = blocks.withColumn("block_offset", F.lit(first) + F.coalesce(F.sum("comp_size").over(order), F.lit(0))).withColumn("group_no", bits.div(F.col("idx"), group))
    base = F.first("block_offset").over(W.Window.partitionBy(key, "group_no").orderBy("idx"))
    out = out.withColumn("group_base", base).withColumn("delta", F.col("block_offset") - F.col("group_base"))
    last = F.pmod(F.col("idx") + 1, F.lit(group)) == 0
    return out.withColumn("valid", (F.col("comp_size") > (4 if checked else 0)) & (last | (F.col("delta") + F.col("comp_size") < 65535)))


def units_of(reads: DataFrame, unit: int, name: str) -> DataFrame:
    """Byte reads (offset, count) as rows of the fixed-size units that they touch, with the bytes taken of each."""
    end = F.col("offset") + F.col("count")
    rows = reads.filter("count > 0").withColumn(name, F.explode(F.sequence(bits.div(F.col("offset"), unit), bits.div(end - 1, unit))))
    return rows.withColumn("taken", F.least(end, (F.col(name) + 1) * unit) - F.greatest("offset", F.col(name) * unit))


def block_reads(reads: DataFrame, blocks: DataFrame, key: str, block_size: int = 4096) -> DataFrame:
    """Reads joined with the compressed blocks that hold their bytes."""
    return units_of(reads, block_size, "idx").join(blocks, [key, "idx"])


def extent_reads(reads: DataFrame, extents: DataFrame, key: str) -> DataFrame:
    """Reads joined with the cached extents that they touch; an extent without a record is missing."""
    return units_of(reads, EXTENT_BYTES, "eid").join(extents.select(key, "eid", "present"), [key, "eid"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def missing_runs(extents: DataFrame, key: str, cap: int = 16) -> DataFrame:
    """(key, eid, length): runs of extents that are not present, in parts of at most `cap`."""
    gone = extents.filter("not present").select(key, "eid").distinct()
    order = W.Window.partitionBy(key).orderBy("eid")
    runs = gone.withColumn("run", F.col("eid") - F.row_number().over(order)).groupBy(key, "run").agg(F.min("eid").alias("first"), F.count("*").alias("n"))
    parts = runs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), bits.div(F.col("n") - 1, cap))))
    return parts.select(key, (F.col("first") + F.col("part") * cap).alias("eid"), F.least(F.lit(cap).cast("long"), F.col("n") - F.col("part") * cap).alias("length"))


def end_windows(blobs: DataFrame, head: Column, tail: Column) -> DataFrame:
    """Warm-up windows of blobs (blob, size): the head and the tail, or the whole where both meet."""
    h, t = F.least(head, F.col("size")), F.least(tail, F.col("size"))
    window = lambda off, length: F.struct(off.cast("long").alias("offset"), length.cast("long").alias("length"))
    whole = F.array(window(F.lit(0), F.col("size")))
    ends = F.array_compact(F.array(F.when(h > 0, window(F.lit(0), h)), F.when(t > 0, window(F.col("size") - t, t))))
    none = F.array().cast("array<struct<offset:long,length:long>>")
    found = F.when(F.col("size") == 0, none).when((h > 0) & (t > 0) & (h + t >= F.col("size")), whole).otherwise(ends)
    return blobs.select("*", F.explode(found).alias("w")).select(*blobs.columns, "w.offset", "w.length")


def slices(windows: DataFrame, step: int = EXTENT_BYTES) -> DataFrame:
    """Windows (offset, length) in steps."""
    parts = windows.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), bits.div(F.col("length") - 1, step))))
    return parts.select(*[c for c in windows.columns if c not in ("offset", "length")], (F.col("offset") + F.col("n") * step).alias("offset"), F.least(F.lit(step).cast("long"), F.col("length") - F.col("n") * step).alias("length"))


def concatenated(reads: DataFrame, meta_size: Column, target_size: Column) -> DataFrame:
    """Reads of two sources laid end to end, the second from the next sector: parts of metadata, gap zeroes and target."""
    base = bits.round_up(meta_size, SECTOR)
    part = lambda name, low, high, shift: F.struct(F.lit(name).alias("source"), F.greatest("offset", low).alias("low"), F.least(F.col("offset") + F.col("count"), high).alias("high"), shift.alias("shift"))
    zero = F.lit(0).cast("long")
    parts = F.array(part("metadata", zero, meta_size, zero), part("gap", meta_size, base, meta_size), part("target", base, base + target_size, base))
    out = reads.select("*", F.explode(F.filter(parts, lambda p: p["low"] < p["high"])).alias("p"))
    return out.select(*reads.columns, "p.source", (F.col("p.low") - F.col("p.shift")).alias("source_offset"), (F.col("p.high") - F.col("p.low")).alias("source_count"))


def completeness(extents: DataFrame, key: str) -> DataFrame:
    """(key, extents, held, complete): how many extents of each layer are present, and whether all are."""
    return extents.groupBy(key).agg(F.count("*").alias("extents"), F.count_if("present").alias("held")).withColumn("complete", F.col("held") == F.col("extents"))


def known_layers(trace: DataFrame, layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trace records of the layers (device, layer_index), and per device the number of those of unknown layers."""
    keys = layers.select("device", "layer_index").distinct()
    return trace.join(keys, ["device", "layer_index"], "left_semi"), trace.join(keys, ["device", "layer_index"], "left_anti").groupBy("device").agg(F.count("*").alias("misses"))
