"""Queries of lookups and interval algebra beyond the first ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, layers, lookup, overlay
from . import inputs
from .book import Given, registered
from .registry import live_view, states

PLACES = "CASE WHEN NOT zeroed THEN moffset * length + length * (length - 1) div 2 ELSE 0 END"
SUMS = "count(*) AS sectors, count(*) FILTER (zeroed) AS zero_sectors, CAST(coalesce(sum(place), 0) AS BIGINT) AS place_sum"


def summed(rows: DataFrame) -> DataFrame:
    """Per device: sectors, zero sectors and the sum of all physical places, a digest that doesn't depend on how segments are cut."""
    return rows.groupBy("device").agg(F.sum("length").alias("sectors"), F.sum(F.when(F.col("zeroed"), F.col("length")).otherwise(0)).alias("zero_sectors"), F.sum(F.expr(PLACES)).alias("place_sum"))


@registered(f"SELECT device, {SUMS} FROM live WHERE sector BETWEEN 1000 AND 2999 GROUP BY device")
def interval_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(intervals.clip(live_view(spark, sf_dir), F.lit(1000), F.lit(3000)))


@registered(f", held AS (SELECT DISTINCT device, start_sector + k AS sector FROM (SELECT device, start_sector, unnest(range(nr_sectors)) AS k FROM requests)) SELECT device, {SUMS} FROM live SEMI JOIN held USING (device, sector) GROUP BY device")
def interval_clipped_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = inputs.requests(spark, sf_dir).select("device", F.col("start_sector").alias("offset"), F.col("nr_sectors").alias("length"))
    return summed(intervals.clipped_to(live_view(spark, sf_dir), intervals.cover(ranges)))


@registered(
    f""", held AS (SELECT DISTINCT device, start_sector + k AS sector FROM (SELECT device, start_sector, unnest(range(nr_sectors)) AS k FROM requests)),
    merged AS (SELECT device, sector, h.sector IS NOT NULL OR l.zeroed AS zeroed, CASE WHEN h.sector IS NULL THEN l.place END AS place FROM (SELECT device, sector, zeroed, place FROM live) l FULL JOIN held h USING (device, sector))
    SELECT device, {SUMS} FROM merged GROUP BY device"""
)
def overlay_mask_zeroes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = inputs.requests(spark, sf_dir).select("device", F.col("start_sector").alias("offset"), F.col("nr_sectors").alias("length"))
    return summed(overlay.mask_zeroes(live_view(spark, sf_dir), intervals.cover(ranges)))


@registered(
    f""", changed AS (SELECT DISTINCT device, start_sector + k AS sector FROM (SELECT device, start_sector, unnest(range(nr_sectors)) AS k FROM requests)),
    first_layer AS (SELECT * FROM sector_log WHERE layer = 0 QUALIFY row_number() OVER (PARTITION BY device, sector ORDER BY seq DESC) = 1),
    joined AS (SELECT device, sector, zeroed, place FROM live ANTI JOIN changed USING (device, sector) UNION ALL SELECT device, sector, zeroed, place FROM first_layer SEMI JOIN changed USING (device, sector))
    SELECT device, {SUMS} FROM joined GROUP BY device"""
)
def interval_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live view, with the requested ranges as the first layer alone has them."""
    log = inputs.mapping_log(spark, sf_dir)
    fresh = intervals.coalesce(overlay.replay(log.filter("layer = 0")), same=("seq", "zeroed"))
    ranges = intervals.cover(inputs.requests(spark, sf_dir).select("device", F.col("start_sector").alias("offset"), F.col("nr_sectors").alias("length")))
    return summed(intervals.splice(live_view(spark, sf_dir).select("device", "offset", "length", "moffset", "zeroed"), ranges, fresh.select("device", "offset", "length", "moffset", "zeroed")))


SHIFTED = "SELECT device, off, len, (moffset * 7) % 4096 + 8 AS moffset FROM view WHERE NOT zeroed"


@registered(
    f"""SELECT device, off AS "offset", len AS length, moffset FROM (SELECT *, max(moffset + len) OVER (PARTITION BY device ORDER BY moffset, len, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({SHIFTED})) WHERE moffset < reach"""
)
def interval_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data segments that share sectors of the layer, where places are folded into a small one."""
    view = live_view(spark, sf_dir).withColumn("moffset", F.col("moffset") * 7 % 4096 + 8)
    return intervals.aliases(view).select("device", "offset", "length", "moffset")


@registered(
    """SELECT device, seq, CASE WHEN last > off THEN 'order' ELSE 'bounds' END AS reason FROM (SELECT *, lag(off + len) OVER (PARTITION BY device ORDER BY seq) AS last FROM log)
    WHERE last > off OR (zeroed AND (moffset < 8 OR moffset > 4000)) OR (NOT zeroed AND (moffset < 8 OR moffset >= 4000 OR moffset + len > 4000 OR len = 0))"""
)
def interval_disorders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that are out of order, taken as an index, or lie outside a data region of 4000 sectors."""
    return intervals.disorders(inputs.mapping_log(spark, sf_dir), F.lit(4000), "seq").select("device", "seq", "reason")


@registered(
    """, seg AS (SELECT device, off + k * 16 AS off, least(16, len - k * 16) AS len, zeroed, row_number() OVER (PARTITION BY device ORDER BY off + k * 16) AS i FROM (SELECT *, unnest(range((len + 15) // 16)) AS k FROM states)),
    fold AS (SELECT device, i, off, len, zeroed FROM seg WHERE i = 1
      UNION ALL SELECT s.device, s.i, CASE WHEN j THEN f.off ELSE s.off END, CASE WHEN j THEN f.len + s.len ELSE s.len END, s.zeroed
      FROM (SELECT f.*, s.off AS s_off, s.len AS s_len, s.zeroed AS s_zeroed, s.i AS s_i, f.off + f.len = s.off AND f.zeroed AND s.zeroed AND f.len + s.len <= 40 AS j FROM fold f JOIN seg s ON s.device = f.device AND s.i = f.i + 1) f JOIN seg s ON s.device = f.device AND s.i = f.s_i)
    SELECT device, off AS "offset", max(len) AS length, bool_and(zeroed) AS zeroed FROM fold GROUP BY device, off"""
)
def interval_greedy_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy joining of zeroes cut to pieces of 16 sectors, up to 40; the SQL walks the segments one by one."""
    rows = intervals.split(states(spark, sf_dir), 16).withColumn("moffset", F.col("offset") * 2 + 8).withColumn("tag", F.lit(0))
    return intervals.greedy_merge(rows, 40).select("device", "offset", "length", "zeroed")


BLOBS = Given("documents", blob="doc_id", size="n_chars")


@registered(
    f"""SELECT blob, unnest(CASE WHEN size = 0 THEN [] WHEN 3000 + 500 >= size THEN [[0, size]] ELSE [[0, 3000], [size - 500, 500]] END)[1] AS "offset", unnest(CASE WHEN size = 0 THEN [] WHEN 3000 + 500 >= size THEN [[0, size]] ELSE [[0, 3000], [size - 500, 500]] END)[2] AS length FROM {BLOBS.sql}""",
    plain=True,
)
def lookup_end_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.end_windows(BLOBS.frame(spark, sf_dir), F.lit(3000), F.lit(500)).select("blob", "offset", "length")


@registered(f"""SELECT blob, k * 1000 AS "offset", least(1000, size - k * 1000) AS length FROM (SELECT blob, size, unnest(range((size + 999) // 1000)) AS k FROM {BLOBS.sql} WHERE size > 0)""", plain=True)
def lookup_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = BLOBS.frame(spark, sf_dir).filter("size > 0").select("blob", F.lit(0).cast("long").alias("offset"), F.col("size").alias("length"))
    return lookup.slices(whole, 1000)


SPANS = Given("orders", request="o_orderkey", offset="o_orderkey * 37 % 20000", count="o_orderkey % 9000")


@registered(
    f"""SELECT request, source, greatest("offset", low) - low AS source_offset, least("offset" + "count", high) - greatest("offset", low) AS source_count
    FROM {SPANS.sql} JOIN (VALUES ('metadata', 0, 5000), ('gap', 5000, 5120), ('target', 5120, 17120)) p(source, low, high) ON "offset" < high AND "offset" + "count" > low AND "count" > 0""",
    plain=True,
)
def lookup_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of metadata of 5000 bytes, padded to a sector, and a target of 12000 behind it."""
    reads = SPANS.frame(spark, sf_dir).filter("count > 0")
    return lookup.concatenated(reads, F.lit(5000).cast("long"), F.lit(12000).cast("long")).select("request", "source", "source_offset", "source_count")


@registered(
    """, offs AS (SELECT *, 512 + CAST(sum(comp_size) OVER (PARTITION BY blob ORDER BY idx) AS BIGINT) - comp_size AS block_offset FROM blocks),
    reads AS (SELECT o_orderkey AS request, o_orderkey % 3 * 500 AS blob, (o_orderkey * 977) % 2000000 AS off, o_orderkey % 20000 + 1 AS cnt FROM orders)
    SELECT request, r.blob, idx, block_offset, comp_size, least(off + cnt, (idx + 1) * 4096) - greatest(off, idx * 4096) AS taken FROM reads r JOIN offs o ON r.blob = o.blob AND off < (idx + 1) * 4096 AND off + cnt > idx * 4096"""
)
def lookup_block_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte reads with the compressed blocks that hold them."""
    reads = Given("orders", request="o_orderkey", blob="o_orderkey % 3 * 500", offset="o_orderkey * 977 % 2000000", count="o_orderkey % 20000 + 1").frame(spark, sf_dir)
    return lookup.block_reads(reads, lookup.block_offsets(inputs.blocks(spark, sf_dir), "blob"), "blob").select("request", "blob", "idx", "block_offset", "comp_size", "taken")


@registered(
    """, reads AS (SELECT device, request, (request * 65536) % 600000000 + off % 65536 AS off, cnt + 1 AS cnt FROM byte_reads),
    units AS (SELECT *, unnest(range(off // 65536, (off + cnt - 1) // 65536 + 1)) AS eid FROM reads)
    SELECT u.device, request, u.eid, coalesce(present, false) AS present, least(off + cnt, (u.eid + 1) * 65536) - greatest(off, u.eid * 65536) AS taken FROM units u LEFT JOIN extents e ON u.device = e.device AND u.eid = e.eid"""
)
def lookup_extent_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte reads with the cached extents that they touch; an extent without a record is missing."""
    reads = inputs.byte_reads(spark, sf_dir).withColumn("offset", F.col("request") * 65536 % 600000000 + F.col("offset") % 65536).withColumn("count", F.col("count") + 1)
    return lookup.extent_reads(reads, inputs.extents(spark, sf_dir), "device").select("device", "request", "eid", "present", "taken")


@registered("SELECT device, count(*) AS extents, count(*) FILTER (present) AS held, count(*) FILTER (present) = count(*) AS complete FROM extents GROUP BY device")
def lookup_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.completeness(inputs.extents(spark, sf_dir), "device")


@registered("SELECT device, CAST(max(off + len) * 512 AS BIGINT) AS bytes, min(layer) AS least_tag FROM log GROUP BY device")
def overlay_content_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the content of each device's log ends, and its least tag."""
    return overlay.content_extents(inputs.mapping_log(spark, sf_dir).withColumn("tag", F.col("layer"))).select("device", "bytes", F.col("least_tag").cast("long").alias("least_tag"))


STACK = Given("lineitem", device="l_orderkey", layer="l_linenumber - 1", virtual_size="CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_partkey * 512 END")


@registered(f"SELECT device, arg_min(virtual_size, layer) FILTER (virtual_size <> 0) AS readonly_size, max(virtual_size) AS writable_size FROM (SELECT device, layer, max(virtual_size) AS virtual_size FROM {STACK.sql} GROUP BY ALL) GROUP BY device", plain=True)
def overlay_virtual_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = STACK.frame(spark, sf_dir).groupBy("device", "layer").agg(F.max("virtual_size").alias("virtual_size"))
    return overlay.virtual_sizes(rows)


@registered("SELECT device, count(*) AS segments FROM log GROUP BY device HAVING count(*) > 550 OR max(layer) >= 6")
def overlay_over_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices above limits that are low enough to be met here."""
    return overlay.over_limits(inputs.mapping_log(spark, sf_dir), 550, 6)


@registered(
    """SELECT device, "offset", min(moffset) FILTER (NOT zeroed) AS moffset, zeroed FROM (SELECT device, off AS "offset", moffset, zeroed FROM view WHERE zeroed) GROUP BY ALL"""
)
def overlay_zero_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zero segments of the view, as a mask to store."""
    return overlay.zero_mask(live_view(spark, sf_dir)).select("device", "offset", F.lit(None).cast("long").alias("moffset"), F.lit(True).alias("zeroed"))


@registered(
    """SELECT device, off AS "offset", len AS length, CASE WHEN zeroed THEN 2 ELSE 1 END AS state FROM states"""
)
def coverage_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of a device as packed pages of two bits a sector, and read back as runs."""
    from ..sources import coverage

    return coverage.runs(coverage.pages(states(spark, sf_dir)))


@registered(
    """SELECT device, first AS "offset", length, class FROM (SELECT device, class, min(block) AS first, count(*) AS length FROM (SELECT *, block - row_number() OVER (PARTITION BY device, class ORDER BY block) AS run FROM (SELECT l_suppkey AS device, l_partkey AS block, max(CASE WHEN l_partkey % 7 < 3 THEN 'inode' WHEN l_partkey % 7 < 5 THEN 'bitmap' ELSE 'data' END) AS class FROM lineitem GROUP BY ALL)) GROUP BY device, class, run)""",
    plain=True,
)
def interval_class_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of blocks of one class."""
    rows = inputs.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS device", "l_partkey AS block", "CASE WHEN l_partkey % 7 < 3 THEN 'inode' WHEN l_partkey % 7 < 5 THEN 'bitmap' ELSE 'data' END AS class").distinct()
    return layers.class_runs(rows)


@registered("SELECT device, class, count(*) AS blocks FROM (SELECT DISTINCT l_suppkey AS device, l_partkey AS block, CASE WHEN l_partkey % 7 < 3 THEN 'inode' WHEN l_partkey % 7 < 5 THEN 'bitmap' ELSE 'data' END AS class FROM lineitem) GROUP BY ALL", plain=True)
def interval_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS device", "l_partkey AS block", "CASE WHEN l_partkey % 7 < 3 THEN 'inode' WHEN l_partkey % 7 < 5 THEN 'bitmap' ELSE 'data' END AS class").distinct()
    return rows.groupBy("device", "class").agg(F.count("*").alias("blocks"))
