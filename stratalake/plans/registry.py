"""Registered queries over the driver's tables, and the equal SQL.

SQL resolves extents sector by sector, a plain way that shares nothing with the cells of `overlay.resolve`.
Folds whose steps depend on earlier steps have no SQL; the tests hold them against sequential models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checksums
from ..operators import admission, intervals, layers, lookup, overlay, trace
from . import inputs
from .book import ORACLE, QUERIES, registered

__all__ = ["ORACLE", "QUERIES"]


def live_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.coalesce(overlay.replay(inputs.mapping_log(spark, sf_dir)), same=("seq", "zeroed"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.coalesce(overlay.replay(inputs.mapping_log(spark, sf_dir)), physical=False).select("device", "offset", "length", "zeroed")


@registered('SELECT device, off AS "offset", len AS length, seq, moffset, zeroed FROM view')
def overlay_live_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_view(spark, sf_dir).select("device", "offset", "length", "seq", "moffset", "zeroed")


@registered(
    """SELECT s.device, coalesce(d, 0) AS data_sectors, coalesce(z, 0) AS zero_sectors, s.sectors - coalesce(d, 0) - coalesce(z, 0) AS hole_sectors
    FROM sizes s LEFT JOIN (SELECT device, count(*) FILTER (NOT zeroed) AS d, count(*) FILTER (zeroed) AS z FROM live GROUP BY device) USING (device)"""
)
def overlay_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.state_counts(overlay.replay(inputs.mapping_log(spark, sf_dir)), inputs.sizes(spark, sf_dir))


@registered(
    """, best AS (SELECT * FROM sector_log QUALIFY row_number() OVER (PARTITION BY device, sector ORDER BY layer, seq DESC) = 1)
    SELECT device, layer, count(*) AS sectors, count(*) FILTER (zeroed) AS zero_sectors, CAST(coalesce(sum(place), 0) AS BIGINT) AS place_sum FROM best GROUP BY device, layer"""
)
def overlay_layer_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectors that each layer of a stack shows: every layer's log is resolved, then the stack is."""
    log = inputs.mapping_log(spark, sf_dir)
    each = overlay.replay(log.withColumn("device", F.col("device") * 256 + F.col("layer")))
    stack = overlay.merge_layers(each.withColumn("layer", (F.col("device") % 256).cast("int")).withColumn("device", F.expr("device div 256")))
    n = F.col("length")
    places = F.when(~F.col("zeroed"), F.col("moffset") * n + F.expr("length * (length - 1) div 2")).otherwise(0)
    return stack.groupBy("device", F.col("tag").cast("long").alias("layer")).agg(F.sum(n).alias("sectors"), F.sum(F.when(F.col("zeroed"), n).otherwise(0)).alias("zero_sectors"), F.sum(places).alias("place_sum"))


@registered('SELECT device, off AS "offset", len AS length, zeroed FROM states')
def interval_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir)


@registered('SELECT device, off + k * 16 AS "offset", least(16, len - k * 16) AS length, zeroed FROM (SELECT *, unnest(range((len + 15) // 16)) AS k FROM states)')
def interval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.split(states(spark, sf_dir), 16)


@registered(
    """, edges AS (SELECT device, off, len FROM states WHERE device IN (SELECT device FROM sizes) UNION ALL SELECT device, sectors, 0 FROM sizes),
    gaps AS (SELECT device, coalesce(lag(off + len) OVER (PARTITION BY device ORDER BY off, len), 0) AS low, off FROM edges)
    SELECT device, low AS "offset", off - low AS length FROM gaps WHERE off > low"""
)
def interval_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices = inputs.sizes(spark, sf_dir)
    return intervals.complement(states(spark, sf_dir).join(devices.select("device"), "device", "left_semi"), devices)


@registered(
    """, runs AS (SELECT device, sector, sector - row_number() OVER (PARTITION BY device ORDER BY sector) AS run FROM (SELECT DISTINCT device, sector FROM sector_log))
    SELECT device, min(sector) AS "offset", count(*) AS length FROM runs GROUP BY device, run"""
)
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.cover(inputs.mapping_log(spark, sf_dir))


@registered(
    """SELECT r.device, greatest(r.start_sector, s.off) AS "offset", least(r.start_sector + r.nr_sectors, s.off + s.len) - greatest(r.start_sector, s.off) AS length, r.start_sector AS a_offset, s.off AS b_offset
    FROM requests r JOIN states s ON r.device = s.device AND r.start_sector < s.off + s.len AND s.off < r.start_sector + r.nr_sectors"""
)
def interval_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = inputs.requests(spark, sf_dir).select("device", F.col("start_sector").alias("offset"), F.col("nr_sectors").alias("length"))
    return intervals.intersect(asked, states(spark, sf_dir))


@registered(
    """, gone AS (SELECT DISTINCT device, start_sector + k AS sector FROM (SELECT device, start_sector, unnest(range(nr_sectors)) AS k FROM requests))
    SELECT device, count(*) AS sectors, count(*) FILTER (zeroed) AS zero_sectors, CAST(coalesce(sum(place), 0) AS BIGINT) AS place_sum FROM live ANTI JOIN gone USING (device, sector) GROUP BY device"""
)
def interval_erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live sectors that are left after every request discards its range."""
    holes = inputs.requests(spark, sf_dir).select("device", F.col("start_sector").alias("offset"), F.col("nr_sectors").alias("length"))
    left = intervals.erase(live_view(spark, sf_dir), intervals.cover(holes))
    places = F.when(~F.col("zeroed"), F.col("moffset") * F.col("length") + F.expr("length * (length - 1) div 2")).otherwise(0)
    return left.groupBy("device").agg(F.sum("length").alias("sectors"), F.sum(F.when(F.col("zeroed"), F.col("length")).otherwise(0)).alias("zero_sectors"), F.sum(places).alias("place_sum"))


@registered(
    """SELECT device, off AS "offset", len AS length, zeroed,
      CASE WHEN NOT zeroed THEN 8 + CAST(sum(CASE WHEN zeroed THEN 0 ELSE len END) OVER (PARTITION BY device ORDER BY off) AS BIGINT) - len END AS packed FROM states"""
)
def interval_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.pack(states(spark, sf_dir))


@registered(
    """SELECT device, off AS "offset", len AS length, zeroed, off >= 2048 AS tail, CASE WHEN NOT zeroed THEN 8 + CAST(coalesce(before, 0) + CASE WHEN off >= 2048 THEN front ELSE 0 END AS BIGINT) END AS packed
    FROM (SELECT *, sum(n) OVER (PARTITION BY device, off >= 2048 ORDER BY off) - n AS before, sum(CASE WHEN off < 2048 THEN n ELSE 0 END) OVER (PARTITION BY device) AS front
      FROM (SELECT *, CASE WHEN zeroed THEN 0 ELSE len END AS n FROM states))"""
)
def interval_pack_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.pack_two(states(spark, sf_dir), F.col("offset") >= 2048)


@registered(
    """SELECT device, CAST(sum(CASE WHEN zeroed THEN 0 ELSE len END) * 512 AS BIGINT) AS data_bytes, count(*) * 16 AS index_bytes,
      CAST((sum(CASE WHEN zeroed THEN 0 ELSE len END) * 512 + 4096 + count(*) * 16 + 4095) // 4096 * 4096 + 4096 AS BIGINT) AS file_bytes FROM states GROUP BY device"""
)
def export_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.geometry(intervals.export_plan(live_view(spark, sf_dir)))


@registered(
    """, covered AS (SELECT device, request, count(*) AS held FROM (SELECT device, request, start_sector + k AS sector FROM (SELECT *, unnest(range(nr_sectors)) AS k FROM requests)) JOIN (SELECT * FROM live WHERE NOT zeroed) USING (device, sector) GROUP BY ALL)
    SELECT DISTINCT r.device, start_sector AS "offset", nr_sectors AS length, coalesce(held, 0) = nr_sectors AS is_data FROM requests r LEFT JOIN covered c ON r.device = c.device AND r.request = c.request"""
)
def interval_fully_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = inputs.requests(spark, sf_dir).select("device", F.col("start_sector").alias("offset"), F.col("nr_sectors").alias("length"))
    return intervals.fully_data(states(spark, sf_dir), asked)


@registered(
    """, asked AS (SELECT device, request, start_sector + k AS sector FROM (SELECT *, unnest(range(nr_sectors)) AS k FROM requests)),
    hit AS (SELECT a.device, a.request, a.sector, l.seq, l.zeroed, l.place FROM asked a LEFT JOIN live l ON a.device = l.device AND a.sector = l.sector),
    cut AS (SELECT *, sector - row_number() OVER (PARTITION BY device, request, seq ORDER BY sector) AS run FROM hit)
    SELECT device, request, min(sector) AS "offset", count(*) AS length, CASE WHEN seq IS NULL THEN 'hole' WHEN bool_and(zeroed) THEN 'zero' ELSE 'data' END AS state, min(place) AS moffset FROM cut GROUP BY device, request, seq, run"""
)
def lookup_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.pieces(inputs.requests(spark, sf_dir), live_view(spark, sf_dir))


@registered(
    """SELECT device, request, status, off // 512 AS start_sector, CASE WHEN status = 'read' THEN greatest(least(cnt, size - off), 0) // 512 ELSE 0 END AS nr_sectors FROM (
      SELECT b.*, sectors * 512 AS size, CASE WHEN off % 512 <> 0 OR cnt % 512 <> 0 THEN 'invalid' WHEN off >= sectors * 512 OR cnt = 0 THEN 'end' ELSE 'read' END AS status FROM byte_reads b JOIN sizes USING (device))"""
)
def lookup_read_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.read_plan(inputs.byte_reads(spark, sf_dir), inputs.sizes(spark, sf_dir))


@registered(
    """SELECT r.device, request, start_sector, v.off AS "offset", v.seq, start_sector - v.off AS distance
    FROM requests r ASOF LEFT JOIN view v ON r.device = v.device AND r.start_sector >= v.off"""
)
def lookup_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = inputs.requests(spark, sf_dir).select("device", "request", "start_sector")
    return lookup.as_of(points, live_view(spark, sf_dir).select("device", "offset", "seq"), "device", "start_sector", "offset")


@registered(
    """SELECT blob, idx, comp_size, block_offset, group_no, group_base, block_offset - group_base AS delta, comp_size > 0 AND (idx % 16 = 15 OR block_offset - group_base + comp_size < 65535) AS valid
    FROM (SELECT *, min(block_offset) OVER (PARTITION BY blob, group_no) AS group_base FROM (
      SELECT *, 512 + CAST(sum(comp_size) OVER (PARTITION BY blob ORDER BY idx) AS BIGINT) - comp_size AS block_offset, idx // 16 AS group_no FROM blocks))"""
)
def lookup_block_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.block_offsets(inputs.blocks(spark, sf_dir), "blob")


@registered(
    """SELECT eid, count(*) AS reads, CAST(sum(least(off + cnt, (eid + 1) * 65536) - greatest(off, eid * 65536)) AS BIGINT) AS bytes
    FROM (SELECT *, unnest(range(off // 65536, (off + cnt - 1) // 65536 + 1)) AS eid FROM byte_reads WHERE cnt > 0) GROUP BY eid"""
)
def lookup_extent_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookup.units_of(inputs.byte_reads(spark, sf_dir), 65536, "eid")
    return rows.groupBy("eid").agg(F.count("*").alias("reads"), F.sum("taken").alias("bytes"))


@registered(
    """, gone AS (SELECT device, eid, eid - row_number() OVER (PARTITION BY device ORDER BY eid) AS run FROM extents WHERE NOT present),
    runs AS (SELECT device, min(eid) AS first, count(*) AS n FROM gone GROUP BY device, run)
    SELECT device, first + k * 16 AS eid, least(16, n - k * 16) AS length FROM (SELECT *, unnest(range((n + 15) // 16)) AS k FROM runs)"""
)
def lookup_missing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.missing_runs(inputs.extents(spark, sf_dir), "device")


@registered("SELECT layer_index, count(*) AS n, CAST(sum(cnt) AS BIGINT) AS bytes FROM trace WHERE op = 'R' AND cnt BETWEEN 1 AND 1048576 AND off >= 0 GROUP BY layer_index")
def trace_conforming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.conforming(inputs.trace(spark, sf_dir)).groupBy("layer_index").agg(F.count("*").alias("n"), F.sum("count").alias("bytes"))


@registered("""SELECT device, ordinal, part, off + part * 1048576 AS "offset", least(1048576, cnt - part * 1048576) AS "count" FROM (SELECT *, unnest(range((cnt + 1048575) // 1048576)) AS part FROM trace)""")
def trace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.chunks(inputs.trace(spark, sf_dir)).select("device", "ordinal", "part", "offset", "count")


@registered(
    """, own AS (SELECT *, CASE WHEN op = 'R' AND layer_index < 6 AND cnt <= 1048576 THEN cnt ELSE 0 END AS taken_bytes, row_number() OVER (PARTITION BY device ORDER BY ordinal) AS rank FROM trace),
    total AS (SELECT *, sum(taken_bytes) OVER (PARTITION BY device ORDER BY ordinal) AS total FROM own),
    first_stop AS (SELECT device, min(rank) AS stop FROM total WHERE rank > 8 OR total - taken_bytes >= 2000000 OR total > 2000000 GROUP BY device)
    SELECT device, count(*) AS records_total, count(*) FILTER (rank < coalesce(stop, 1000000000) AND taken_bytes > 0) AS records_replayed, count(*) FILTER (rank < coalesce(stop, 1000000000) AND taken_bytes = 0) AS records_skipped,
      CAST(coalesce(sum(taken_bytes) FILTER (rank < coalesce(stop, 1000000000)), 0) AS BIGINT) AS bytes_requested, bool_or(stop IS NOT NULL) AS budget_exhausted FROM total LEFT JOIN first_stop USING (device) GROUP BY device"""
)
def trace_replay_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.replay_stats(inputs.trace(spark, sf_dir), F.lit(6), 8, 2_000_000)


@registered("SELECT device, op AS read_class, count(*) AS n, CAST(sum(cnt) AS BIGINT) AS bytes FROM trace GROUP BY device, op")
def admission_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.class_counts(inputs.trace(spark, sf_dir).withColumnRenamed("op", "read_class"))


@registered(
    """SELECT key, "start", done, flight, "start" <> flight OR joined AS joined FROM (SELECT *, max(CASE WHEN NOT joined THEN "start" END) OVER (PARTITION BY key ORDER BY "start", done ROWS UNBOUNDED PRECEDING) AS flight FROM (
      SELECT *, coalesce("start" < max(done) OVER (PARTITION BY key ORDER BY "start", done ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS joined FROM (SELECT device AS key, ordinal AS "start", ordinal + cnt % 97 AS done FROM trace)))"""
)
def admission_single_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetches = inputs.trace(spark, sf_dir).select(F.col("device").alias("key"), F.col("ordinal").alias("start"), (F.col("ordinal") + F.col("count") % 97).alias("done"))
    return admission.single_flights(fetches)


@registered(
    """, own AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY layer, path ORDER BY ordinal DESC) = 1),
    left_over AS (SELECT * FROM own o WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.layer > o.layer AND ((m.kind = 'whiteout' AND m.path = o.path) OR m.path = '' OR starts_with(o.path, m.path || '/'))))
    SELECT path, layer, ordinal, size FROM left_over QUALIFY row_number() OVER (PARTITION BY path ORDER BY layer DESC) = 1"""
)
def layers_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.tree(inputs.entries(spark, sf_dir), inputs.marks(spark, sf_dir)).select("path", "layer", "ordinal", "size")


@registered(
    """, parts AS (SELECT layer, string_split(path, '/') AS p FROM entries)
    SELECT DISTINCT layer, array_to_string(p[1:k], '/') AS path FROM (SELECT layer, p, unnest(range(1, len(p))) AS k FROM parts)"""
)
def layers_needed_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.needed_parents(inputs.entries(spark, sf_dir))


@registered("SELECT layer, count(*) AS files, 0 AS dirs, CAST(sum((coalesce(size, 0) + 4095) // 4096) AS BIGINT) AS blocks, max(len(string_split(path, '/'))) AS depth FROM entries GROUP BY layer")
def layers_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.capacity_estimate(inputs.entries(spark, sf_dir))


@registered(
    """, credentials AS (SELECT DISTINCT split_part(path, '/', 1) AS prefix FROM entries UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM entries WHERE contains(path, '/'))
    SELECT path AS url, max_by(prefix, length(prefix)) AS prefix FROM entries LEFT JOIN credentials ON path = prefix OR starts_with(path, prefix || '/') GROUP BY ordinal, path"""
)
def layers_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.entries(spark, sf_dir)
    parts = F.split("path", "/")
    hosts = rows.select(parts[0].alias("prefix"))
    dirs = rows.filter("contains(path, '/')").select(F.concat_ws("/", parts[0], parts[1]).alias("prefix"))
    known = hosts.union(dirs).distinct().withColumn("user", F.col("prefix"))
    return layers.longest_prefix(rows.select(F.col("path").alias("url")), known).select("url", "prefix")


@registered("""SELECT page_id, sha AS content_sha256, substr(sha, 1, 8) || '-' || substr(sha, 9, 4) || '-' || substr(sha, 13, 4) || '-' || substr(sha, 17, 4) || '-' || substr(sha, 21, 12) AS uuid FROM (SELECT page_id, sha256(coalesce(html, '')) AS sha FROM pages)""")
def checksum_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2(F.encode(F.coalesce("html", F.lit("")), "utf-8"), 256)
    return inputs.table(spark, sf_dir, "pages").select("page_id", sha.alias("content_sha256"), checksums.uuid_of(sha).alias("uuid"))


@registered()
def checksum_crc32c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw CRC-32C of whole pages; SQL has no such function."""
    return inputs.table(spark, sf_dir, "pages").select("page_id", checksums.salted_crc32c(F.encode("html", "utf-8")).alias("crc"))


# the other modules add theirs to the same book
from . import entry_queries, file_queries, log_queries, range_queries, rule_queries  # noqa: E402, F401
