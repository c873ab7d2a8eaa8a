"""Queries of logs, writes, traces, admission and device life."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission, intervals, layers, lookup, overlay, trace, writes
from . import inputs
from .book import Given, registered
from .range_queries import SUMS, summed

HYBRID = "device, seq, CASE WHEN seq % 17 = 0 THEN 1125899906842623 ELSE off END AS off, CASE WHEN seq % 17 = 0 THEN 0 ELSE len END AS len, moffset, zeroed"


def hybrid_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with every seventeenth record as padding."""
    log = inputs.mapping_log(spark, sf_dir)
    padding = F.col("seq") % 17 == 0
    return log.withColumn("offset", F.when(padding, F.lit((1 << 50) - 1)).otherwise(F.col("offset"))).withColumn("length", F.when(padding, F.lit(0)).otherwise(F.col("length")))


@registered(
    f""", own AS (SELECT device, seq, zeroed, off + k AS sector, CASE WHEN zeroed THEN NULL ELSE moffset + k END AS place FROM (SELECT *, unnest(range(len)) AS k FROM (SELECT {HYBRID} FROM log))),
    best AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY device, sector ORDER BY seq DESC) = 1)
    SELECT device, {SUMS} FROM best GROUP BY device"""
)
def log_replay_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other dialect's replay."""
    return summed(overlay.replay(hybrid_log(spark, sf_dir), "hybrid"))


@registered(
    f"""SELECT device, seq, reason FROM (SELECT device, seq, CASE WHEN off = 1125899906842623 AND len = 0 THEN CASE WHEN moffset <> 0 OR zeroed THEN 'padding' END WHEN len <= 0 OR off >= 4000 OR off + len > 4000 THEN 'logical'
      WHEN zeroed AND (moffset < 8 OR moffset > 30000) THEN 'zero marker' WHEN NOT zeroed AND (moffset < 8 OR moffset + len > 30000) THEN 'data' END AS reason FROM (SELECT {HYBRID} FROM log)) WHERE reason IS NOT NULL"""
)
def log_invalid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a replay of the other dialect refuses, for devices of 4000 sectors with 30000 of data."""
    return overlay.invalid_records(hybrid_log(spark, sf_dir), F.lit(4000), F.lit(30000), "hybrid").select("device", "seq", "reason")


@registered(f"SELECT device, CAST(sum(CASE WHEN zeroed THEN 8 ELSE place END) AS BIGINT) AS marks FROM live GROUP BY device")
def log_normal_zeroes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the live view where zeroes have their placeholder."""
    view = overlay.normal_zeroes(overlay.replay(inputs.mapping_log(spark, sf_dir)))
    total = F.when(F.col("zeroed"), F.col("moffset") * F.col("length")).otherwise(F.expr("moffset * length + length * (length - 1) div 2"))
    return view.groupBy("device").agg(F.sum(total).alias("marks"))


@registered("""SELECT device, request, off // 4096 * 8 AS "offset", ((off + cnt + 4095) // 4096 - off // 4096) * 8 AS length FROM byte_reads WHERE cnt > 0 AND off % 512 = 0""")
def write_copied_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes widened to whole blocks of 4 KiB."""
    rows = inputs.byte_reads(spark, sf_dir).filter("count > 0 and offset % 512 = 0").selectExpr("device", "request", "offset div 512 AS offset", "count div 512 AS length")
    return intervals.copied_up(rows)


@registered("""SELECT device, seq, off + k * 7 AS "offset", least(7, len - k * 7) AS length, zeroed FROM (SELECT *, unnest(range((len + 6) // 7)) AS k FROM log WHERE zeroed)""")
def write_discards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discards as zero records of a length that the format bounds, here 7 sectors."""
    return writes.discards(inputs.mapping_log(spark, sf_dir).filter("zeroed"), 7).select("device", "seq", "offset", "length", "zeroed")


@registered(
    f"""SELECT device, count(*) AS records, CAST(sum(len) AS BIGINT) AS sectors, count(*) FILTER (zeroed) AS zeroes FROM (
      SELECT device, zeroed, count(*) AS len FROM (SELECT *, sum(fresh) OVER (PARTITION BY device ORDER BY sector) AS run FROM (
        SELECT *, CASE WHEN lag(sector) OVER w = sector - 1 AND lag(zeroed) OVER w = zeroed AND (zeroed OR lag(place) OVER w = place - 1) THEN 0 ELSE 1 END AS fresh FROM live WINDOW w AS (PARTITION BY device ORDER BY sector))) GROUP BY device, run, zeroed) GROUP BY device"""
)
def log_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a fresh log that holds the live view alone."""
    fresh = writes.compacted(inputs.mapping_log(spark, sf_dir))
    return fresh.groupBy("device").agg(F.count("*").alias("records"), F.sum("length").alias("sectors"), F.count_if("zeroed").alias("zeroes"))


@registered("SELECT device, count(*) AS records, greatest(100, 2 * live + 16) AS threshold, count(*) >= greatest(100, 2 * live + 16) AS due FROM log JOIN (SELECT device, count(*) AS live FROM view GROUP BY device) USING (device) GROUP BY device, live")
def log_compaction_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices whose log is long against what is live of it."""
    log = inputs.mapping_log(spark, sf_dir)
    live = intervals.coalesce(overlay.replay(log), same=("seq", "zeroed"))
    return writes.compaction_due(log, live, 100)


@registered("""SELECT device, seq, off AS "offset", len AS length FROM log WHERE seq <= 300""")
def log_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records up to a log's room, here 300."""
    return writes.admitted(inputs.mapping_log(spark, sf_dir), 300).select("device", "seq", "offset", "length")


STAMPS = Given("orders", device="o_custkey", generation="o_orderkey % 3", bytes="o_orderkey * 16", verified="o_orderkey % 4 <> 0", committed="o_orderkey % 5 = 0")


@registered(
    f"""SELECT device, generation, coalesce(max(bytes) FILTER (verified), max(bytes) FILTER (committed)) AS bytes FROM {STAMPS.sql} GROUP BY device, generation HAVING count(*) FILTER (verified OR committed) > 0""",
    plain=True,
)
def log_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest verified prefix of each log, or else the committed one."""
    return writes.usable_prefix(STAMPS.frame(spark, sf_dir))


GROWS = Given("orders", device="o_custkey", ordinal="o_orderkey", size="o_orderkey * 7919 % 100000 * 512")


@registered(f"SELECT device, ordinal, size, size >= coalesce(max(size) OVER (PARTITION BY device ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS accepted, max(size) OVER (PARTITION BY device ORDER BY ordinal) AS now FROM {GROWS.sql}", plain=True)
def write_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resizes in order: smaller ones than the size at the time are refused."""
    return writes.resized(GROWS.frame(spark, sf_dir))


@registered(
    """SELECT device, count(*) AS reads, CAST(sum(taken) AS BIGINT) AS bytes FROM (SELECT device, off + cnt - greatest(off, 5000) AS taken FROM trace WHERE op = 'R' AND cnt > 0 AND cnt % 7 <> 0 AND off + cnt > 5000) GROUP BY device"""
)
def trace_tapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full on-demand reads behind a wrapper header of 5000 bytes."""
    reads = inputs.trace(spark, sf_dir).withColumn("read_class", F.when(F.col("op") == "R", "ondemand").otherwise("prefetch")).withColumn("result", F.when(F.col("count") % 7 == 0, F.col("count") - 1).otherwise(F.col("count")))
    return trace.tapped(reads, F.lit(5000)).groupBy("device").agg(F.count("*").alias("reads"), F.sum("count").alias("bytes"))


@registered("SELECT device, count(*) FILTER (layer_index < 5) AS known, count(*) FILTER (layer_index >= 5) AS misses FROM trace GROUP BY device")
def trace_known_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.trace(spark, sf_dir)
    held, misses = lookup.known_layers(rows, rows.filter("layer_index < 5").select("device").distinct().crossJoin(spark.range(5).select(F.col("id").alias("layer_index"))))
    out = held.groupBy("device").agg(F.count("*").alias("known")).join(misses, "device", "full_outer")
    return out.select("device", F.coalesce("known", F.lit(0)).alias("known"), F.coalesce("misses", F.lit(0)).alias("misses"))


WINDOWS = Given("events", device="user_id", layer_index="event_id % 5", outcome="CASE event_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'populated' END", bytes="CASE WHEN event_id % 4 >= 2 THEN event_id % 65536 ELSE 0 END")


@registered(
    f"""SELECT device, count(DISTINCT layer_index) AS layers_total, count(DISTINCT layer_index) FILTER (bytes > 0) AS layers_warmed, count(*) FILTER (outcome = 'populated') AS windows_populated, count(*) FILTER (outcome = 'failed') AS windows_failed,
    count(*) FILTER (outcome = 'skipped') AS windows_skipped, CAST(sum(bytes) AS BIGINT) AS bytes_warmed FROM {WINDOWS.sql} GROUP BY device""",
    plain=True,
)
def trace_warm_up_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.warm_up_stats(WINDOWS.frame(spark, sf_dir))


@registered(
    """, rec AS (SELECT device, ordinal, layer_index, off, cnt, row_number() OVER (PARTITION BY device ORDER BY ordinal) AS i FROM (SELECT device, ordinal, layer_index % 2 AS layer_index, (ordinal // 3) * 1000 + (ordinal % 3) * 300 AS off, 300 AS cnt FROM trace)),
    fold AS (SELECT device, i, i AS first, layer_index, off, cnt FROM rec WHERE i = 1
      UNION ALL SELECT r.device, r.i, CASE WHEN f.layer_index = r.layer_index AND f.off + f.cnt = r.off AND f.cnt + r.cnt <= 500 THEN f.first ELSE r.i END, r.layer_index,
        CASE WHEN f.layer_index = r.layer_index AND f.off + f.cnt = r.off AND f.cnt + r.cnt <= 500 THEN f.off ELSE r.off END, CASE WHEN f.layer_index = r.layer_index AND f.off + f.cnt = r.off AND f.cnt + r.cnt <= 500 THEN f.cnt + r.cnt ELSE r.cnt END
      FROM fold f JOIN rec r ON r.device = f.device AND r.i = f.i + 1)
    SELECT device, row_number() OVER (PARTITION BY device ORDER BY first) - 1 AS ordinal, layer_index, off AS "offset", cnt AS "count" FROM (SELECT device, first, any_value(layer_index) AS layer_index, any_value(off) AS off, max(cnt) AS cnt FROM fold GROUP BY device, first)"""
)
def trace_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recording keeps of reads of 300 bytes that join up to 500; the SQL walks the records one by one."""
    rows = inputs.trace(spark, sf_dir).selectExpr("device", "ordinal", "layer_index % 2 AS layer_index", "300L AS count", "(ordinal div 3) * 1000 + (ordinal % 3) * 300 AS offset")
    return trace.record(rows, cap=500).select("device", "ordinal", "layer_index", "offset", "count")


@registered(
    """SELECT event_id, user_id AS device FROM events JOIN (SELECT user_id AS u, min(ts) AS start_ts, CASE WHEN user_id % 2 = 0 THEN 0 ELSE 7200 END AS seconds FROM events GROUP BY user_id) ON user_id = u
    WHERE ts >= start_ts AND epoch_us(ts) < (epoch_us(start_ts) // 1000000 + least(greatest(seconds, 1), 3600)) * 1000000""",
    plain=True,
)
def trace_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within a device's recording window, whose length is kept between a second and an hour."""
    events = inputs.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("device"), "ts")
    starts = events.groupBy("device").agg(F.min("ts").alias("start_ts")).withColumn("seconds", F.when(F.col("device") % 2 == 0, 0).otherwise(7200))
    return trace.in_window(events, starts).select("event_id", "device")


@registered(
    """, s AS (SELECT user_id AS device, greatest((event_id * 104729) % 9000000 + 500000, 1000000) AS nanos, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    fold AS (SELECT device, i, nanos AS b, 4::BIGINT AS w FROM s WHERE i = 1
      UNION ALL SELECT s.device, s.i, (f.b * 7 + s.nanos) // 8, CASE WHEN s.nanos > f.b * 150 // 100 THEN greatest(1, f.w * 50 // 100) ELSE least(64, f.w + 1) END FROM fold f JOIN s ON s.device = f.device AND s.i = f.i + 1)
    SELECT device, max(i) AS samples, arg_max(b, i) AS baseline, arg_max(w, i) AS "window" FROM fold GROUP BY device"""
)
def admission_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold over each device's latencies; the SQL walks the samples one by one."""
    key = F.col("event_id")
    samples = inputs.table(spark, sf_dir, "events").select(F.col("user_id").alias("device"), key.alias("ordinal"), (key * 104729 % 9000000 + 500000).alias("nanos"))
    return admission.window_fold(samples)


WAITING = Given("events", device="user_id", arrival="event_id", read_class="CASE event_id % 3 WHEN 0 THEN 'fill' WHEN 1 THEN 'prefetch' ELSE 'ondemand' END")


@registered(f"SELECT device, arrival, read_class, row_number() OVER (PARTITION BY device ORDER BY CASE read_class WHEN 'ondemand' THEN 0 WHEN 'prefetch' THEN 1 ELSE 2 END, arrival) AS place FROM {WAITING.sql}", plain=True)
def admission_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.admission_order(WAITING.frame(spark, sf_dir))


@registered("SELECT device, second, CAST(sum(cnt) AS BIGINT) AS bytes FROM (SELECT user_id % 5 AS device, date_trunc('second', ts) AS second, event_id % 1000 AS cnt FROM events) GROUP BY ALL HAVING sum(cnt) > 900", plain=True)
def admission_over_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = inputs.table(spark, sf_dir, "events").selectExpr("user_id % 5 AS device", "ts", "event_id % 1000 AS count")
    return admission.over_rate(reads, 900)


@registered("SELECT user_id AS device, event_id % 9 + 1 AS attempt, least(64, 2 ** (event_id % 9 + 1))::BIGINT AS wait_s FROM events", plain=True)
def admission_backoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.backoffs(inputs.table(spark, sf_dir, "events").selectExpr("user_id AS device", "event_id % 9 + 1 AS attempt"))


@registered("SELECT device, event, count(*) AS n FROM (SELECT user_id AS device, event_type AS event FROM events) GROUP BY ALL", plain=True)
def admission_event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a store by kind of event."""
    return admission.counters(inputs.table(spark, sf_dir, "events").selectExpr("user_id AS device", "event_type AS event"))


ATTEMPTS = Given("events", device="user_id % 40", ordinal="event_id", outcome="CASE WHEN event_id % 11 < 3 THEN 'exit' WHEN event_id % 11 = 3 THEN 'running' ELSE 'status' END")


@registered(
    f"""SELECT device, generation, count(*) FILTER (outcome = 'exit') AS exits, count(*) FILTER (outcome = 'exit') > 3 AS given_up FROM (
      SELECT *, coalesce(sum(CASE WHEN outcome = 'running' THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY ordinal), 0)::BIGINT AS generation FROM {ATTEMPTS.sql}) GROUP BY device, generation""",
    plain=True,
)
def admission_recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A device's exits between two times that it ran; after more than three it is given up."""
    return admission.recoveries(ATTEMPTS.frame(spark, sf_dir), 3)


COMMANDS = Given("orders", device="o_custkey", seq="o_orderkey", generation="o_orderkey % 2", deadline="o_orderkey * 10 + 50")
ANSWERS = Given("orders", device="o_custkey", seq="o_orderkey", generation="CASE WHEN o_orderkey % 7 = 0 THEN 5 ELSE o_orderkey % 2 END", at="o_orderkey * 10 + o_orderkey % 90")


@registered(f"""SELECT c.device, c.seq, c.generation, c.deadline, min(a."at") FILTER (a.generation = c.generation AND a."at" <= c.deadline) AS answered_at FROM {COMMANDS.sql} c LEFT JOIN {ANSWERS.sql} a ON c.device = a.device AND c.seq = a.seq GROUP BY ALL""", plain=True)
def commands_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands with their reply; those of another generation and late ones are dropped."""
    return layers.replies(COMMANDS.frame(spark, sf_dir), ANSWERS.frame(spark, sf_dir))
