"""Extent-shaped inputs derived from the star-schema tables, in Spark and as SQL common table expressions.

Integer arithmetic only, so both give the same rows.  `SQL` states every input once; a query's SQL
begins with it, and an expression that a query doesn't name costs nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators.spread import spread

SECTORS = 8192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device"), F.lit(SECTORS).cast("long").alias("sectors"))


def mapping_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device, seq, layer, offset, length, moffset, zeroed); a device's log is bounded by the format."""
    order = W.Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    rows = spread(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"), "l_suppkey").withColumn("seq", F.row_number().over(order).cast("long"))
    return rows.select(
        F.col("l_suppkey").alias("device"),
        "seq",
        (F.col("l_linenumber") - 1).cast("int").alias("layer"),
        (F.col("l_partkey") * 37 % 4096).alias("offset"),
        F.col("l_quantity").cast("long").alias("length"),
        (F.col("seq") * 64 + 8).alias("moffset"),
        (F.col("l_returnflag") == "R").alias("zeroed"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device, request, start_sector, nr_sectors)."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100 + 1).alias("device"), key.alias("request"), (key * 13 % 4096).alias("start_sector"), (key % 64 + 1).alias("nr_sectors"))


def byte_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device, request, offset, count) in bytes, some unaligned and some past the end."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100 + 1).alias("device"), key.alias("request"), (key * 7 % 9000 * 512 + F.when(key % 11 == 0, 100).otherwise(0)).alias("offset"), (key % 300 * 512).alias("count"))


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("device"),
        key.alias("ordinal"),
        F.when(F.col("event_type") == "error", "W").otherwise("R").alias("op"),
        (key % 8).alias("layer_index"),
        (key * 7919 % 2000000 + 1).alias("count"),
        (key * 4096 % (1 << 30)).alias("offset"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(blob, idx, comp_size)."""
    key = F.col("doc_id")
    return table(spark, sf_dir, "documents").select((key - key % 500).alias("blob"), (key % 500).alias("idx"), (F.col("n_chars") + 4).alias("comp_size"))


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device, eid, present)."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100 + 1).alias("device"), key.alias("eid"), (key % 3 == 0).alias("present")).distinct()


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, ordinal, path, kind, size) of archive layers."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 3).alias("layer"), F.col("page_id").alias("ordinal"), path.alias("path"), F.lit("file").alias("kind"), F.length("html").cast("long").alias("size"))
    return rows.filter("path <> ''")


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, path, kind): each entry deletes what lower layers have of its top directory, or only what is below it."""
    return entries(spark, sf_dir).select("layer", F.split("path", "/")[0].alias("path"), F.when(F.col("size") % 2 == 0, "opaque").otherwise("whiteout").alias("kind")).distinct()


SQL = f"""
WITH RECURSIVE sizes AS (SELECT s_suppkey AS device, CAST({SECTORS} AS BIGINT) AS sectors FROM supplier),
log AS (
  SELECT *, seq * 64 + 8 AS moffset FROM (
    SELECT l_suppkey AS device, l_linenumber - 1 AS layer, (l_partkey * 37) % 4096 AS off, CAST(l_quantity AS BIGINT) AS len, l_returnflag = 'R' AS zeroed,
      row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag) AS seq
    FROM lineitem)
),
touched AS (SELECT device, layer, seq, zeroed, moffset, unnest(range(len)) AS k, off FROM log),
sector_log AS (SELECT device, layer, seq, zeroed, off + k AS sector, CASE WHEN zeroed THEN NULL ELSE moffset + k END AS place FROM touched),
live AS (
  SELECT device, sector, seq, zeroed, place FROM sector_log
  QUALIFY row_number() OVER (PARTITION BY device, sector ORDER BY seq DESC) = 1
),
marked AS (
  SELECT *, CASE WHEN lag(sector) OVER w = sector - 1 AND lag(seq) OVER w = seq THEN 0 ELSE 1 END AS fresh,
    CASE WHEN lag(sector) OVER w = sector - 1 AND lag(zeroed) OVER w = zeroed THEN 0 ELSE 1 END AS fresh_state
  FROM live WINDOW w AS (PARTITION BY device ORDER BY sector)
),
numbered AS (
  SELECT *, sum(fresh) OVER w AS run, sum(fresh_state) OVER w AS state_run FROM marked
  WINDOW w AS (PARTITION BY device ORDER BY sector)
),
view AS (SELECT device, min(sector) AS off, count(*) AS len, min(seq) AS seq, min(place) AS moffset, bool_and(zeroed) AS zeroed FROM numbered GROUP BY device, run),
states AS (SELECT device, min(sector) AS off, count(*) AS len, bool_and(zeroed) AS zeroed FROM numbered GROUP BY device, state_run),
requests AS (SELECT o_custkey % 100 + 1 AS device, o_orderkey AS request, (o_orderkey * 13) % 4096 AS start_sector, o_orderkey % 64 + 1 AS nr_sectors FROM orders),
byte_reads AS (SELECT o_custkey % 100 + 1 AS device, o_orderkey AS request, ((o_orderkey * 7) % 9000) * 512 + CASE WHEN o_orderkey % 11 = 0 THEN 100 ELSE 0 END AS off, (o_orderkey % 300) * 512 AS cnt FROM orders),
trace AS (
  SELECT user_id AS device, event_id AS ordinal, CASE WHEN event_type = 'error' THEN 'W' ELSE 'R' END AS op, event_id % 8 AS layer_index,
    (event_id * 7919) % 2000000 + 1 AS cnt, (event_id * 4096) % 1073741824 AS off
  FROM events
),
blocks AS (SELECT doc_id - doc_id % 500 AS blob, doc_id % 500 AS idx, n_chars + 4 AS comp_size FROM documents),
extents AS (SELECT DISTINCT o_custkey % 100 + 1 AS device, o_orderkey AS eid, o_orderkey % 3 = 0 AS present FROM orders),
entries AS (
  SELECT * FROM (SELECT page_id % 3 AS layer, page_id AS ordinal, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, 'file' AS kind, length(html) AS size FROM pages)
  WHERE path <> ''
),
marks AS (SELECT DISTINCT layer, split_part(path, '/', 1) AS path, CASE WHEN size % 2 = 0 THEN 'opaque' ELSE 'whiteout' END AS kind FROM entries)
"""
