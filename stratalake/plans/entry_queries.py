"""Queries of archive layers, chains and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layers
from . import inputs
from .book import Given, registered

DIRS = Given("part", layer="p_partkey % 3", ordinal="p_partkey", kind="CASE WHEN p_partkey % 4 = 0 THEN 'dir' ELSE 'file' END", path="'d' || CAST(p_partkey % 17 AS STRING) || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '/f' || CAST(p_partkey AS STRING) END", size="p_size")
MARKS = Given("part", layer="p_partkey % 3", path="'d' || CAST(p_partkey % 5 AS STRING)", kind="CASE WHEN p_size % 2 = 0 THEN 'opaque' ELSE 'whiteout' END")


@registered(f"SELECT DISTINCT m.* FROM {MARKS.sql} m SEMI JOIN (SELECT layer, path FROM {DIRS.sql} WHERE kind = 'dir') USING (layer, path)", plain=True)
def layers_explicit_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.explicit_parents(MARKS.frame(spark, sf_dir).distinct(), DIRS.frame(spark, sf_dir))


@registered(f"""SELECT path FROM (SELECT DISTINCT path FROM {DIRS.sql}) o WHERE NOT EXISTS (SELECT 1 FROM {MARKS.sql} m WHERE (m.kind = 'whiteout' AND m.path = o.path) OR starts_with(o.path, m.path || '/'))""", plain=True)
def layers_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower objects that no mark removes."""
    return layers.remaining(DIRS.frame(spark, sf_dir), MARKS.frame(spark, sf_dir)).select("path").distinct()


@registered(f"SELECT layer, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'dir') AS dirs, CAST(sum(size) AS BIGINT) AS bytes FROM {DIRS.sql} GROUP BY layer", plain=True)
def layers_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.node_counts(DIRS.frame(spark, sf_dir))


LINKS = Given("customer", path="'n' || CAST(c_custkey AS STRING)", kind="CASE WHEN c_custkey % 10 = 0 THEN 'file' ELSE 'hardlink' END", link_target="CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 97 = 5 THEN 'nothing' WHEN c_custkey % 53 = 7 THEN 'n' || CAST(c_custkey AS STRING) ELSE 'n' || CAST(c_custkey - 1 AS STRING) END")


@registered(
    f"""WITH RECURSIVE walk AS (SELECT path, link_target AS target, 1 AS hops FROM {LINKS.sql} WHERE kind = 'hardlink'
      UNION ALL SELECT w.path, l.link_target, w.hops + 1 FROM walk w JOIN {LINKS.sql} l ON w.target = l.path AND l.kind = 'hardlink' WHERE w.hops < 20)
    SELECT w.path, target, hops FROM walk w JOIN {LINKS.sql} f ON w.target = f.path AND f.kind = 'file'""",
    plain=True,
)
def layers_hard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.hard_links(LINKS.frame(spark, sf_dir))[0]


CANDIDATES = Given("lineitem", layer="l_orderkey", place="l_linenumber", path="'p' || CAST(l_linenumber AS STRING)", exists="l_partkey % 3 = 0")


@registered(f"SELECT layer, arg_min(path, place) AS path FROM {CANDIDATES.sql} WHERE exists GROUP BY layer", plain=True)
def layers_first_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.first_present(CANDIDATES.frame(spark, sf_dir), F.col("place"))


CHAIN = Given("lineitem", image="l_orderkey", layer="l_linenumber", part="l_partkey", name="'u' || CAST(l_linenumber AS STRING)", parent="CASE WHEN l_linenumber = 1 THEN '' WHEN l_partkey % 19 = 0 THEN 'other' ELSE 'u' || CAST(l_linenumber - 1 AS STRING) END")


@registered(f"SELECT image, layer FROM (SELECT image, layer, max(parent) AS parent, coalesce(lag(max(name)) OVER (PARTITION BY image ORDER BY layer), '') AS expected FROM {CHAIN.sql} GROUP BY image, layer) WHERE parent <> expected", plain=True)
def layers_broken_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = CHAIN.frame(spark, sf_dir).groupBy("image", "layer").agg(F.max("name").alias("uuid"), F.max("parent").alias("parent_uuid"))
    return layers.broken_chain(rows)


STAGED = Given("orders", nonce="o_orderkey * 2")
SIDECARS = Given("orders", nonce="o_orderkey * 3")


@registered(f"SELECT coalesce(a.nonce, b.nonce) AS nonce, CASE WHEN a.nonce IS NULL THEN 'staged' ELSE 'sidecar' END AS missing FROM {STAGED.sql} a FULL JOIN {SIDECARS.sql} b ON a.nonce = b.nonce WHERE a.nonce IS NULL OR b.nonce IS NULL", plain=True)
def layers_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.stale(STAGED.frame(spark, sf_dir), SIDECARS.frame(spark, sf_dir))


OLD = Given("lineitem", device="l_suppkey", sector="l_partkey", content="l_partkey * 7 % 5 + l_suppkey % 2")
NEW = Given("lineitem", device="l_suppkey", sector="l_partkey", content="l_partkey * 7 % 5 + CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_suppkey % 2 END", zeroed="l_partkey % 4 = 0")


@registered(
    f""", old AS (SELECT DISTINCT * FROM {OLD.sql}), fresh AS (SELECT DISTINCT * FROM {NEW.sql}),
    changed AS (SELECT f.device, f.sector, f.zeroed FROM fresh f LEFT JOIN old o ON f.device = o.device AND f.sector = o.sector WHERE f.sector = 0 OR o.content IS DISTINCT FROM f.content),
    runs AS (SELECT *, sector - row_number() OVER (PARTITION BY device, zeroed ORDER BY sector) AS run FROM changed)
    SELECT device, min(sector) AS "offset", count(*) AS length, zeroed FROM runs GROUP BY device, zeroed, run"""
)
def layers_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a differential layer between two images of the same sectors."""
    return layers.difference(OLD.frame(spark, sf_dir).distinct(), NEW.frame(spark, sf_dir).distinct())


PAYLOADS = Given("orders", path="CAST(o_orderkey AS STRING)", logical="o_orderkey % 7 * 300", stored="(o_orderkey * 5000) - (o_orderkey * 5000) % 512 + (o_orderkey % 7 * 300) % 512", length="o_orderkey % 5000")


@registered(
    f"""SELECT path, first AS "offset", last - first AS length, (stored + first * 512 - logical) // 512 AS moffset FROM (SELECT *, (logical + 511) // 512 AS first, (logical + length) // 512 AS last FROM {PAYLOADS.sql}) WHERE last > first""",
    plain=True,
)
def layers_block_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sectors of files' payloads."""
    rows = PAYLOADS.frame(spark, sf_dir).select(F.lit(0).alias("layer"), "path", F.array(F.struct("logical", "stored", "length")).alias("spans"))
    return layers.block_mappings(rows).select("path", "offset", "length", "moffset")


URLS = Given("pages", page="page_id", url="url")


@registered(
    """SELECT page, path, kind FROM (SELECT page_id AS page, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS p, page_id % 5 AS k FROM pages WHERE url IS NOT NULL),
      LATERAL (SELECT CASE k WHEN 0 THEN array_to_string(p[1:len(p) - 1], '/') ELSE array_to_string(p, '/') END AS path, CASE k WHEN 0 THEN 'opaque' ELSE 'whiteout' END AS kind) WHERE k < 2""",
    plain=True,
)
def layers_delete_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What marker names of an archive delete: an opaque marker its directory's content, a whiteout the named object."""
    parts = F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/", -1)
    above = F.concat_ws("/", F.slice(parts, F.lit(1), F.size(parts) - 1))
    slash = F.when(F.size(parts) > 1, "/").otherwise("")
    leaf = F.when(F.col("page") % 5 == 0, ".wh..wh..opq").when(F.col("page") % 5 == 1, F.concat(F.lit(".wh."), F.element_at(parts, -1))).otherwise(F.element_at(parts, -1))
    rows = URLS.frame(spark, sf_dir).filter("url is not null").select(F.col("page").alias("layer"), F.concat(above, slash, leaf).alias("path"))
    return layers.deletes(rows).withColumnRenamed("layer", "page")


PAX = Given("orders", k="o_orderkey", common="CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END", own="CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'c' ELSE 'b' END", value="CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey AS STRING) END")


@registered(
    f"""SELECT k, key, value FROM (SELECT k, common AS key, 'common' AS value FROM {PAX.sql} WHERE common <> own UNION ALL SELECT k, own, value FROM {PAX.sql}) WHERE value <> ''""",
    plain=True,
)
def layers_merged_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header records of an entry over those of its archive; an empty value removes a key."""
    from ..functions import rules

    merged = rules.merged_pax(F.create_map(F.col("common"), F.lit("common")), F.create_map(F.col("own"), F.col("value")))
    return PAX.frame(spark, sf_dir).select("k", F.explode(merged).alias("key", "value"))
