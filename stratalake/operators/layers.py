"""Archive layers as relations: deletes, order, hard links, differences, chains.

A layer has entries (layer, ordinal, path, kind, link_target, ...), and deletes (layer, path, kind) of
kind whiteout, which removes an object with all below it, or opaque, which removes what is below a directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import rules
from .intervals import coalesce

#: Names that mark deletes in archives.
WHITEOUT, OPAQUE = ".wh.", ".wh..wh..opq"


def deletes(entries: DataFrame) -> DataFrame:
    """(layer, path, kind) of an archive's delete markers."""
    leaf = F.element_at(F.split("path", "/"), -1)
    above = F.when(F.instr("path", "/") > 0, F.substring(F.col("path"), F.lit(1), F.length("path") - F.length(leaf) - 1)).otherwise("")
    kind = F.when(leaf == OPAQUE, "opaque").when(leaf.startswith(WHITEOUT), "whiteout")
    target = F.when(leaf == OPAQUE, above).otherwise(F.concat(above, F.when(above != "", "/").otherwise(""), F.substring(leaf, len(WHITEOUT) + 1, 255)))
    return entries.select("layer", target.alias("path"), kind.alias("kind")).filter("kind is not null").distinct()


def objects(entries: DataFrame) -> DataFrame:
    """Entries that are no markers."""
    return entries.filter(~F.element_at(F.split("path", "/"), -1).startswith(WHITEOUT))


def remaining(lower: DataFrame, marks: DataFrame) -> DataFrame:
    """Lower objects that no mark removes.  Every object meets marks on its own path and on those above it in one equi-join."""
    rows = lower.select("path").distinct().withColumn("above", F.explode(F.concat(F.array(F.struct(F.col("path").alias("at"), F.lit(True).alias("own"))), F.transform(F.concat(F.array(F.lit("")), rules.parents(F.col("path"))), lambda p: F.struct(p.alias("at"), F.lit(False).alias("own"))))))
    gone = rows.join(marks.select(F.col("path").alias("mark"), "kind").distinct(), F.col("above.at") == F.col("mark")).filter((F.col("kind") == "whiteout") | ~F.col("above.own")).select("path").distinct()
    return lower.join(gone, "path", "left_anti")


def latest(entries: DataFrame) -> DataFrame:
    """The last entry of each path in the archive's order."""
    order = W.Window.partitionBy("layer", "path").orderBy(F.desc("ordinal"))
    return entries.withColumn("rank_", F.row_number().over(order)).filter("rank_ = 1").drop("rank_")


def tree(entries: DataFrame, marks: DataFrame) -> DataFrame:
    """(path, layer, ...) of a stack's final tree; layer 0 is the lowest.

    An object is hidden by a mark of any higher layer on it or above it, by an entry of a higher
    layer on its own path, and by a later entry of its own layer.
    """
    own = latest(objects(entries))
    above = F.concat(F.array(F.struct(F.col("path").alias("at"), F.lit(True).alias("own"))), F.transform(F.concat(F.array(F.lit("")), rules.parents(F.col("path"))), lambda p: F.struct(p.alias("at"), F.lit(False).alias("own"))))
    rows = own.select("path", "layer", F.explode(above).alias("above"))
    high = marks.groupBy(F.col("path").alias("mark"), "kind").agg(F.max("layer").alias("mark_layer"))
    gone = rows.join(high, F.col("above.at") == F.col("mark")).filter((F.col("mark_layer") > F.col("layer")) & ((F.col("kind") == "whiteout") | ~F.col("above.own"))).select("path", "layer").distinct()
    top = W.Window.partitionBy("path").orderBy(F.desc("layer"))
    return own.join(gone, ["path", "layer"], "left_anti").withColumn("rank_", F.row_number().over(top)).filter("rank_ = 1").drop("rank_")


def explicit_parents(marks: DataFrame, entries: DataFrame) -> DataFrame:
    """Marks whose directory the same layer also states."""
    return marks.join(entries.filter("kind = 'dir'").select("layer", "path").distinct(), ["layer", "path"], "left_semi")


def needed_parents(entries: DataFrame) -> DataFrame:
    """(layer, path) of directories that entries need and no entry states."""
    needed = entries.select("layer", F.explode(rules.parents(F.col("path"))).alias("path")).distinct()
    return needed.join(entries.filter("kind = 'dir'").select("layer", "path").distinct(), ["layer", "path"], "left_anti")


def hard_links(entries: DataFrame, most_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved): hard links (path, link_target) followed to a file (path, target, hops).

    Each round doubles what a pointer skips, so chains of 2**n links take n rounds; loops and links to nothing stay unresolved.
    """
    from ..plans.shared import cut

    files = entries.filter("kind = 'file'").select(F.col("path").alias("target")).distinct()
    links = cut(entries.filter("kind = 'hardlink'").select("path", F.col("link_target").alias("target"), F.lit(1).cast("long").alias("hops")).distinct())
    for _ in range(most_rounds):
        onward = links.select(F.col("path").alias("target"), F.col("target").alias("next"), F.col("hops").alias("more"))
        moved = cut(links.join(onward, "target", "left").select("path", F.coalesce("next", "target").alias("target"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
        before, after = (df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("path", "target")).alias("x")).first() for df in (links, moved))
        if before == after:
            break
        links = moved
    return links.join(files, "target", "left_semi").select("path", "target", "hops"), links.join(files, "target", "left_anti").select("path", "target")


def changed_sectors(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(device, sector, zeroed): sectors whose content digest differs, and sector 0 in any case."""
    both = current.join(previous.select("device", "sector", F.col("content").alias("old")), ["device", "sector"], "left")
    return both.filter((F.col("sector") == 0) | ~F.col("content").eqNullSafe(F.col("old"))).select("device", "sector", "zeroed")


def difference(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Segments of a differential layer: runs of changed sectors by whether they are all zeroes."""
    rows = changed_sectors(previous, current).select("device", F.col("sector").alias("offset"), F.lit(1).cast("long").alias("length"), "zeroed")
    return coalesce(rows, physical=False)


def broken_chain(layers: DataFrame) -> DataFrame:
    """Layers (image, layer, uuid, parent_uuid) whose parent is not the layer below; the lowest must have none."""
    below = F.lag("uuid").over(W.Window.partitionBy("image").orderBy("layer"))
    return layers.withColumn("expected", F.coalesce(below, F.lit(""))).filter(~F.col("parent_uuid").eqNullSafe(F.col("expected"))).select("image", "layer")


def stale(staged: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(nonce, missing): staged files and sidecars without their other half."""
    both = staged.select("nonce", F.lit(True).alias("a")).join(sidecars.select("nonce", F.lit(True).alias("b")), "nonce", "full_outer")
    return both.filter("a is null or b is null").select("nonce", F.when(F.col("a").isNull(), "staged").otherwise("sidecar").alias("missing"))


def replies(commands: DataFrame, answers: DataFrame) -> DataFrame:
    """Commands with their reply by sequence number; an answer to another generation, or after the deadline, is dropped."""
    timely = answers.select("device", "seq", F.col("generation").alias("answer_generation"), F.col("at").alias("answered_at"))
    hit = commands.join(timely, ["device", "seq"], "left")
    good = (F.col("answer_generation") == F.col("generation")) & (F.col("answered_at") <= F.col("deadline"))
    return hit.groupBy(*commands.columns).agg(F.min(F.when(good, F.col("answered_at"))).alias("answered_at"))


def block_mappings(entries: DataFrame, step: int = 512) -> DataFrame:
    """Payload spans (logical, stored, length in bytes) as whole sectors: (layer, path, offset, length, moffset, zeroed)."""
    rows = entries.select("layer", "path", F.explode("spans").alias("s")).select("layer", "path", "s.*")
    first = F.call_function("div", F.col("logical") + step - 1, F.lit(step))
    last = F.call_function("div", F.col("logical") + F.col("length"), F.lit(step))
    shift = first * step - F.col("logical")
    return rows.filter(last > first).select("layer", "path", first.alias("offset"), (last - first).alias("length"), F.call_function("div", F.col("stored") + shift, F.lit(step)).alias("moffset"), F.lit(False).alias("zeroed"))


def capacity_estimate(entries: DataFrame, block: int = 4096) -> DataFrame:
    """(layer, files, dirs, blocks, depth) of the entries of each layer."""
    size = F.call_function("div", F.coalesce("size", F.lit(0)).cast("long") + (block - 1), F.lit(block))
    return entries.groupBy("layer").agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "dir").alias("dirs"), F.sum(size).alias("blocks"), F.max(F.size(F.split("path", "/"))).cast("long").alias("depth"))


def node_counts(entries: DataFrame) -> DataFrame:
    """(layer, files, dirs, bytes) of the entries of each layer."""
    return entries.groupBy("layer").agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "dir").alias("dirs"), F.sum(F.col("size").cast("long")).alias("bytes"))


def class_runs(blocks: DataFrame) -> DataFrame:
    """Runs (device, offset, length, class) of classified blocks (device, block, class)."""
    return coalesce(blocks.select("device", F.col("block").alias("offset"), F.lit(1).cast("long").alias("length"), "class"), same=("class",), physical=False)


def longest_prefix(urls: DataFrame, credentials: DataFrame) -> DataFrame:
    """Each URL (url) with the most specific credential (prefix, user) that it starts with.

    A URL's own prefixes at its slashes meet the credentials in an equi-join; no pair is compared that doesn't share one.
    """
    bare = F.regexp_replace("url", r"^[a-z]+://", "")
    parts = F.split(bare, "/")
    own = urls.select("url").distinct().select("url", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))).alias("prefix"))
    best = own.join(credentials, "prefix").groupBy("url").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"), F.max_by("user", F.length("prefix")).alias("user"))
    return urls.join(best, "url", "left")


def first_present(candidates: DataFrame, order: Column) -> DataFrame:
    """(layer, path): the first of each layer's candidate places that exists."""
    return candidates.filter("exists").groupBy("layer").agg(F.min_by("path", order).alias("path"))
