"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

An entry is a host and a path without scheme, like `example.net/en/`.  It fits its host and all
subdomains; an entry that ends in `/` fits every path that starts with its path, any other entry that
one path.  So a URL has one possible entry for each pair of a host suffix and a path prefix, of as many labels and
parts as any entry has; those are hashed and probed against the filter, first by host suffix alone, so that few
remain.  What passes is joined with the entries themselves, which removes what passed by chance.  The longest rule
decides; without a rule, a listed URL is blocked and any other allowed.

Rules are matched with the host and path as they stand in the URL; listed URLs are canonical, so they are matched with the URL's
canonical form: without user, port and final dots in the host, an empty path as `/`, dot segments resolved and escapes of
letters, digits and `-._~` undone.  International host names are compared as written.

Defined results: the host lies after the first `://` up to `/`, `?`, `#` or the end, with A-Z in
lower case; the path follows up to `?`, `#` or the end; of a null URL or one without `://` both are
empty, no entry fits and the verdict is allow.  Rows are kept one for one, repeated ones and null ids too; an empty table gives an
empty result.  Entries are taken as a set; of equal entries with different actions, a rule beats a listing and block beats allow.
The filter has a bounded size; the entries are broadcast only up to BROADCAST_ENTRIES (counted), beyond
that Spark joins by shuffle and splits skewed keys.  Probing is a map; only rows that passed it are shuffled, each under a key of its own, so
no popular URL is a hot key.  A host or path of any length costs its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .tables import mapped, pick

BROADCAST_ENTRIES = 50_000
#: The rules and the listed URLs of the registered query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
LISTED = tuple(f"{name}.example.{zone}/" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for zone in ("com", "net", "org"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def entries(spark: SparkSession, rules: Iterable[tuple[str, str]] = RULES, listed: Iterable[str] = LISTED) -> DataFrame:
    """(entry, action, is_rule) of rules and listed canonical URLs."""
    rows = [(e, a, True) for e, a in rules] + [(e, "block", False) for e in listed]
    return spark.createDataFrame(rows, "entry string, action string, is_rule boolean")


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _hashed(df: DataFrame, column: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_hash(t) for t in batch.column(0).to_pylist() if t is not None], np.uint64).view(np.int64))], ["key"])

    return mapped(df.select(column), run, "key long")


def suffixes(host: str, labels: int) -> Iterator[str]:
    """The ends of a host of at most so many labels, the shortest first."""
    at = len(host)
    for _ in range(labels):
        at = host.rfind(".", 0, at)
        yield host[at + 1 :]
        if at < 0:
            return


def prefixes(path: str, parts: int, longest: int) -> Iterator[str]:
    """The first so many parts of a path that end in `/`, and the whole path up to a length."""
    at = -1
    for _ in range(parts):
        at = path.find("/", at + 1)
        if at < 0:
            break
        yield path[: at + 1]
    if len(path) <= longest and not path.endswith("/"):
        yield path


_ESCAPE = re.compile(r"%(2[dDeE]|3[0-9]|4[1-9a-fA-F]|5[0-9aAfF]|6[1-9a-fA-F]|7[0-9aAeE])")


def canonical(host: str, path: str) -> tuple[str, str]:
    """Host and path in the form of listed URLs."""
    host = re.sub(r":[0-9]*$", "", host.rpartition("@")[2]).rstrip(".")
    if "%" in path:
        path = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), path)
    if "/." in path:
        out: list[str] = []
        parts = path.split("/")[1:]
        for p in parts:
            if p == "..":
                del out[-1:]
            elif p != ".":
                out.append(p)
        path = "/" + "/".join(out) + ("/" if parts[-1] in (".", "..") and out else "")
    return host, path or "/"


def possible(rows: DataFrame, hosts: np.ndarray, whole: np.ndarray, labels: int, parts: int, longest: int) -> DataFrame:
    """`rows` (page_id, host, path) with row, a number of its own, and entries: array of those (entry, as_written) that fit by form and pass the filters."""
    context = rows.sparkSession.sparkContext
    host_table, entry_table = context.broadcast(hosts), context.broadcast(whole)
    pairs = pa.list_(pa.struct([("entry", pa.string()), ("as_written", pa.bool_())]))

    def run(batches):
        n = TaskContext.get().partitionId() << 40
        for batch in batches:
            owner: list[tuple[int, bool, str]] = []
            names: list[str] = []
            for i, (host, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if not host:
                    continue
                plain = canonical(host, path)
                for as_written, (h, p) in ((True, (host, path)), (False, plain)):
                    for s in suffixes(h, labels):
                        owner.append((i, as_written, p))
                        names.append(s)
            live = np.flatnonzero(bloom.passes(host_table.value, np.array([_hash(s) for s in names], np.uint64))) if names else []
            of, found = [], []
            for j in live:
                i, as_written, path = owner[j]
                for p in prefixes(path, parts, longest):
                    of.append((i, as_written))
                    found.append(names[j] + p)
            keep = np.flatnonzero(bloom.passes(entry_table.value, np.array([_hash(s) for s in found], np.uint64))) if found else []
            entries_: list[list] = [[] for _ in range(batch.num_rows)]
            for k in keep:
                entries_[of[k][0]].append({"entry": found[k], "as_written": of[k][1]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(n, n + batch.num_rows)), pa.array(entries_, pairs)], ["page_id", "host", "path", "row", "entries"])
            n += batch.num_rows

    return mapped(rows, run, "page_id long, host string, path string, row long, entries array<struct<entry:string,as_written:boolean>>")


def judge(pages: DataFrame, known: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every row; `known` has entry, action and is_rule."""
    known = known.filter("entry is not null").groupBy("entry").agg(F.max(F.when(F.col("is_rule"), F.col("action"))).alias("rule_action"), F.max((~F.col("is_rule")).cast("int")).alias("listed"))
    known = known.withColumn("entry_host", F.regexp_extract("entry", r"^[^/]*", 0))
    own_path = F.substring(F.col("entry"), F.length("entry_host") + 1, F.length("entry"))
    most = known.agg(F.count("*").alias("n"), F.max(F.size(F.split("entry_host", "[.]"))).alias("labels"), F.max(F.length(own_path) - F.length(F.replace(own_path, F.lit("/")))).alias("parts"), F.max(F.length(own_path)).alias("longest")).first()
    whole = bloom.build(F.col("key"), _hashed(known, "entry"), most["n"])
    hosts = bloom.build(F.col("key"), _hashed(known.select("entry_host").distinct(), "entry_host"), most["n"])
    host, path = parts(F.col("url"))
    rows = pick(pages, **{id_col: "long", url_col: "string"}).toDF("page_id", "url").select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    probed = possible(rows, hosts, whole, most["labels"] or 0, most["parts"] or 0, most["longest"] or 0)
    small = F.broadcast(known) if most["n"] <= BROADCAST_ENTRIES else known
    maybe = probed.filter(F.size("entries") > 0).select("page_id", "host", "path", "row", F.explode("entries").alias("e")).select("page_id", "host", "path", "row", "e.entry", "e.as_written")
    hits = maybe.join(small.drop("entry_host"), "entry", "left")
    best = hits.groupBy("page_id", "host", "path", "row").agg(
        F.max(F.when(F.col("as_written") & F.col("rule_action").isNotNull(), F.struct(F.length("entry").alias("n"), F.col("entry"), F.col("rule_action")))).alias("best"),
        F.coalesce(F.bool_or(~F.col("as_written") & (F.col("listed") == 1)), F.lit(False)).alias("listed"),
    )
    judged = best.select("page_id", "host", "path", F.col("best.entry").alias("rule"), F.coalesce("best.rule_action", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
    none = probed.filter(F.size("entries") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(False).alias("listed"))
    return none.unionByName(judged)


#: The same for DuckDB, with the registered query's rules and list; all listed paths are `/`, so that escapes and dot segments don't matter.
ORACLE_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM cut),
named AS (SELECT page_id, translate(coalesce(raw_host, ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*'), '') AS path, row_number() OVER () AS row_no FROM split),
plain AS (SELECT *, rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS plain_host FROM named),
known(entry, action, is_rule) AS (VALUES {", ".join([f"('{e}', '{a}', true)" for e, a in RULES] + [f"('{e}', 'block', false)" for e in LISTED])}),
parted AS (SELECT *, regexp_extract(entry, '^[^/]*') AS own_host, regexp_replace(entry, '^[^/]*', '') AS own_path FROM known),
fits AS (SELECT n.row_no, k.* FROM plain n JOIN parted k ON (k.is_rule AND (n.host = own_host OR ends_with(n.host, '.' || own_host)) AND starts_with(n.path, own_path)) OR (NOT k.is_rule AND (n.plain_host = own_host OR ends_with(n.plain_host, '.' || own_host)))),
best AS (SELECT row_no, arg_max(entry, length(entry)) FILTER (WHERE is_rule) AS rule, arg_max(action, length(entry)) FILTER (WHERE is_rule) AS action, bool_or(NOT is_rule) AS listed FROM fits GROUP BY row_no)
SELECT n.page_id, n.host, n.path, b.rule, coalesce(b.action, CASE WHEN b.listed THEN 'block' ELSE 'allow' END) AS verdict, coalesce(b.listed, false) AS listed
FROM named n LEFT JOIN best b USING (row_no)
"""
