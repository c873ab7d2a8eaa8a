"""Configurations, control commands and status lines: JSON texts as typed columns, inside the engine.

Unknown fields are ignored; a field of a wrong type makes its text invalid, with an error that names it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

_LOWER = "struct<digest:string,size:long,dir:string,file:string,targetFile:string,targetDigest:string,gzipIndex:string>"
_DOWNLOAD = "struct<enable:boolean,delay:long,delayExtra:long,maxMBps:long,tryCnt:long,blockSize:long>"
IMAGE = f"repoBlobUrl string, lowers array<{_LOWER}>, upper struct<dir:string,type:string>, resultFile string, accelerationLayer boolean, download {_DOWNLOAD}"
GLOBAL = f"credentialConfig struct<mode:string,path:string>, p2pConfig struct<enable:boolean,address:string>, download {_DOWNLOAD}, ublkConfig struct<enableRecovery:boolean,queues:long,workers:long>, logConfig struct<logLevel:int>, prefetch struct<enable:boolean,head_kb:long,tail_kb:long>"
#: What a download section means where it is silent.
DOWNLOAD = {"enable": False, "delay": 300, "delayExtra": 30, "maxMBps": 100, "tryCnt": 5, "blockSize": 256 * 1024}
MAX_U32 = (1 << 32) - 1
HEX64 = "^sha256:[0-9a-f]{64}$"


def download(section: Column, defaults: Column | None = None) -> Column:
    """A download section over defaults (a struct of the same fields)."""
    return F.struct(*(F.coalesce(section[name], defaults[name] if defaults is not None else F.lit(value)).alias(name) for name, value in DOWNLOAD.items()))


def global_config(texts: DataFrame, credentials: str) -> DataFrame:
    """`texts` (text) with config, defaults filled in, and error; `credentials` is the file that a configuration without a path means."""
    j = F.from_json("text", GLOBAL)
    kb = lambda c: F.coalesce(c, F.lit(1024).cast("long"))
    own = F.struct(
        F.when(j["credentialConfig"].isNotNull() & (F.coalesce(j["credentialConfig"]["mode"], F.lit("file")) == "file"), F.coalesce(j["credentialConfig"]["path"], F.lit(credentials))).alias("credential_file"),
        F.coalesce(j["p2pConfig"]["enable"], F.lit(False)).alias("p2p_enable"),
        F.coalesce(j["p2pConfig"]["address"], F.lit("")).alias("p2p_address"),
        download(j["download"]).alias("download"),
        F.coalesce(j["prefetch"]["enable"], F.lit(True)).alias("prefetch_enable"),
        kb(j["prefetch"]["head_kb"]).alias("prefetch_head_kb"),
        kb(j["prefetch"]["tail_kb"]).alias("prefetch_tail_kb"),
        F.coalesce(j["logConfig"]["logLevel"], F.lit(1)).alias("log_level"),
        F.coalesce(j["ublkConfig"]["enableRecovery"], F.lit(True)).alias("recovery"),
        F.coalesce(j["ublkConfig"]["queues"], F.lit(0)).alias("queues"),
        F.coalesce(j["ublkConfig"]["workers"], F.lit(0)).alias("workers"),
    )
    out = texts.withColumn("valid_", F.get_json_object("text", "$").isNotNull() & F.col("text").rlike(r"^\s*\{")).withColumn("config", own)
    c = F.col("config")
    count = lambda x: (x < 0) | (x > rules.MAX_WORKERS)
    error = (
        F.when(~F.coalesce("valid_", F.lit(False)), "json")
        .when(~c["download"]["tryCnt"].between(1, MAX_U32), "download.tryCnt")
        .when(count(c["queues"]) | count(c["workers"]) | (c["queues"] > 0) & (c["workers"] > 0) & (c["workers"] < c["queues"]), "queues or workers")
        .when(~c["prefetch_head_kb"].between(0, MAX_U32) | ~c["prefetch_tail_kb"].between(0, MAX_U32), "prefetch window")
    )
    return out.withColumn("error", error).withColumn("config", F.when(F.col("error").isNull(), c)).drop("valid_")


def image_config(texts: DataFrame) -> DataFrame:
    """`texts` (text) with config, defaults filled in, and error."""
    j = F.from_json("text", IMAGE)
    lower = F.transform(F.coalesce(j["lowers"], F.array().cast(f"array<{_LOWER}>")), lambda x: F.struct(*(F.coalesce(x[n], F.lit(0 if n == "size" else "")).alias(n) for n in ("digest", "size", "dir", "file", "targetFile", "targetDigest", "gzipIndex"))))
    own = F.struct(
        F.coalesce(j["repoBlobUrl"], F.lit("")).alias("repo_blob_url"),
        lower.alias("lowers"),
        F.coalesce(j["upper"]["dir"], F.lit("")).alias("upper_dir"),
        F.when(j["upper"].isNotNull(), F.coalesce(j["upper"]["type"], F.lit("lsmt"))).otherwise("lsmt").alias("upper_type"),
        F.coalesce(j["resultFile"], F.lit("")).alias("result_file"),
        F.coalesce(j["accelerationLayer"], F.lit(False)).alias("acceleration_layer"),
        download(j["download"]).alias("download"),
    )
    out = texts.withColumn("valid_", F.get_json_object("text", "$").isNotNull() & F.col("text").rlike(r"^\s*\{")).withColumn("config", own)
    c = F.col("config")
    error = (
        F.when(~F.coalesce("valid_", F.lit(False)), "json")
        .when(F.exists(c["lowers"], lambda x: (x["gzipIndex"] != "") & (x["targetFile"] == "") & (x["targetDigest"] == "")), "gzipIndex without target")
        .when(F.exists(c["lowers"], lambda x: (x["targetDigest"] != "") & ~x["targetDigest"].rlike(HEX64)), "targetDigest")
        .when(~c["upper_type"].isin("lsmt", "sparse", "hybrid"), "upper.type")
        .when(~c["download"]["tryCnt"].between(1, MAX_U32), "download.tryCnt")
    )
    return out.withColumn("error", error).withColumn("config", F.when(F.col("error").isNull(), c)).drop("valid_")


#: Commands with the fields that each must have, and their types; `size` stands for a count of bytes.
REQUIRED = {"create": {"id": "string"}, "destroy": {"id": "string"}, "status": {"id": "string"}, "commit": {"id": "string"}, "trace_start": {"id": "string", "path": "string", "duration_sec": "integer"}, "trace_stop": {"id": "string"}, "resize": {"id": "string", "size": "size"}, "list": {}, "hello": {}}
OPTIONAL = {"create": {"global": "string", "device_bin": "string", "dev_id": "device", "virtual_size": "size", "config": "string", "blank": "object"}, "commit": {"user_tag": "string", "output": "path", "virtual_size": "size"}}


def command_error(line: Column) -> Column:
    """Null for a command line that may be carried out, else what is wrong with it."""
    v = F.try_parse_json(line)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    number = lambda path: F.try_variant_get(v, path, "decimal(38,0)")

    def integer(path: str) -> Column:
        return kind(path).rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")

    def good(path: str, want: str) -> Column:
        if want == "string":
            return kind(path) == "STRING"
        if want == "path":
            text = F.try_variant_get(v, path, "string")
            return (kind(path) == "STRING") & (text != "") & ~text.contains("\0")
        if want == "object":
            return kind(path).startswith("OBJECT")
        if want == "device":
            return integer(path) & number(path).between(-1, (1 << 31) - 1)
        return integer(path) & (number(path) >= 0) if want == "size" else integer(path)

    has = lambda name: kind(f"$.{name}").isNotNull()
    cmd = F.try_variant_get(v, "$.cmd", "string")
    out = F.when(v.isNull(), "json").when(~F.coalesce(kind("$").startswith("OBJECT") & (kind("$.cmd") == "STRING"), F.lit(False)), "cmd").when(~cmd.isin(*REQUIRED), "unknown")
    for name, fields in REQUIRED.items():
        for field, want in fields.items():
            out = out.when((cmd == name) & ~F.coalesce(good(f"$.{field}", want), F.lit(False)), field)
    out = out.when((cmd == "create") & (has("config") == has("blank")), "config or blank")
    for name, fields in OPTIONAL.items():
        for field, want in fields.items():
            out = out.when((cmd == name) & has(field) & ~F.coalesce(good(f"$.{field}", want), F.lit(False)), field)
    blank = (cmd == "create") & has("blank")
    out = out.when(blank & ~F.coalesce(good("$.blank.size", "size"), F.lit(False)), "blank.size")
    return out.when(blank & kind("$.blank.mkfs").isNotNull() & (kind("$.blank.mkfs") != "STRING"), "blank.mkfs")


def commands(lines: DataFrame) -> DataFrame:
    """Lines (line) with cmd, id and error."""
    v = F.try_parse_json("line")
    return lines.select("*", F.try_variant_get(v, "$.cmd", "string").alias("cmd"), F.try_variant_get(v, "$.id", "string").alias("id"), command_error(F.col("line")).alias("error"))


def device_status(line: Column) -> Column:
    """Struct (state, device, error, parent_uuid) of a status line, null where it is none."""
    v = F.try_parse_json(line)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    text = lambda path: F.try_variant_get(v, path, "string")
    plain = lambda path: F.coalesce(kind(path) == "STRING", F.lit(True))
    parent = plain("$.upper_parent_uuid") & F.coalesce((F.length(text("$.upper_parent_uuid")) <= 36) & ~text("$.upper_parent_uuid").contains("\0"), F.lit(True))
    good = F.coalesce(kind("$").startswith("OBJECT") & (kind("$.state") == "STRING"), F.lit(False)) & plain("$.device") & plain("$.error") & parent
    return F.when(good, F.struct(text("$.state").alias("state"), F.coalesce(text("$.device"), F.lit("")).alias("device"), F.coalesce(text("$.error"), F.lit("")).alias("error"), text("$.upper_parent_uuid").alias("parent_uuid")))


def reply(fields: dict[str, Column], error: Column) -> Column:
    """A reply line: the fields and ok, or the error."""
    good = F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()), F.lit(True).alias("ok")))
    return F.concat(F.when(error.isNull(), good).otherwise(F.to_json(F.struct(F.lit(False).alias("ok"), error.alias("error")))), F.lit("\n"))
