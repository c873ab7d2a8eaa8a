"""Queries of the rules: texts and numbers, good and malformed, derived from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, checksums, rules
from ..operators import admission, overlay
from .book import Given, cases, registered

K = "o_orderkey"
T = "CAST(o_orderkey AS STRING)"

LIFETIMES = Given("orders", k=K, stated=f"CASE WHEN {K} % 7 = 0 THEN NULL WHEN {K} % 5 = 0 THEN -{K} ELSE {K} * 37 % 900000 END")


@registered(f"SELECT k, CASE WHEN stated IS NULL OR stated < 0 THEN 30000 ELSE least(stated, 604800) * 800 END AS lifetime_ms FROM {LIFETIMES.sql}", plain=True)
def rule_token_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LIFETIMES.frame(spark, sf_dir).select("k", rules.token_lifetime_ms(F.col("stated")).alias("lifetime_ms"))


STATUSES = Given("orders", k=K, status=f"200 + {K} % 330")


@registered(f"SELECT k, CASE WHEN status IN (401, 403) THEN 'EPERM' WHEN status = 404 THEN 'ENOENT' WHEN status = 416 THEN 'ERANGE' WHEN status = 429 THEN 'EBUSY' ELSE 'EIO' END AS error FROM {STATUSES.sql}", plain=True)
def rule_status_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STATUSES.frame(spark, sf_dir).select("k", rules.status_error(F.col("status")).alias("error"))


CHALLENGES = Given(
    "orders",
    k=K,
    header=cases(
        K,
        f"""'Bearer realm="https://a/' || {T} || '",service="s",scope="pull:' || {T} || '"'""",
        """'bearer service="s",realm="r"'""",
        f"""'Bearer service="only' || {T} || '"'""",
        """'Basic realm="b"'""",
        """'basic'""",
        """'Digest realm="d"'""",
        f"""'Bearer realm="x",  realm="y' || {T} || '"'""",
        """'Bearer realm=bare,scope="s"'""",
        """'Bearer realm="open'""",
        """''""",
    ),
)


@registered(
    f"""SELECT k, scheme, realm, service, scope FROM (
      SELECT k, scheme, coalesce(list_filter(pairs, lambda p: ltrim(p[1], ' ,') = 'realm')[-1][2], '') AS realm, coalesce(list_filter(pairs, lambda p: ltrim(p[1], ' ,') = 'service')[-1][2], '') AS service,
        coalesce(list_filter(pairs, lambda p: ltrim(p[1], ' ,') = 'scope')[-1][2], '') AS scope
      FROM (SELECT k, scheme, list_transform(regexp_extract_all(whole, '[^=]*="[^"]*"'), lambda t: [split_part(t, '=', 1), split_part(t, '"', 2)]) AS pairs
        FROM (SELECT k, scheme, regexp_extract(substr(header, length(scheme) + 1), '^([^=]*="[^"]*")*') AS whole FROM (SELECT *, lower(regexp_extract(header, '^(Bearer|bearer|Basic|basic)')) AS scheme FROM {CHALLENGES.sql}))))
    WHERE scheme = 'basic' OR (scheme = 'bearer' AND realm <> '')""",
    plain=True,
)
def rule_challenge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Challenges that are accepted."""
    return CHALLENGES.frame(spark, sf_dir).select("k", rules.challenge(F.col("header")).alias("c")).filter("c is not null").select("k", "c.*")


RANGES = Given("orders", k=K, header=cases(K, f"'bytes ' || {T} || '-' || {T} || '9/' || {T} || '00'", f"'bytes ' || {T} || '-7/*'", f"'bytes x-7/' || {T}", "'bytes 5/9-1'", "'items 1-2/3'", "'bytes 5-9/z'", f"'bytes +4-9/ ' || {T} || 'kB'", "'bytes 5-9'"))


@registered(
    f"""SELECT k, CAST(first AS BIGINT) AS first, TRY_CAST(total AS BIGINT) AS total FROM (
      SELECT k, regexp_extract(header, '^bytes \\s*\\+?(\\d+)[^-]*-', 1) AS first, regexp_extract(header, '/\\s*\\+?(\\d+)', 1) AS total, ends_with(header, '/*') AS open
      FROM {RANGES.sql} WHERE starts_with(header, 'bytes ') AND strpos(header, '-') > 0 AND strpos(header, '/') > strpos(header, '-'))
    WHERE first <> '' AND (open OR total <> '')""",
    plain=True,
)
def rule_content_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RANGES.frame(spark, sf_dir).select("k", rules.content_range(F.col("header")).alias("r")).filter("r is not null").select("k", "r.*")


PROXIES = Given("orders", k=K, address=cases(K, f"'host' || {T} || ':80'", f"'http://h:' || {T} || '/p/q'", "'host'", "':80'", "'h:0'", "'https://a.b:443/'", "'h:x'", "'v:6:7'"))


@registered(
    f"""SELECT k, host, port, prefix, 'http://' || host || ':' || port || prefix AS base, 'http://' || host || ':' || port || prefix || '/u' AS url FROM (
      SELECT k, regexp_extract(authority, '^(.*):[^:]*$', 1) AS host, TRY_CAST(regexp_extract(authority, ':(\\d+)$', 1) AS INTEGER) AS port, CASE WHEN strpos(bare, '/') = 0 THEN '/dart' ELSE substr(bare, strpos(bare, '/')) END AS prefix
      FROM (SELECT *, split_part(bare, '/', 1) AS authority FROM (SELECT *, CASE WHEN strpos(address, '://') > 0 THEN substr(address, strpos(address, '://') + 3) ELSE address END AS bare FROM {PROXIES.sql})))
    WHERE host <> '' AND port BETWEEN 1 AND 65535""",
    plain=True,
)
def rule_proxy_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = PROXIES.frame(spark, sf_dir).select("k", rules.proxy_address(F.col("address")).alias("a")).filter("a is not null")
    return rows.select("k", "a.*", rules.proxied(F.lit("u"), F.col("a")).alias("url"))


DEVICES = Given("orders", k=K, path=cases(K, f"'/dev/ublkb' || CAST({K} % 1000 AS STRING)", "'/dev/ublkb'", f"'/dev/sda' || CAST({K} % 9 AS STRING)", "'/dev/ublkb1p2'", "'dev/ublkb1'"))


@registered(f"SELECT k, CASE WHEN starts_with(path, '/dev/ublkb') AND NOT regexp_matches(substr(path, 11), '[^0-9]') AND length(path) > 10 THEN CAST(substr(path, 11) AS INTEGER) ELSE -1 END AS id FROM {DEVICES.sql}", plain=True)
def rule_device_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DEVICES.frame(spark, sf_dir).select("k", rules.device_id(F.col("path")).alias("id"))


TOPOLOGIES = Given("orders", k=K, cpus=f"CAST({K} % 13 AS INT)", quota=f"CAST({K} % 5 AS INT)", queues=f"CAST(CASE WHEN {K} % 3 = 0 THEN 0 WHEN {K} % 101 = 0 THEN 300 ELSE {K} % 7 END AS INT)", workers=f"CAST(CASE WHEN {K} % 4 < 2 THEN 0 ELSE {K} % 11 END AS INT)", recovered=f"CAST(CASE WHEN {K} % 6 = 0 THEN {K} % 8 END AS INT)")


@registered(
    f"""SELECT k, CASE WHEN error IS NULL THEN q END AS queues, CASE WHEN error IS NULL THEN w END AS workers, error FROM (SELECT *,
      CASE WHEN queues > 256 OR workers > 256 THEN 'range' WHEN queues > 0 AND workers > 0 AND workers < queues THEN 'fewer workers than queues' WHEN recovered = 0 OR recovered > 256 THEN 'existing queues'
        WHEN recovered IS NOT NULL AND queues > 0 AND queues <> recovered THEN 'other queues' WHEN w < q THEN 'fewer workers than existing queues' END AS error
      FROM (SELECT *, CASE WHEN workers > 0 THEN workers ELSE q END AS w FROM (SELECT *, coalesce(recovered, CASE WHEN queues > 0 THEN queues WHEN workers > 0 THEN workers ELSE least(CASE WHEN quota > 0 THEN least(greatest(cpus, 1), quota) ELSE greatest(cpus, 1) END, 8) END) AS q FROM {TOPOLOGIES.sql})))""",
    plain=True,
)
def rule_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    cpus = rules.available_cpus(F.col("cpus"), F.col("quota"))
    return TOPOLOGIES.frame(spark, sf_dir).select("k", rules.topology(cpus, F.col("queues"), F.col("workers"), F.col("recovered")).alias("t")).select("k", "t.*")


QUOTAS = Given("orders", k=K, line=cases(K, f"{T} || '00 100000'", "'max 100000'", f"{T} || ' 0'", f"'0 ' || {T}", f"'  ' || {T} || '7   100 '", "'12'"))


@registered(
    f"""SELECT k, (quota + period - 1) // period AS cpus FROM (SELECT k, TRY_CAST(string_split_regex(trim(line), ' +')[1] AS BIGINT) AS quota, TRY_CAST(string_split_regex(trim(line), ' +')[2] AS BIGINT) AS period FROM {QUOTAS.sql}) WHERE quota > 0 AND period > 0""",
    plain=True,
)
def rule_cpu_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUOTAS.frame(spark, sf_dir).select("k", rules.cpu_quota(F.col("line")).alias("cpus")).filter("cpus is not null")


PATHS = Given("orders", k=K, dir=f"{K} % 2 = 0", path=cases(K + " * 7 % 12", f"'./a/' || {T}", "'././b'", f"'a//{'b'}' || {T}", "'a/./b'", f"'a/' || {T} || '/'", "'/abs'", "'a/../b'", "'.'", "'./'", "''", "repeat('x', 256)", f"'ok/' || {T}"))


@registered(
    f"""SELECT k, cut AS path FROM (SELECT *, CASE WHEN dir THEN rtrim(bare, '/') ELSE bare END AS cut FROM (SELECT *, regexp_replace(path, '^(\\./)+', '') AS bare FROM {PATHS.sql}))
    WHERE NOT starts_with(bare, '/') AND CASE WHEN cut IN ('', '.') THEN dir AND cut = '' ELSE len(list_filter(string_split(cut, '/'), lambda p: p IN ('', '.', '..') OR strlen(p) > 255)) = 0 END
    UNION ALL SELECT k, '' FROM {PATHS.sql} WHERE dir AND path = '.'""",
    plain=True,
)
def rule_normal_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that are accepted."""
    return PATHS.frame(spark, sf_dir).select("k", rules.normal_path(F.col("path"), F.col("dir")).alias("path")).filter("path is not null")


HEX = "substr(sha, 1, 8) || '-' || substr(sha, 9, 4) || '-' || substr(sha, 13, 4) || '-' || substr(sha, 17, 4) || '-' || substr(sha, 21, 12)"


@registered(
    f"""SELECT k, regexp_full_match(uuid, '[0-9a-fA-F]{{8}}-([0-9a-fA-F]{{4}}-){{3}}[0-9a-fA-F]{{12}}') AS is_uuid, CASE WHEN regexp_full_match(digest, '(sha256:)?[0-9a-fA-F]{{64}}') THEN lower(right(digest, 64)) END AS digest
    FROM (SELECT k, {cases('k', HEX, "upper(" + HEX + ")", "sha", "substr(" + HEX + ", 2)", "replace(" + HEX + ", '-', '_')")} AS uuid, {cases('k', "'sha256:' || sha", 'sha', "'sha512:' || sha", 'substr(sha, 2)')} AS digest
      FROM (SELECT o_orderkey AS k, sha256(CAST(o_orderkey AS STRING)) AS sha FROM orders))""",
    plain=True,
)
def rule_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Given("orders", k=K, sha=f"sha2({T}, 256)").frame(spark, sf_dir)
    rows = rows.selectExpr("k", f"{cases('k', HEX, 'upper(' + HEX + ')', 'sha', 'substr(' + HEX + ', 2)', 'replace(' + HEX + ', ' + chr(39) + '-' + chr(39) + ', ' + chr(39) + '_' + chr(39) + ')')} AS uuid", f"{cases('k', chr(39) + 'sha256:' + chr(39) + ' || sha', 'sha', chr(39) + 'sha512:' + chr(39) + ' || sha', 'substr(sha, 2)')} AS digest")
    return rows.select("k", rules.is_uuid(F.col("uuid")).alias("is_uuid"), rules.digest(F.col("digest")).alias("digest"))


BLANKS = Given("orders", k=K, size=cases(K, f"{K} * 512", f"{K} * 512 + 1", "0", f"-512 * {K}", "17592186044416", "17592186044928"), fs=cases(K + " * 3 % 7", "'ext4'", "'EXT4'", "''", "'a_2'", "'seventeen_letters'", "'sixteen_letters_'", "'x-y'"))


@registered(f"SELECT k, size > 0 AND size % 512 = 0 AND size <= 17592186044416 AS good_size, length(fs) BETWEEN 1 AND 16 AND NOT regexp_matches(fs, '[^a-z0-9_]') AS good_fs FROM {BLANKS.sql}", plain=True)
def rule_blank_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BLANKS.frame(spark, sf_dir).select("k", rules.is_blank_size(F.col("size")).alias("good_size"), rules.is_fs_type(F.col("fs")).alias("good_fs"))


SIZES = Given("orders", k=K, image=f"{K} * 512 % 9000 * 512", other=f"CASE WHEN {K} % 3 = 0 THEN NULL ELSE {K} * 11 % 9000 * 512 END")


@registered(f"SELECT k, CASE WHEN other IS NULL THEN image WHEN other >= image THEN other END AS capacity, CASE WHEN other >= image THEN other END AS grown FROM {SIZES.sql}", plain=True)
def rule_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size with an override, and after a resize."""
    return SIZES.frame(spark, sf_dir).select("k", rules.capacity(F.col("image"), F.col("other")).alias("capacity"), overlay.grow(F.col("image"), F.col("other")).alias("grown"))


NUMBERS = Given("orders", k=K, octal=cases(K, "'0000644 '", f"'  ' || CAST({K} % 7 AS STRING) || '5 '", "'12x'", "'9'", "''", "'7 7'"), time=cases(K, f"{T} || '.25'", f"'-' || {T} || '.5'", "'+7'", "'1.'", f"'0.' || {T}", "'99999999999'", "'-2147483648'", "'-2147483648.1'", "'1.0000000010'", "'1.0000000011'"))


@registered(
    f"""SELECT k, number, CASE WHEN s BETWEEN -2147483648 AND 15032385535 THEN s END AS s, CASE WHEN s BETWEEN -2147483648 AND 15032385535 THEN ns END AS ns FROM (
      SELECT k, number, CASE WHEN minus AND part > 0 THEN -whole - 1 WHEN minus THEN -whole ELSE whole END AS s, CAST(CASE WHEN minus AND part > 0 THEN 1000000000 - part ELSE part END AS INTEGER) AS ns FROM (
        SELECT k, CASE WHEN regexp_full_match(octal, ' *[0-7]* *') THEN CAST(coalesce(list_reduce(list_prepend(0, list_transform(string_split(trim(octal), ''), lambda c: TRY_CAST(c AS BIGINT))), lambda a, b: a * 8 + coalesce(b, 0)), 0) AS BIGINT) END AS number,
          starts_with(time, '-') AS minus, CASE WHEN good THEN TRY_CAST(regexp_extract(time, '[0-9]+') AS BIGINT) END AS whole, CASE WHEN good THEN CAST(rpad(substr(split_part(time, '.', 2), 1, 9), 9, '0') AS BIGINT) END AS part
        FROM (SELECT *, regexp_full_match(time, '[+-]?[0-9]+(\\.[0-9]{{1,9}}0*)?') AS good FROM {NUMBERS.sql})))""",
    plain=True,
)
def rule_header_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NUMBERS.frame(spark, sf_dir).select("k", rules.octal(F.col("octal")).alias("number"), rules.pax_time(F.col("time")).alias("t")).select("k", "number", "t.s", "t.ns")


LOGINS = Given("customer", k="c_custkey", login="c_name || CASE c_custkey % 3 WHEN 0 THEN ':' || c_mktsegment WHEN 1 THEN ':a:b' ELSE '' END")


@registered(f"SELECT k, split_part(login, ':', 1) AS user, CASE WHEN strpos(login, ':') > 0 THEN substr(login, strpos(login, ':') + 1) END AS password FROM (SELECT k, decode(from_base64(to_base64(encode(login)))) AS login FROM {LOGINS.sql})", plain=True)
def rule_basic_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LOGINS.frame(spark, sf_dir).select("k", rules.basic_auth(F.base64(F.encode("login", "utf-8"))).alias("a")).select("k", "a.*")


CALLS = Given("events", k="event_id", op="CASE event_id % 6 WHEN 0 THEN 'read' WHEN 1 THEN 'flush' WHEN 2 THEN 'write' WHEN 3 THEN 'discard' WHEN 4 THEN 'write_zeroes' ELSE 'zone_open' END", flags="CASE WHEN event_id % 5 = 0 THEN 32768 ELSE event_id % 7 END", ro="event_id % 4 = 0")


@registered(
    f"SELECT k, CASE WHEN op = 'read' THEN 'read' WHEN op = 'flush' THEN 'flush' WHEN op = 'zone_open' THEN 'EOPNOTSUPP' WHEN ro THEN 'EROFS' WHEN op = 'write' THEN 'write' WHEN op = 'discard' THEN 'discard' WHEN flags >= 32768 THEN 'write' ELSE 'discard' END AS action FROM {CALLS.sql}",
    plain=True,
)
def rule_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CALLS.frame(spark, sf_dir).select("k", rules.dispatch(F.col("op"), F.col("flags"), F.col("ro")).alias("action"))


@registered(f"SELECT op, ro, count(*) AS n FROM {CALLS.sql} GROUP BY ALL", plain=True)
def rule_request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CALLS.frame(spark, sf_dir).groupBy("op", "ro").agg(F.count("*").alias("n"))


@registered('SELECT device, seq, off AS "offset", len AS length, moffset, zeroed, layer AS tag, off + len * 1125899906842624 AS low, moffset + CASE WHEN zeroed THEN 36028797018963968 ELSE 0 END + layer * 72057594037927936 AS high FROM log')
def codec_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments packed into sixteen bytes and read back, with their two words."""
    from . import inputs

    log = inputs.mapping_log(spark, sf_dir)
    packed = log.select("device", "seq", bits.store_segment(F.col("offset"), F.col("length"), F.col("moffset"), F.col("zeroed"), F.col("layer")).alias("b"))
    fields = bits.load_segment(F.col("b"), 0)
    return packed.select("device", "seq", *(c.alias(n) for n, c in fields.items()), bits.load_le(F.col("b"), 0, 8).alias("low"), bits.load_le(F.col("b"), 8, 8).alias("high"))


FLAGS = Given("orders", k=K, flags=f"{K} % 64")


@registered(f"SELECT k, flags % 2 = 1 AS header, flags // 2 % 2 = 1 AS data_file, flags // 4 % 2 = 1 AS sealed, flags // 16 % 2 = 1 AS sparse, flags // 32 % 2 = 1 AS hybrid, (k * 7 + 4095) // 4096 AS blocks, (k * 7 + 511) // 512 * 512 AS rounded FROM {FLAGS.sql}", plain=True)
def codec_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of a layer's header, and rounding."""
    names = {"header": 0, "data_file": 1, "sealed": 2, "sparse": 4, "hybrid": 5}
    return FLAGS.frame(spark, sf_dir).select("k", *(bits.flag(F.col("flags"), b).alias(n) for n, b in names.items()), bits.ceil_div(F.col("k") * 7, 4096).alias("blocks"), bits.round_up(F.col("k") * 7, 512).alias("rounded"))


@registered("SELECT page_id, CAST(list_sum(list_transform(string_split(url, ''), lambda c: unicode(c))) AS BIGINT) AS total FROM pages WHERE url IS NOT NULL AND regexp_full_match(url, '[ -~]+')", plain=True)
def checksum_byte_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the bytes of each page's URL, where it is plain ASCII."""
    from . import inputs

    rows = inputs.table(spark, sf_dir, "pages").filter(F.col("url").rlike("^[ -~]+$"))
    return rows.select("page_id", checksums.byte_sum(F.encode("url", "utf-8")).alias("total"))


@registered(
    """SELECT page_id, substr(sha, 1, 8) || '-' || substr(sha, 9, 4) || '-' || substr(sha, 13, 4) || '-' || substr(sha, 17, 4) || '-' || substr(sha, 21, 12) AS uuid FROM (SELECT page_id, sha256(encode(url) || encode(html)) AS sha FROM pages WHERE url IS NOT NULL AND html IS NOT NULL)""",
    plain=True,
)
def checksum_content_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of packed data and index, without the size, which SQL can't write as bytes; the tests have it."""
    from . import inputs

    rows = inputs.table(spark, sf_dir, "pages").filter("url is not null and html is not null")
    return rows.select("page_id", checksums.uuid_of(F.sha2(F.concat(F.encode("url", "utf-8"), F.encode("html", "utf-8")), 256)).alias("uuid"))


READS = Given("events", k="event_id", read_class="CASE event_id % 3 WHEN 0 THEN 'ondemand' WHEN 1 THEN 'prefetch' ELSE 'fill' END", count="event_id * 7919 % 3000000")


@registered(f"SELECT k, read_class, count, CASE WHEN read_class = 'ondemand' THEN count ELSE least(count, 1048576) END AS capped FROM {READS.sql}", plain=True)
def admission_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.capped(READS.frame(spark, sf_dir))
