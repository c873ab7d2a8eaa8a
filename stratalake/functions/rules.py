"""Text and number rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bits

_HEX = "[0-9a-fA-F]"
UUID = rf"^{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}$"
#: Error names of HTTP statuses; any other is EIO.
STATUS = {401: "EPERM", 403: "EPERM", 404: "ENOENT", 416: "ERANGE", 429: "EBUSY"}
#: The most workers of a device, and the most queues that it takes by itself.
MAX_WORKERS, AUTO_QUEUES = 256, 8


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID), F.lit(False))


def digest(text: Column) -> Column:
    """The 64 hex digits of a SHA-256 digest with or without its prefix, else null."""
    found = F.regexp_extract(text, rf"^(?:sha256:)?({_HEX}{{64}})$", 1)
    return F.when(found != "", F.lower(found))


def status_error(status: Column) -> Column:
    """What an HTTP status means to a reader."""
    table = F.create_map(*[x for k, v in STATUS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, status.cast("int")), F.lit("EIO"))


def token_lifetime_ms(expires_s: Column) -> Column:
    """Milliseconds for which a token is used: 80 percent of what it states, 7 days at most; 30 seconds if it states nothing or less than nothing."""
    stated = F.least(expires_s.cast("long"), F.lit(7 * 24 * 3600).cast("long")) * 800
    return F.when(expires_s.isNull() | (expires_s < 0), F.lit(30_000).cast("long")).otherwise(stated)


def challenge(header: Column) -> Column:
    """Struct (scheme, realm, service, scope) of an authentication header; null for other schemes, and for a bearer challenge without realm.

    Quoted pairs are read up to the first that is malformed; of equal keys the last counts.
    """
    scheme = F.lower(F.regexp_extract(header, r"^(Bearer|bearer|Basic|basic)", 1))
    rest = F.substring(header, F.length(scheme) + 1, F.length(header))
    whole = F.regexp_extract(rest, r'^(?:[^=]*+="[^"]*+")*+', 0)
    pair = r'([^=]*+)="([^"]*+)"'
    keys = F.transform(F.regexp_extract_all(whole, F.lit(pair), F.lit(1)), lambda k: F.regexp_replace(k, "^[ ,]+", ""))
    pairs = F.arrays_zip(keys.alias("k"), F.regexp_extract_all(whole, F.lit(pair), F.lit(2)).alias("v"))

    def of(name: str) -> Column:
        return F.coalesce(F.try_element_at(F.filter(pairs, lambda p: p["k"] == name), F.lit(-1))["v"], F.lit("")).alias(name)

    good = (scheme == "basic") | (scheme == "bearer") & (of("realm") != "")
    return F.when(good, F.struct(scheme.alias("scheme"), of("realm"), of("service"), of("scope")))


def content_range(header: Column) -> Column:
    """Struct (first, total) of a content-range header, null where it is none; total is null where it is unknown.  Digits count up to the first other sign."""
    body = F.when(header.startswith("bytes "), F.substring(header, 7, 1 << 30))
    dash, slash = F.instr(body, "-"), F.instr(body, "/")
    number = lambda text: F.nullif(F.regexp_extract(text, r"^\s*\+?(\d+)", 1), F.lit("")).try_cast("long")
    first = number(F.substring(body, F.lit(1), dash - 1))
    tail = F.substring(body, slash + 1, F.length(body))
    total = number(tail)
    return F.when((dash > 0) & (slash > dash) & first.isNotNull() & ((tail == "*") | total.isNotNull()), F.struct(first.alias("first"), total.alias("total")))


def proxy_address(address: Column) -> Column:
    """Struct (host, port, prefix, base) of a proxy's address, null where it lacks a host or a port of 1 to 65535; the prefix is its path or /dart."""
    at = F.instr(address, "://")
    bare = F.when(at > 0, F.substring(address, at + 3, F.length(address))).otherwise(address)
    authority = F.regexp_extract(bare, "^[^/]*", 0)
    path = F.substring(bare, F.length(authority) + 1, F.length(bare))
    prefix = F.when(path == "", "/dart").otherwise(path)
    host = F.regexp_extract(authority, r"^(.*):[^:]*$", 1)
    port = F.regexp_extract(authority, r":\s*\+?(\d+)[^:]*$", 1).try_cast("int")
    good = (host != "") & port.between(1, 65535)
    return F.when(good, F.struct(host.alias("host"), port.alias("port"), prefix.alias("prefix"), F.concat(F.lit("http://"), host, F.lit(":"), port.cast("string"), prefix).alias("base")))


def proxied(url: Column, address: Column) -> Column:
    """A URL as seen through a proxy (a struct of `proxy_address`) that takes it behind its base."""
    return F.concat(address["base"], F.lit("/"), url)


def device_id(path: Column) -> Column:
    """The number in a block device's path, else -1."""
    return F.coalesce(F.regexp_extract(path, r"^/dev/ublkb(\d+)$", 1).try_cast("int"), F.lit(-1))


def is_fs_type(name: Column) -> Column:
    return name.rlike("^[a-z0-9_]{1,16}$")


def is_blank_size(size: Column) -> Column:
    """Whether a blank device may have this many bytes: whole sectors, 16 TiB at most."""
    return (size > 0) & (F.pmod(size, F.lit(512)) == 0) & (size <= 16 << 40)


def capacity(image: Column, override: Column) -> Column:
    """The device size: an override must not be smaller than the image (null if it is)."""
    return F.when(override.isNull(), image).when(override >= image, override)


def available_cpus(affinity: Column, quota: Column) -> Column:
    """CPUs that a device may use: those allowed, at least one, and no more than the quota, where one is known (not null or 0)."""
    allowed = F.greatest(affinity, F.lit(1))
    return F.when(F.coalesce(quota, F.lit(0)) > 0, F.least(allowed, quota)).otherwise(allowed)


def topology(cpus: Column, queues: Column, workers: Column, recovered: Column) -> Column:
    """Struct (queues, workers, error) from the CPUs, the stated queues and workers (0 for none) and the queues of a device that exists already (or null)."""
    given = F.when(queues > 0, queues).when(workers > 0, workers).otherwise(F.least(cpus, F.lit(AUTO_QUEUES)))
    q = F.coalesce(recovered, given)
    # a device that exists sets the queues alone; else either number stands for both
    w = F.when(workers > 0, workers).otherwise(q)
    error = (
        F.when((queues > MAX_WORKERS) | (workers > MAX_WORKERS), "range")
        .when((queues > 0) & (workers > 0) & (workers < queues), "fewer workers than queues")
        .when(recovered.isNotNull() & ((recovered == 0) | (recovered > MAX_WORKERS)), "existing queues")
        .when(recovered.isNotNull() & (queues > 0) & (queues != recovered), "other queues")
        .when(w < q, "fewer workers than existing queues")
    )
    return F.struct(F.when(error.isNull(), q).cast("int").alias("queues"), F.when(error.isNull(), w).cast("int").alias("workers"), error.alias("error"))


def cpu_quota(text: Column) -> Column:
    """Whole CPUs, rounded up, of a text `quota period`; null for `max`, for zeros and for what is no quota."""
    quota, period = (F.regexp_extract(text, r"^\s*(\d+)\s+(\d+)(?:\s|$)", i).try_cast("long") for i in (1, 2))
    return F.when((quota > 0) & (period > 0), F.call_function("div", quota + period - 1, period))


def normal_path(path: Column, directory: Column) -> Column:
    """An archive path without leading `./` and, for directories, final slashes; null where it must be refused.

    Refused: absolute paths, empty parts, `.` and `..` parts, parts above 255 bytes, a final slash of what is no directory, and an
    empty path or `.` of what is no directory (for a directory these are the root, an empty path).
    """
    bare = F.regexp_replace(path, r"^(?:\./)+", "")
    cut = F.when(directory, F.regexp_replace(bare, "/+$", "")).otherwise(bare)
    root = (cut == "") | (cut == ".")
    parts = F.split(cut, "/", -1)
    bad = bare.startswith("/") | path.contains("\0") | F.exists(parts, lambda p: p.isin("", ".", "..") | (F.octet_length(p) > 255))
    return F.when(bare.startswith("/") | path.contains("\0"), None).when(root, F.when(directory, "")).when(~bad, cut)


def parents(path: Column) -> Column:
    """All directories above a relative path, the highest first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))).otherwise(F.array().cast("array<string>"))


def octal(text: Column) -> Column:
    """A number field in octal digits after blanks or zero bytes and ended by them; 0 where there are none, null where it has other signs."""
    digits = F.regexp_extract(text, r"^[ \x00]*([0-7]*)[ \x00]*$", 1)
    return F.when(text.rlike(r"^[ \x00]*[0-7]*[ \x00]*$"), F.coalesce(F.conv(F.nullif(digits, F.lit("")), 8, 10).cast("long"), F.lit(0).cast("long")))


def tar_number(field: Column) -> Column:
    """A number field of an archive header (binary): octal digits, or base 256 where the first bit is set; null where negative, above 63 bits or malformed."""
    first = bits.byte_at(field, 0)
    places = F.sequence(F.lit(2), F.length(field))
    value = F.aggregate(places, first.bitwiseAND(F.lit(63)), lambda s, i: F.when(s.between(0, (1 << 55) - 1), s * 256 + bits.byte_at(field, i - 1)).otherwise(F.lit(-1).cast("long")))
    wide = F.when((first.bitwiseAND(F.lit(64)) == 0) & (value >= 0), value)
    return F.when(first.bitwiseAND(F.lit(128)) != 0, wide).otherwise(octal(F.decode(field, "ISO-8859-1")))


#: The least and the largest time that large inodes hold.
MIN_TIME, MAX_TIME = -2147483648, 15032385535


def pax_time(text: Column) -> Column:
    """Struct (s, ns) of a decimal time; nanoseconds count up also before 1970.  Null where it is malformed, finer than nanoseconds or out of range."""
    sign, whole, part, rest = (F.regexp_extract(text, r"^([+-]?)(\d+)(?:\.(\d{1,9})(0*))?$", i) for i in (1, 2, 3, 4))
    ns = F.rpad(part, 9, "0").cast("long")
    ns = F.when(part == "", F.lit(0).cast("long")).otherwise(ns)
    minus = sign == "-"
    s = whole.try_cast("long")
    borrowed = minus & (ns > 0)
    seconds = F.when(borrowed, -s - 1).when(minus, -s).otherwise(s)
    return F.when(seconds.between(MIN_TIME, MAX_TIME), F.struct(seconds.alias("s"), F.when(borrowed, 1_000_000_000 - ns).otherwise(ns).cast("int").alias("ns")))


def merged_pax(common: Column, own: Column) -> Column:
    """Header records of an entry over those of the archive; an empty value removes a key."""
    rest = F.map_filter(common, lambda k, _: ~F.array_contains(F.map_keys(own), k))
    return F.map_filter(F.map_concat(rest, own), lambda _, v: v != "")


def basic_auth(encoded: Column) -> Column:
    """Struct (user, password) of base64 `user:password`."""
    text = F.try_to_binary(encoded, F.lit("base64")).cast("string")
    return F.struct(F.substring_index(text, ":", 1).alias("user"), F.when(F.instr(text, ":") > 0, F.substring(text, F.instr(text, ":") + 1, F.length(text))).alias("password"))


def dispatch(op: Column, flags: Column, read_only: Column) -> Column:
    """What a device does with a request: an action or an error.  op by name; bit 15 of flags keeps written zeroes mapped."""
    keep = bits.flag(flags, 15)
    write = F.when(read_only, "EROFS")
    return (
        F.when(op == "read", "read")
        .when(op == "flush", "flush")
        .when(op == "write", F.coalesce(write, F.lit("write")))
        .when(op == "discard", F.coalesce(write, F.lit("discard")))
        .when(op == "write_zeroes", F.coalesce(write, F.when(keep, "write").otherwise("discard")))
        .otherwise("EOPNOTSUPP")
    )
