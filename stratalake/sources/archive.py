"""Archives of file trees (USTAR with PAX and GNU extensions) as relations of entries and deletes.

A file's headers are read in order, as extension records change those that follow; payloads are never
copied, an entry lists where its bytes lie.  Anything malformed refuses the whole archive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.rules import MAX_TIME, MIN_TIME
from . import FormatError, errors, need, rows_of

BLOCK = 512
#: Fixed values of the format: kinds by type flag.
KINDS = {"0": "file", "1": "hardlink", "2": "symlink", "3": "char", "4": "block", "5": "dir", "6": "fifo"}
MAX_ENTRIES, MAX_SPANS, MAX_DEVICE = 1_000_000, 1_000_000, (0xFFF, 0xFFFFF)


def number(data: bytes) -> int:
    """A header's number: octal digits between blanks or zero bytes, or base 256 where the first bit is set."""
    if data[0] & 128:
        need(not data[0] & 64, "negative number")
        value = int.from_bytes(bytes([data[0] & 63]) + data[1:], "big")
        need(value < 1 << 64, "number overflow")
        return value
    m = re.fullmatch(rb"[ \0]*([0-7]*)[ \0]*", data)
    need(m is not None, "octal number")
    return int(m[1] or b"0", 8)


def decimal(text: str) -> int:
    need(re.fullmatch("[0-9]+", text) is not None and int(text) < 1 << 64, "decimal number")
    return int(text)


def time_of(text: str) -> tuple[int, int]:
    """Seconds and nanoseconds of a decimal time; nanoseconds count up before 1970 too."""
    m = re.fullmatch(r"([+-]?)([0-9]+)(?:\.([0-9]{1,9})(0*))?", text)
    need(m is not None, "time")
    s, ns = int(m[2]), int((m[3] or "0").ljust(9, "0"))
    if m[1] == "-":
        s, ns = (-s - 1, 10**9 - ns) if ns else (-s, 0)
    need(MIN_TIME <= s <= MAX_TIME, "time out of range")
    return s, ns


def path_of(text: str, directory: bool = False) -> str:
    while text.startswith("./"):
        text = text[2:]
    need("\0" not in text and not text.startswith("/"), "absolute path")
    if directory:
        text = text.rstrip("/")
    if text in ("", "."):
        need(directory, "root is no directory")
        return ""
    need(all(p not in ("", ".", "..") and len(p.encode("utf-8", "surrogateescape")) <= 255 for p in text.split("/")), "path part")
    return text


def pax(data: bytes) -> dict[str, str]:
    """Records `length key=value` of an extension header."""
    out, at = {}, 0
    while at < len(data):
        m = re.compile(rb"([0-9]{1,20}) ").match(data, at)
        need(m is not None and int(m[1]) > m.end() - at and at + int(m[1]) <= len(data), "extension record")
        end = at + int(m[1])
        need(data[end - 1 : end] == b"\n", "extension record end")
        key, sign, value = data[m.end() : end - 1].partition(b"=")
        need(bool(sign) and bool(key), "extension key")
        out[key.decode("utf-8", "surrogateescape")] = value.decode("utf-8", "surrogateescape")
        at = end
    return out


def checked(h: bytes) -> None:
    plain = h[:148] + b" " * 8 + h[156:]
    need(sum(plain) == number(h[148:156]), "header checksum")
    need(h[257:262] == b"ustar" and h[262:263] in (b"\0", b" "), "magic")


@dataclass
class _State:
    common: dict[str, str] = field(default_factory=dict)
    own: dict[str, str] = field(default_factory=dict)
    name: str = ""
    link: str = ""


def _sparse(attrs: dict[str, str], content: bytes, at: int, stored: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Logical size and spans of a sparse file, from its map in the header (0.1) or before its data (1.0)."""
    start, version = at, (attrs.get("GNU.sparse.major"), attrs.get("GNU.sparse.minor"))
    if "GNU.sparse.map" in attrs:
        need(version[0] in (None, "0") and version[1] in (None, "1"), "sparse version")
        numbers = [decimal(x) for x in attrs["GNU.sparse.map"].split(",")]
        need("GNU.sparse.size" in attrs, "sparse size")
        size = decimal(attrs["GNU.sparse.size"])
        need("GNU.sparse.numblocks" not in attrs or decimal(attrs["GNU.sparse.numblocks"]) == len(numbers) // 2, "sparse count")
    else:
        need(version == ("1", "0") and "GNU.sparse.realsize" in attrs, "sparse encoding")
        size, place, lines = decimal(attrs["GNU.sparse.realsize"]), at, []
        while not lines or len(lines) < 1 + 2 * lines[0]:
            end = content.find(b"\n", place, at + stored)
            need(end >= 0 and len(lines) <= 2 * MAX_SPANS, "sparse map")
            lines.append(decimal(content[place:end].decode("latin-1")))
            place = end + 1
        numbers, start = lines[1:], at + -(-(place - at) // BLOCK) * BLOCK
    need(len(numbers) % 2 == 0 and start <= at + stored, "sparse map length")
    spans, end, used, room = [], 0, 0, stored - (start - at)
    for off, n in zip(numbers[::2], numbers[1::2], strict=True):
        need(end <= off <= size and n <= size - off and n <= room - used, "sparse bounds")
        if n:
            spans.append((off, start + used, n))
        used, end = used + n, off + n
    need(used == room, "sparse data size")
    return size, spans


def parse(content: bytes) -> Iterator[tuple]:
    """(ordinal, path, kind, mode, uid, gid, mtime_s, mtime_ns, link_target, size, dev_major, dev_minor, spans, xattrs) of each entry, delete markers among them."""
    state, at, ordinal = _State(), 0, 0
    while True:
        need(at + BLOCK <= len(content), "missing end blocks")
        h = content[at : at + BLOCK]
        at += BLOCK
        if not any(h):
            need(at + BLOCK <= len(content) and not any(content[at:]), "end blocks")
            return
        checked(h)
        flag, size = chr(h[156]) if h[156] else "0", number(h[124:136])
        if flag in "xgLK":
            need(at + size <= len(content), "extension")
            data = content[at : at + size]
            at += -(-size // BLOCK) * BLOCK
            if flag == "x":
                state.own |= pax(data)
            elif flag == "g":
                state.common = {k: v for k, v in (state.common | pax(data)).items() if v}
            else:
                text, _, rest = data.partition(b"\0")
                need(not any(rest), "long name")
                setattr(state, "name" if flag == "L" else "link", text.decode("utf-8", "surrogateescape"))
            continue
        attrs = dict(state.common)
        for k, v in state.own.items():
            if v or k.startswith("SCHILY.xattr."):
                attrs[k] = v
            else:
                attrs.pop(k, None)
        kind = KINDS.get(flag)
        need(kind is not None, "entry type")
        text = lambda a, b, h=h: h[a:b].split(b"\0")[0].decode("utf-8", "surrogateescape")
        name = state.name or (text(345, 500) + "/" if h[262] == 0 and text(345, 500) else "") + text(0, 100)
        path = path_of(attrs.get("path", name), kind == "dir")
        link = attrs.get("linkpath", state.link or text(157, 257))
        if kind == "hardlink":
            link = path_of(link)
        need(kind != "symlink" or link != "" and "\0" not in link, "symlink target")
        state.own, state.name, state.link = {}, "", ""
        mode, uid, gid = number(h[100:108]), decimal(attrs["uid"]) if "uid" in attrs else number(h[108:116]), decimal(attrs["gid"]) if "gid" in attrs else number(h[116:124])
        need(mode <= 0o7777 and max(uid, gid) < 1 << 32, "mode or owner")
        if "mtime" in attrs:
            seconds, nanos = time_of(attrs["mtime"])
        elif h[136] & 0xC0 == 0xC0:
            seconds, nanos = int.from_bytes(h[136:148], "big", signed=True), 0
            need(MIN_TIME <= seconds < 0, "time out of range")
        else:
            seconds, nanos = number(h[136:148]), 0
            need(seconds <= MAX_TIME, "time out of range")
        device = tuple(decimal(attrs[k]) if k in attrs else number(h[a : a + 8]) for k, a in (("SCHILY.devmajor", 329), ("SCHILY.devminor", 337)))
        need(max(device) < 1 << 32 and (kind not in ("char", "block") or device[0] <= MAX_DEVICE[0] and device[1] <= MAX_DEVICE[1]), "device number")
        stored = decimal(attrs["size"]) if "size" in attrs else size
        need(at + -(-stored // BLOCK) * BLOCK <= len(content), "payload")
        need(kind == "file" or stored == 0, "payload of no file")
        logical, spans = stored, [(0, at, stored)] if stored else []
        if any(k.startswith("GNU.sparse.") for k in attrs):
            need(kind == "file", "sparse entry")
            logical, spans = _sparse(attrs, content, at, stored)
            path = path_of(attrs["GNU.sparse.name"]) if "GNU.sparse.name" in attrs else path
        at += -(-stored // BLOCK) * BLOCK
        xattrs = {k[13:]: v.encode("utf-8", "surrogateescape") for k, v in attrs.items() if k.startswith("SCHILY.xattr.")}
        need("" not in xattrs, "attribute name")
        leaf = path.rpartition("/")[2]
        if leaf.startswith(".wh."):
            need(kind == "file" and logical == 0 and leaf[4:] not in ("", ".", ".."), "delete marker")
        need(ordinal < MAX_ENTRIES, "too many entries")
        yield ordinal, path, kind, mode, uid, gid, seconds, nanos, link, logical, *device, spans, list(xattrs.items())
        ordinal += 1


_SPAN = pa.list_(pa.struct([("logical", pa.int64()), ("stored", pa.int64()), ("length", pa.int64())]))
_SCHEMA = pa.schema(
    [("ordinal", pa.int64()), ("name", pa.string()), ("kind", pa.string()), ("mode", pa.int32()), ("uid", pa.int64()), ("gid", pa.int64()), ("mtime_s", pa.int64()), ("mtime_ns", pa.int32())]
    + [("link_target", pa.string()), ("size", pa.int64()), ("dev_major", pa.int64()), ("dev_minor", pa.int64()), ("spans", _SPAN), ("xattrs", pa.map_(pa.string(), pa.binary()))]
)
_DDL = "ordinal long, name string, kind string, mode int, uid long, gid long, mtime_s long, mtime_ns int, link_target string, size long, dev_major long, dev_minor long, spans array<struct<logical:long,stored:long,length:long>>, xattrs map<string,binary>"


def _rows(content: bytes) -> Iterator[tuple]:
    for row in parse(content):
        spans = [dict(zip(("logical", "stored", "length"), s, strict=True)) for s in row[12]]
        yield (*row[:12], spans, row[13])


def scan(files: DataFrame) -> DataFrame:
    """(path, ordinal, name, kind, ...) of all entries of sound archives; path is the archive's, name the entry's."""
    return rows_of(files, _rows, _SCHEMA, _DDL)


def broken(files: DataFrame) -> DataFrame:
    """(path, error) of files that are no sound archives."""
    return errors(files, parse)


def unwrapped(content: bytes) -> tuple[int, int]:
    """(base, size) of what a file holds behind an archive header that wraps it whole; (0, its size) where none does."""
    if len(content) < BLOCK:
        return 0, len(content)
    h = content[:BLOCK]
    plain = np.frombuffer(h[:148] + b" " * 8 + h[156:], np.uint8)
    loose = lambda b: int((re.match(rb"\s*([0-7]*)", b.split(b"\0")[0])[1]) or b"0", 8)
    sums = {int(plain.sum()), int(plain.view(np.int8).sum(dtype=np.int64))}
    if h[257:262] != b"ustar" or h[263:265] != b"00" or loose(h[148:156]) not in sums:
        return 0, len(content)
    if h[156:157] not in (b"x", b"g"):
        return BLOCK, loose(h[124:136])
    need(len(content) >= 3 * BLOCK, "truncated wrapper")
    own = content[2 * BLOCK : 3 * BLOCK]
    return 3 * BLOCK, len(content) - 3 * BLOCK if own[257:262] == b"xxtar" and own[263:265] == b"xx" else loose(own[124:136])


__all__ = ["FormatError", "broken", "parse", "scan", "unwrapped"]
