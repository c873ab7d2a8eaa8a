"""Restart points of gzip files: reading from the middle by the last point at or before a place.

An index has a header of 333 bytes, 32 KB windows of what was output before each point, and entries of 29 bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import checksums
from . import FormatError, need, rows_of

#: Fixed values of the format.
MAGIC, HEADER, ENTRY, WINDOW, LIMIT = b"ddgzidx\0", 333, 29, 32768, 64 << 20


def _inflated(data: bytes, size: int) -> bytes:
    try:
        own = zlib.decompressobj()
        out = own.decompress(data, size + 1)
    except zlib.error as e:
        raise FormatError(str(e)) from e
    need(own.eof and len(out) == size and not own.unused_data, "packed size")
    return out


def opened(content: bytes, gzip_size: int) -> tuple[int, int, list[tuple[int, int, int, int, int]]]:
    """Uncompressed size, algorithm and entries (output, input, dictionary, dictionary_size, bits) of an index, checked."""
    need(len(content) >= HEADER, "truncated")
    h = content[:HEADER]
    u32, u64 = (lambda at, f=f: struct.unpack_from(f, h, at)[0] for f in ("<I", "<Q"))
    need(h[:8] == MAGIC and h[8] == 1 and h[9] == 0 and h[10] <= 1 and h[12] == 0, "header")
    need(u32(17) == WINDOW and u32(21) == ENTRY and 65536 <= u32(13) < 1 << 31, "header sizes")
    need(checksums.crc32c(h[:329]) == u32(329), "header checksum")
    count, start, length, size = u64(25), u64(313), u64(321), u64(49)
    need(u64(33) == gzip_size and u64(41) == len(content) and size < 1 << 63, "file sizes")
    need(0 < count <= LIMIT // ENTRY and HEADER <= start <= len(content) and length == len(content) - start and 0 < length <= LIMIT, "index bounds")
    packed = content[start:]
    raw = _inflated(packed, count * ENTRY) if h[10] else packed
    need(len(raw) == count * ENTRY, "entries")
    out: list[tuple[int, int, int, int, int]] = []
    for output, at, dictionary, bits, n in struct.iter_unpack("<QQQBI", raw):
        need(output <= size and at < gzip_size and bits <= 7 and (bits == 0 or at > 0), "entry")
        need(HEADER <= dictionary <= start and 0 < n <= start - dictionary and (h[10] == 1 or n == WINDOW), "dictionary")
        need(output > out[-1][0] and at >= out[-1][1] if out else output == 0, "entry order")
        out.append((output, at, dictionary, n, bits))
    return size, h[10], out


def read(gzip: bytes, index: bytes, offset: int, count: int) -> bytes:
    """Bytes of the uncompressed file, inflated from the last restart point at or before them."""
    size, algorithm, entries = opened(index, len(gzip))
    count = max(0, min(count, size - offset))
    if not count:
        return b""
    output, at, dictionary, n, bits = max(e for e in entries if e[0] <= offset)
    window = index[dictionary : dictionary + n]
    if algorithm:
        window = _inflated(window, WINDOW)
    own, out, skip = zlib.decompressobj(-15, zdict=window), [], offset - output
    left, step = skip + count, 1 << 16
    while left > 0:
        # a point inside a byte: the stream is moved down by the bits that belong to the block before
        part = gzip[at : at + step]
        if bits:
            raw = np.frombuffer(gzip[at - 1 : at + step], np.uint8).astype(np.uint16)
            moved = raw[:-1] >> np.uint16(8 - bits) | raw[1:] << np.uint16(bits) & 0xFF
            part = moved.astype(np.uint8).tobytes() + (bytes([int(raw[-1]) >> (8 - bits)]) if at + step >= len(gzip) else b"")
        need(bool(part), "compressed data ends")
        at += step
        try:
            out.append(own.decompress(part, left))
            left -= len(out[-1])
            while own.unconsumed_tail and left > 0:
                out.append(own.decompress(own.unconsumed_tail, left))
                left -= len(out[-1])
        except zlib.error as e:
            raise FormatError(str(e)) from e
        if own.eof:
            break
    data = b"".join(out)[skip : skip + count]
    need(len(data) == count, "compressed data ends")
    return data


def indexed(data: bytes, span: int = 65536, level: int = 6) -> tuple[bytes, bytes]:
    """A gzip file with a restart point every `span` bytes, and its index."""
    need(65536 <= span < 1 << 31, "span")
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body, points, windows = b"\x1f\x8b\x08\0\0\0\0\0\0\xff", [], b""
    for at in range(0, max(1, len(data)), span):
        window = zlib.compress(data[max(0, at - WINDOW) : at].rjust(WINDOW, b"\0"))
        points.append(struct.pack("<QQQBI", at, len(body), HEADER + len(windows), 0, len(window)))
        windows += window
        body += packer.compress(data[at : at + span]) + (packer.flush(zlib.Z_SYNC_FLUSH) if at + span < len(data) else b"")
    body += packer.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    entries = zlib.compress(b"".join(points))
    h = bytearray(HEADER)
    h[:8], h[8], h[10], h[11] = MAGIC, 1, 1, 6
    start = HEADER + len(windows)
    for at, value, f in ((13, span, "<I"), (17, WINDOW, "<I"), (21, ENTRY, "<I"), (25, len(points), "<Q"), (33, len(body), "<Q"), (41, start + len(entries), "<Q"), (49, len(data), "<Q"), (313, start, "<Q"), (321, len(entries), "<Q")):
        struct.pack_into(f, h, at, value)
    struct.pack_into("<I", h, 329, checksums.crc32c(bytes(h[:329])))
    return body, bytes(h) + windows + entries


def entries(files: DataFrame) -> DataFrame:
    """(path, output, input, dictionary, dictionary_size, bits) of sound indexes in rows of (path, content, gzip_size)."""
    schema = pa.schema([(n, pa.int64()) for n in ("output", "input", "dictionary", "dictionary_size", "bits")])
    from pyspark.sql import functions as F

    # the size travels in front of the content
    joined = files.select("path", F.concat(F.unhex(F.lpad(F.hex("gzip_size"), 16, "0")), F.col("content")).alias("content"))

    def parse(content: bytes) -> Iterator[tuple]:
        yield from opened(content[8:], int.from_bytes(content[:8], "big"))[2]

    return rows_of(joined, parse, schema, "output long, input long, dictionary long, dictionary_size long, bits long")
