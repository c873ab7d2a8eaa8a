"""Formats: goldens, round trips and broken files."""

import gzip
import io
import os
import random
import tarfile
import zlib

import numpy as np
import pytest

from stratalake.functions import checksums
from stratalake.operators import intervals, writes
from stratalake.sources import FormatError, archive, block_file, config, coverage, gzip_index, layer_file, trace_file


# --- traces


def test_trace_goldens():
    one = trace_file.packed(np.array([1]), np.array([4096]), np.array([0]))
    two = trace_file.packed(np.array([1, 0]), np.array([4096, 8192]), np.array([0, 16384]))
    none = trace_file.packed(*(np.zeros(0, np.int64),) * 3)
    assert [int.from_bytes(f[16:20], "little") for f in (one, two, none)] == [0xBA691A13, 0xD29283DD, 0]
    assert (len(two), int.from_bytes(two[:4], "little"), int.from_bytes(two[8:16], "little"), len(none)) == (72, 0xC2EF1820, 48, 24)
    assert list(trace_file.parse(two)) == [(0, "R", 1, 4096, 0), (1, "R", 0, 8192, 16384)] and list(trace_file.parse(none)) == []
    assert checksums.crc32c(b"") == 0


@pytest.mark.parametrize("spoil", [lambda f: f[:20], lambda f: b"x" + f[1:], lambda f: f + b"x", lambda f: f[:-1] + b"x", lambda f: f[:24] + b"W" + f[25:]])
def test_broken_traces_are_refused(spark, spoil):
    good = trace_file.packed(np.array([1]), np.array([4096]), np.array([0]))
    with pytest.raises(FormatError):
        list(trace_file.parse(spoil(good)))
    frame = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(spoil(good)))], "path string, content binary")
    assert [r.path for r in trace_file.scan(frame).collect()] == ["a"] and [r.path for r in trace_file.broken(frame).collect()] == ["b"]


def test_a_tail_of_a_trace_is_ignored():
    body = trace_file.packed(np.array([1]), np.array([4096]), np.array([0]))[24:]
    longer = trace_file.HEADER.pack(trace_file.MAGIC, len(body) + 7, checksums.crc32c(body)) + body + b"1234567"
    assert len(list(trace_file.parse(longer))) == 1


# --- layers


def test_layer_round_trip_with_data_laid_behind():
    image = os.urandom(512 * 40_000)
    content = layer_file.layer_of(image, "u" * 36, "p" * 36, "tag", tail=((10, 5), (20_000, 17_000)))
    back = bytearray(len(image))
    rows = list(layer_file.parse(content))
    for _, offset, length, moffset, zeroed, _ in rows:
        back[offset * 512 : (offset + length) * 512] = content[moffset * 512 : (moffset + length) * 512]
        assert length <= 16383 and not zeroed
    assert bytes(back) == image and [r[1] for r in rows] == sorted(r[1] for r in rows)
    end = layer_file.trailer(content)
    assert (end["virtual_size"], end["uuid"], end["parent_uuid"], end["user_tag"], end["index_size"]) == (len(image), "u" * 36, "p" * 36, "tag", len(rows))
    tail = [r[3] for r in rows if r[1] in (10, 20_000)]
    assert min(tail) == 8 + 40_000 - 17_005


def test_empty_base_layer_and_dropped_entries():
    empty = layer_file.sealed(b"", [], 1 << 20, "u")
    assert list(layer_file.parse(empty)) == [] and len(empty) == 8192 and layer_file.trailer(empty)["virtual_size"] == 1 << 20
    content = layer_file.sealed(bytes(1024), [((1 << 50) - 1, 0, 0, False), (4, 2, 8, False), (6, 3, 8, True)], 1 << 20, "u")
    assert [r[1:5] for r in layer_file.parse(content)] == [(4, 2, 8, False), (6, 3, 8, True)]


@pytest.mark.parametrize(
    "segments, why",
    [([(4, 4, 8, False), (6, 2, 8, False)], "disordered"), ([(4, 2, 7, False)], "mapped offset"), ([(4, 3, 8, False)], "mapped offset"), ([(4, 2, 11, True)], "mapped offset")],
)
def test_layers_with_bad_indexes_are_refused(segments, why):
    with pytest.raises(FormatError, match=why):
        list(layer_file.parse(layer_file.sealed(bytes(1024), segments, 1 << 20, "u")))


def test_broken_regions_are_refused():
    good = layer_file.sealed(bytes(512), [(0, 1, 8, False)], 512, "u")
    for bad in (good[:8000], b"x" + good[1:], good[:-4096] + good[:4096], good[:-4096] + b"x" + good[-4095:]):
        with pytest.raises(FormatError):
            list(layer_file.parse(bad))


def test_warp_layers_point_into_their_target():
    index = layer_file.packed_index(*(np.array(x) for x in ([0, 4, 9], [4, 5, 2], [8, 3, 0], [False, False, True], [6, 7, 7])))
    common = (4096 + 2048, 3, 512 * 100, "u")
    content = layer_file.packed_region(7, *common) + bytes(2048) + index + layer_file.packed_region(6, *common)
    base = -(-len(content) // 512)
    assert [r[1:6] for r in layer_file.parse_warp(content, 8 * 512)] == [(0, 4, 8, False, 0), (4, 5, base + 3, False, 0), (9, 2, 0, True, 0)]
    with pytest.raises(FormatError, match="target extent"):
        list(layer_file.parse_warp(content, 7 * 512))


# --- compressed blocks


def test_compressed_files_read_any_range():
    r = random.Random(1)
    data = bytes(r.choice(b"abcdefgh") for _ in range(100_000))
    for size in (512, 4096, 65536):
        content = block_file.compressed(data, size)
        assert block_file.read(content, 0, 1 << 60) == data and block_file.read(content, 100_000, 5) == b""
        for _ in range(10):
            at, n = r.randrange(100_000), r.randrange(1, 30_000)
            assert block_file.read(content, at, n) == data[at : at + n]
    assert block_file.read(block_file.compressed(b""), 0, 10) == b""


def test_broken_blocks_and_indexes_are_refused():
    content = bytearray(block_file.compressed(os.urandom(9000), 4096))
    content[600] ^= 1
    with pytest.raises(FormatError, match="checksum"):
        block_file.read(bytes(content), 0, 100)
    assert len(block_file.read(bytes(content), 8192, 100)) == 100
    for at in (3, 40, len(content) - 500, len(content) - 516):
        bad = bytearray(block_file.compressed(os.urandom(9000), 4096))
        bad[at] ^= 1
        with pytest.raises(FormatError):
            block_file.opened(bytes(bad))


# --- gzip


def test_gzip_reads_from_restart_points():
    r = random.Random(2)
    data = bytes(r.choice(b"abcdefgh") for _ in range(300_000))
    packed, index = gzip_index.indexed(data)
    assert gzip.decompress(packed) == data and len(gzip_index.opened(index, len(packed))[2]) == 5
    for _ in range(20):
        at, n = r.randrange(300_000), r.randrange(1, 150_000)
        assert gzip_index.read(packed, index, at, n) == data[at : at + n]
    assert gzip_index.read(packed, index, 300_000, 1) == b""
    for at in (0, 8, 30, 329, len(index) - 3):
        bad = bytearray(index)
        bad[at] ^= 255
        with pytest.raises(FormatError):
            gzip_index.opened(bytes(bad), len(packed))


def test_gzip_restart_inside_a_byte():
    r = random.Random(3)
    data = bytes(r.choice(b"abcdefgh") for _ in range(140_000))
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    first = packer.compress(data[:70_000]) + packer.flush(zlib.Z_BLOCK)
    body = b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + first + packer.compress(data[70_000:]) + packer.flush()
    at = 10 + len(first)
    window = zlib.compress(data[70_000 - 32768 : 70_000])
    found = []
    for bits in range(8):
        begin = at + (1 if bits else 0)
        entries = b"".join(gzip_index.struct.pack("<QQQBI", *e) for e in ((0, 10, 333, 0, len(window)), (70_000, begin, 333, bits, len(window))))
        h = bytearray(333)
        h[:8], h[8], h[10] = gzip_index.MAGIC, 1, 1
        packed = zlib.compress(entries)
        for place, value, f in ((13, 65536, "<I"), (17, 32768, "<I"), (21, 29, "<I"), (25, 2, "<Q"), (33, len(body), "<Q"), (41, 333 + len(window) + len(packed), "<Q"), (49, len(data), "<Q"), (313, 333 + len(window), "<Q"), (321, len(packed), "<Q")):
            gzip_index.struct.pack_into(f, h, place, value)
        gzip_index.struct.pack_into("<I", h, 329, checksums.crc32c(bytes(h[:329])))
        try:
            if gzip_index.read(body, bytes(h) + window + packed, 75_000, 1000) == data[75_000:76_000]:
                found.append(bits)
        except FormatError:
            pass
    assert len(found) == 1


# --- archives


@pytest.mark.parametrize("form", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_archives_of_every_form(form):
    out = io.BytesIO()
    long_ = "x" * 90 + "/" + "y" * 60
    with tarfile.open(fileobj=out, mode="w", format=form, pax_headers={"SCHILY.xattr.user.a": "v"} if form == tarfile.PAX_FORMAT else None) as tar:
        for name, kind, data, link in (("./a", tarfile.REGTYPE, b"abc", ""), ("dir/", tarfile.DIRTYPE, b"", ""), (long_, tarfile.REGTYPE, bytes(1000), ""), ("l", tarfile.SYMTYPE, b"", "a"), ("h", tarfile.LNKTYPE, b"", "./a"), ("dir/.wh..wh..opq", tarfile.REGTYPE, b"", "")):
            info = tarfile.TarInfo(name)
            info.type, info.size, info.linkname, info.mtime, info.uid = kind, len(data), link, 77, 1000
            tar.addfile(info, io.BytesIO(data))
    content = out.getvalue()
    rows = list(archive.parse(content))
    assert [(r[1], r[2], r[8], r[9], r[6], r[4]) for r in rows] == [("a", "file", "", 3, 77, 1000), ("dir", "dir", "", 0, 77, 1000), (long_, "file", "", 1000, 77, 1000), ("l", "symlink", "a", 0, 77, 1000), ("h", "hardlink", "a", 0, 77, 1000), ("dir/.wh..wh..opq", "file", "", 0, 77, 1000)]
    assert content[rows[0][12][0][1] :][:3] == b"abc"
    if form == tarfile.PAX_FORMAT:
        assert rows[0][13] == [("user.a", b"v")]


def sparse(version):
    out = io.BytesIO()
    head = {"GNU.sparse.major": "0", "GNU.sparse.minor": "1", "GNU.sparse.map": "512,3,4096,2", "GNU.sparse.size": "9000", "GNU.sparse.name": "s"} if version == "0.1" else {"GNU.sparse.major": "1", "GNU.sparse.minor": "0", "GNU.sparse.realsize": "9000", "GNU.sparse.name": "s"}
    data = b"abcde" if version == "0.1" else b"2\n512\n3\n4096\n2\n".ljust(512, b"\0") + b"abcde"
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
        info = tarfile.TarInfo("GNUSparseFile.0/s")
        info.size, info.pax_headers = len(data), head
        tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.mark.parametrize("version", ["0.1", "1.0"])
def test_sparse_entries(version):
    content = sparse(version)
    (row,) = archive.parse(content)
    assert (row[1], row[9]) == ("s", 9000) and [(a, content[b : b + n]) for a, b, n in row[12]] == [(512, b"abc"), (4096, b"de")]


def test_broken_archives_are_refused(spark):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        tar.addfile(tarfile.TarInfo("a"))
    good = out.getvalue()
    bad = [good[:600], b"b" + good[1:], good[:512], good[:-1] + b"x", good[:512] + b"x" + good[513:], b""]
    for path in ("/abs", "a/../b", "a//b"):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as tar:
            info = tarfile.TarInfo("x")
            info.name = path
            tar.addfile(info)
        bad.append(out.getvalue())
    for content in bad:
        with pytest.raises(FormatError):
            list(archive.parse(content))
    frame = spark.createDataFrame([(str(i), bytearray(c)) for i, c in enumerate([good, *bad])], "path string, content binary")
    assert archive.scan(frame).count() == 1 and archive.broken(frame).count() == len(bad)


def test_wrapped_files():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        info = tarfile.TarInfo("layer")
        info.size = 5
        tar.addfile(info, io.BytesIO(b"hello"))
    assert archive.unwrapped(out.getvalue()) == (512, 5) and archive.unwrapped(b"plain") == (0, 5) and archive.unwrapped(bytes(2000)) == (0, 2000)


# --- configurations


def test_global_configs(spark):
    texts = ["{}", '{"credentialConfig": {"path": "/c"}, "p2pConfig": {"enable": true, "address": "h:1"}, "ublkConfig": {"queues": 2}}', '{"prefetch": {"head_kb": -1}}', '{"ublkConfig": {"queues": 300}}', '{"ublkConfig": {"queues": 3, "workers": 2}}', '{"download": {"tryCnt": 0}}', "x"]
    rows = config.global_config(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "/default").orderBy("i").collect()
    assert [r.error for r in rows] == [None, None, "prefetch window", "queues or workers", "queues or workers", "download.tryCnt", "json"]
    assert (rows[0].config.credential_file, rows[0].config.prefetch_head_kb, rows[0].config.recovery) == (None, 1024, True)
    assert (rows[1].config.credential_file, rows[1].config.p2p_address, rows[1].config.queues) == ("/c", "h:1", 2)


def test_create_commands_and_statuses(spark):
    lines = {
        '{"cmd": "create", "id": "a", "config": "c"}': None,
        '{"cmd": "create", "id": "a", "blank": {"size": 512, "mkfs": "ext4"}}': None,
        '{"cmd": "create", "id": "a"}': "config or blank",
        '{"cmd": "create", "id": "a", "config": "c", "blank": {"size": 1}}': "config or blank",
        '{"cmd": "create", "id": "a", "blank": {"size": -1}}': "blank.size",
        '{"cmd": "create", "id": "a", "blank": {"size": 1, "mkfs": 4}}': "blank.mkfs",
        '{"cmd": "create", "id": "a", "config": "c", "dev_id": -2}': "dev_id",
        '{"cmd": "create", "id": "a", "config": "c", "dev_id": 18446744073709551615}': "dev_id",
        '{"cmd": "create", "id": "a", "config": "c", "virtual_size": 1.5}': "virtual_size",
        '{"cmd": "commit", "id": "a", "output": ""}': "output",
        '{"cmd": "commit", "id": "a", "user_tag": "t"}': None,
        '{"cmd": "hello"}': None,
    }
    rows = config.commands(spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, line string")).orderBy("i").collect()
    assert [r.error for r in rows] == list(lines.values())
    texts = ['{"state": "running", "device": "/d"}', '{"state": 1}', '{"state": "x", "upper_parent_uuid": 5}', "[", '{"state": "x", "error": "e", "upper_parent_uuid": "u"}']
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, line string")
    from pyspark.sql import functions as F

    got = [r.s for r in frame.select("i", config.device_status(F.col("line")).alias("s")).orderBy("i").collect()]
    assert [s and tuple(s) for s in got] == [("running", "/d", "", None), None, None, None, ("x", "", "e", "u")]


# --- coverage, allocation


def test_coverage_pages_and_invalid_states(spark):
    runs = [(1, 0, 3, False), (1, 3, 5, True), (1, 16380, 10, False), (2, 40000, 1, True)]
    pages = coverage.pages(spark.createDataFrame(runs, "device long, offset long, length long, zeroed boolean"))
    assert sorted((r.device, r.page, len(r.payload)) for r in pages.collect()) == [(1, 0, 4096), (1, 1, 4096), (2, 2, 4096)]
    assert sorted(tuple(r) for r in coverage.runs(pages).select("device", "offset", "length", "state").collect()) == [(1, 0, 3, 1), (1, 3, 5, 2), (1, 16380, 10, 1), (2, 40000, 1, 2)]
    assert coverage.invalid(pages).count() == 0
    bad = spark.createDataFrame([(1, 0, bytearray(b"\x03" + bytes(4095))), (1, 1, bytearray(5))], "device long, page long, payload binary")
    assert coverage.invalid(bad).count() == 2


def test_allocation_matches_a_sector_model(spark):
    r = random.Random(11)
    requests = [(r.randrange(2), i, r.randrange(60), r.choice([1, 3, 8, 20]), r.random() < 0.3) for i in range(150)]
    found = [tuple(x) for x in writes.allocated(spark.createDataFrame(requests, "device long, seq long, offset long, length long, zeroed boolean")).orderBy("device", "seq", "offset").collect()]
    for device in (0, 1):
        place, end, want = {}, 8, []
        for d, seq, offset, length, zeroed in requests:
            if d != device:
                continue
            for s in range(offset, offset + length):
                if zeroed:
                    place.pop(s, None)
                elif s in place:
                    want.append((seq, s, place[s], True))
                else:
                    want.append((seq, s, end, False))
                    place[s], end = end, end + 1
        own = [(seq, o + k, m + k, inside) for d, seq, o, n, m, inside in found if d == device for k in range(n)]
        assert sorted(own) == sorted(want)


def test_greedy_merge_of_many_devices_streams(spark):
    rows = [(d, i * 2, 2, 8 + i * 2, False, 0) for d in range(20) for i in range(50)]
    out = intervals.greedy_merge(spark.createDataFrame(rows, "device long, offset long, length long, moffset long, zeroed boolean, tag int"), 10)
    assert out.count() == 20 * 10 and {r.length for r in out.collect()} == {10}
