"""Extent operators against sequential models and SQL."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from stratalake.functions import checksums, rules
from stratalake.operators import admission, intervals, layers, lookup, overlay, trace
from stratalake.plans import registry

LOG = "device long, seq long, offset long, length long, moffset long, zeroed boolean"
SEGMENT = "device long, offset long, length long, moffset long, zeroed boolean, tag int"


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def replayed(log):
    """Sector by sector, in order."""
    live = {}
    for device, _, offset, length, moffset, zeroed in sorted(log, key=lambda r: r[:2]):
        for k in range(length):
            live[device, offset + k] = (zeroed, None if zeroed else moffset + k)
    return live


def sectors(rows):
    return {(d, o + k): (z, None if z else m + k) for d, o, n, m, z in rows for k in range(n)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_matches_sequential_model(spark, seed):
    r = random.Random(seed)
    log = [(r.randrange(3), i, r.choice([r.randrange(300), 16384 - r.randrange(40), r.randrange(60000)]), r.choice([1, 5, 70, 2000]), 8 + i * 4096, r.random() < 0.3) for i in range(120)]
    view = overlay.replay(spark.createDataFrame(log, LOG))
    found = [tuple(x) for x in view.select("device", "offset", "length", "moffset", "zeroed").collect()]
    assert sectors(found) == replayed(log)
    assert sum(x[2] for x in found) == len(replayed(log))


def test_replay_of_nothing_and_of_padding(spark):
    assert overlay.replay(spark.createDataFrame([], LOG)).count() == 0
    padding = [(1, 0, (1 << 50) - 1, 0, 0, False)]
    assert overlay.replay(spark.createDataFrame(padding, LOG)).count() == 0


def test_layers_keep_touching_extents_of_one_layer_apart(spark):
    stack = spark.createDataFrame([(1, 0, 0, 2, 8, False), (1, 0, 2, 2, 10, False), (1, 0, 4, 2, 30, False), (1, 0, 6, 2, 0, True), (1, 1, 0, 9, 100, False)], "device long, layer int, offset long, length long, moffset long, zeroed boolean")
    out = overlay.merge_layers(stack)
    assert rows_of(out, "offset", "length", F.coalesce("moffset", F.lit(-1)), "tag") == [(0, 2, 8, 0), (2, 2, 10, 0), (4, 2, 30, 0), (6, 2, -1, 0), (8, 1, 108, 1)]


def test_top_layer_splits_the_one_below(spark):
    stack = spark.createDataFrame([(1, 0, 4, 4, 8, False), (1, 1, 0, 16, 8, False)], "device long, layer int, offset long, length long, moffset long, zeroed boolean")
    assert rows_of(overlay.merge_layers(stack), "offset", "length", "tag", "moffset") == [(0, 4, 1, 8), (4, 4, 0, 8), (8, 8, 1, 16)]


def test_greedy_merge_stops_at_the_cap(spark):
    cap = 16383
    rows = [(1, 0, cap - 1, 8, False, 0), (1, cap - 1, 1, 8 + cap - 1, False, 0), (1, cap, 1, 8 + cap, False, 0), (1, cap + 2, 1, 9, False, 0)]
    assert rows_of(intervals.greedy_merge(spark.createDataFrame(rows, SEGMENT)), "offset", "length") == [(0, cap), (cap, 1), (cap + 2, 1)]


def test_erase_clip_and_complement(spark):
    view = spark.createDataFrame([(1, 0, 10, 8, False, 0), (1, 20, 5, None, True, 0)], SEGMENT)
    holes = spark.createDataFrame([(1, 3, 2), (1, 22, 1)], "device long, offset long, length long")
    assert rows_of(intervals.erase(view, holes), "offset", "length", F.coalesce("moffset", F.lit(-1))) == [(0, 3, 8), (5, 5, 13), (20, 2, -1), (23, 2, -1)]
    assert rows_of(intervals.clip(view, F.lit(5), F.lit(21)), "offset", "length", F.coalesce("moffset", F.lit(-1))) == [(5, 5, 13), (20, 1, -1)]
    sizes = spark.createDataFrame([(1, 30), (2, 4)], "device long, sectors long")
    assert rows_of(intervals.complement(view, sizes), "device", "offset", "length") == [(1, 10, 10), (1, 25, 5), (2, 0, 4)]


def test_end_windows(spark):
    blobs = spark.createDataFrame([(1, 100), (2, 5), (3, 0)], "blob long, size long")
    assert rows_of(lookup.end_windows(blobs, F.lit(4), F.lit(3)), "blob", "offset", "length") == [(1, 0, 4), (1, 97, 3), (2, 0, 5)]
    assert rows_of(lookup.end_windows(blobs, F.lit(4), F.lit(0)), "blob", "offset", "length") == [(1, 0, 4), (2, 0, 4)]


def test_recording_matches_sequential_model(spark):
    r = random.Random(5)
    records = [(r.randrange(2), i, "R", r.randrange(2), r.choice([10, 100, 250]), r.choice([0, 10, 100, 110, 260])) for i in range(200)]
    found = trace.record(spark.createDataFrame(records, "device long, ordinal long, op string, layer_index long, count long, offset long"), cap=100, room=60)
    for device in (0, 1):
        queue, dropped = [], 0
        for d, _, _, layer, count, offset in records:
            while d == device and count > 0:
                n = min(count, 100)
                if queue and queue[-1][0] == layer and queue[-1][1] + queue[-1][2] == offset and queue[-1][2] + n <= 100:
                    queue[-1][2] += n
                elif len(queue) < 60:
                    queue.append([layer, offset, n])
                else:
                    dropped += 1
                count, offset = count - n, offset + n
        own = [tuple(x) for x in found.filter(F.col("device") == device).orderBy("ordinal").select("layer_index", "offset", "count", "dropped").collect()]
        assert own == [(*q, dropped) for q in queue]


def test_admission_window_matches_sequential_model(spark):
    r = random.Random(9)
    samples = [(1, i, r.choice([500_000, 1_200_000, 4_000_000, 9_000_000])) for i in range(80)]
    base, window = None, 4
    for _, _, nanos in samples:
        s = max(nanos, 1_000_000)
        if base is None:
            base = s
            continue
        window = max(1, window * 50 // 100) if s > base * 150 // 100 else min(64, window + 1)
        base = (base * 7 + s) // 8
    out = admission.window_fold(spark.createDataFrame(samples, "device long, ordinal long, nanos long")).first()
    assert (out.samples, out.baseline, out.window) == (80, base, window)


def test_raw_crc32c_of_trace_records():
    record = b"R" + bytes(7)
    assert checksums.crc32c(b"") == 0
    assert checksums.crc32c(record) == checksums.crc32c(record[3:], checksums.crc32c(record[:3]))
    # the usual check value of CRC-32C, with inversion before and after
    assert checksums.crc32c(b"123456789", 0xFFFFFFFF) ^ 0xFFFFFFFF == 0xE3069283


def test_rules(spark):
    one = spark.range(1)
    path = lambda text, directory=False: rules.normal_path(F.lit(text), F.lit(directory))
    expected = {
        "lifetimes": ([rules.token_lifetime_ms(F.lit(n).cast("long")) for n in (None, -5, 0, 1, 100, 10**9)], [30_000, 30_000, 0, 800, 80_000, 483_840_000]),
        "paths": ([path("./a/b"), path("././a"), path("a//b"), path("a/./b"), path("a/b/"), path("a/b/", True), path("/a"), path("a/../b"), path("."), path("./", True), path("x" * 256)], ["a/b", "a", None, None, None, "a/b", None, None, None, "", None]),
        "statuses": ([rules.status_error(F.lit(n)) for n in (401, 403, 404, 416, 429, 408, 500, 504)], ["EPERM", "EPERM", "ENOENT", "ERANGE", "EBUSY", "EIO", "EIO", "EIO"]),
        "challenges": ([rules.challenge(F.lit(t))["realm"] for t in ('Bearer realm="r", service="s"', 'bearer service="s"', 'Digest realm="r"', 'Basic realm="r"', 'Bearer realm="a",realm="b"', 'Bearer x=1,realm="r"')], ["r", None, None, "r", "b", None]),
        "ranges": ([rules.content_range(F.lit(t))["first"] for t in ("bytes 5-9/*", "bytes 5-9/20", "bytes 5/9-1", "byte 5-9/20", "bytes x-9/20", "bytes 5x-9/20z")], [5, 5, None, None, None, 5]),
        "proxies": ([rules.proxy_address(F.lit(t))["base"] for t in ("h:80", "http://h:80/p/q", "h", ":80", "h:0", "h:70000", "a:b:1")], ["http://h:80/dart", "http://h:80/p/q", None, None, None, None, "http://a:b:1/dart"]),
        "devices": ([rules.device_id(F.lit(t)) for t in ("/dev/ublkb12", "/dev/ublkb", "/dev/sda1", "/dev/ublkb1x")], [12, -1, -1, -1]),
        "times": ([rules.pax_time(F.lit(t))["s"] for t in ("-1.25", "+3", "1.", "1.0000000001", "1.0000000010", "99999999999", "x")], [-2, 3, None, None, 1, None, None]),
        "numbers": ([rules.tar_number(F.unhex(F.lit(t))) for t in ("3030303634340000", "8000000000000100", "FF00000000000000", "20203737", "3839", "000000")], [0o644, 256, None, 63, None, 0]),
    }
    for name, (columns, want) in expected.items():
        assert list(one.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()) == want, name
    topo = lambda *n: rules.topology(*[F.lit(x).cast("int") for x in n])
    got = one.select(*[t.alias(f"c{i}") for i, t in enumerate([topo(4, 0, 0, None), topo(20, 0, 0, None), topo(4, 3, 0, None), topo(4, 0, 5, None), topo(4, 6, 5, None), topo(4, 0, 0, 2), topo(4, 3, 0, 2), topo(4, 300, 0, None), topo(4, 0, 1, 2)])]).first()
    assert [(t.queues, t.workers, t.error is None) for t in got] == [(4, 4, True), (8, 8, True), (3, 3, True), (5, 5, True), (None, None, False), (2, 2, True), (None, None, False), (None, None, False), (None, None, False)]


def test_hard_links_follow_chains_and_leave_loops(spark):
    entries = spark.createDataFrame([("f", "file", None), ("a", "hardlink", "f"), ("b", "hardlink", "a"), ("c", "hardlink", "b"), ("x", "hardlink", "y"), ("y", "hardlink", "x"), ("z", "hardlink", "none")], "path string, kind string, link_target string")
    good, bad = layers.hard_links(entries)
    assert rows_of(good, "path", "target", "hops") == [("a", "f", 1), ("b", "f", 2), ("c", "f", 3)]
    assert {r.path for r in bad.collect()} == {"x", "y", "z"}


def test_delete_markers(spark):
    entries = spark.createDataFrame([(1, "a/.wh.b"), (1, ".wh.c"), (1, "d/.wh..wh..opq"), (1, "e")], "layer int, path string")
    assert rows_of(layers.deletes(entries), "path", "kind") == [("a/b", "whiteout"), ("c", "whiteout"), ("d", "opaque")]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_sql(spark, sf_dir, name):
    import duckdb

    frame = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    found = sorted(tuple(str(r[c]) for c in columns) for r in frame.collect())
    if name not in registry.ORACLE:
        assert found
        return
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = db.execute(registry.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert found == sorted(tuple(str(r[i]) for i in places) for r in result.fetchall())
