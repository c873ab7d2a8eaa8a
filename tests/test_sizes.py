"""What large inputs need: tasks that grow in number, not in size, and kernels that hold a chunk."""

import os
import random
from pathlib import Path

import pyarrow as pa

from stratalake import sources
from stratalake.operators import intervals, overlay, spread
from stratalake.plans import inputs, registry
from stratalake.sources import block_file

NAMES = ["device", "granule", "low", "high", "rank", "base", "moffset", "zeroed", "tag"]
KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()]


def batches_of(rows, size=10_000):
    for at in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + size], strict=True), KINDS, strict=True)], NAMES)


def owners(rows):
    """Sector by sector, in order of rank."""
    found = {}
    for device, granule, low, high, rank, *_ in sorted(rows, key=lambda r: r[4]):
        for k in range(low, high):
            found[device, granule, k] = rank
    return found


def test_views_take_more_tasks_as_their_tables_grow(spark, sf_dir, monkeypatch):
    usual = sorted(map(tuple, registry.live_view(spark, sf_dir).collect()))
    monkeypatch.setattr(spread, "TASK_BYTES", 2000)
    log, view = inputs.mapping_log(spark, sf_dir), registry.live_view(spark, sf_dir)
    for df in (log, view, intervals.cover(log), intervals.complement(view, inputs.sizes(spark, sf_dir))):
        assert df.rdd.getNumPartitions() >= 50
    assert sorted(map(tuple, view.collect())) == usual


def test_an_extent_reaches_the_shuffle_as_one_row_a_granule_at_most(spark):
    log = spark.createDataFrame([(1, i, 3 + 100 * i, 90, 8, False) for i in range(100)], "device long, seq long, offset long, length long, moffset long, zeroed boolean")
    view = overlay.replay(log)
    assert view.count() == 100
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan  # it held each task's cells, up to 28 of an extent


def test_rewritten_sectors_send_a_row_a_chunk():
    rows = [(1, 0, 7, 8, i, 7, 8 + i, False, 0) for i in range(150_000)]
    sent = pa.Table.from_batches(overlay._combined(batches_of(rows)))
    assert sent.num_rows == 3
    assert [b.column("rank").to_pylist() for b in overlay._finished(sent.to_batches())] == [[149_999]]


def test_a_granule_longer_than_a_chunk_is_settled_as_by_sectors(monkeypatch):
    monkeypatch.setattr(overlay, "CHUNK", 500)
    monkeypatch.setattr(overlay, "CANVAS", 3000)
    r = random.Random(5)
    rows = []
    for rank in range(4000):
        low = r.randrange(2000)
        rows.append((r.choice([1, 1, 1, 2, 3]), r.choice([0, 5]), low, low + r.choice([1, 9, 300]), rank, low, None if rank % 3 == 0 else 8, rank % 3 == 0, rank % 200))
    r.shuffle(rows)
    sent = pa.Table.from_batches(overlay._combined(batches_of(rows, 100)))
    assert sent.num_rows <= len(rows)
    out = pa.Table.from_batches(overlay._finished(sent.sort_by([("device", "ascending"), ("granule", "ascending")]).to_batches(100))).to_pylist()
    found = {(x["device"], x["granule"], k): x["rank"] for x in out for k in range(x["low"], x["high"])}
    assert found == owners(rows) and len(found) == sum(x["high"] - x["low"] for x in out)
    assert all(x["tag"] == x["rank"] % 200 and x["zeroed"] == (x["rank"] % 3 == 0) for x in out)
    seen = [(x["device"], x["granule"], x["low"]) for x in out]
    assert len(set(seen)) == len(seen)


def test_files_leave_in_small_batches():
    def batches():
        for at in range(0, 3000, 1000):
            yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(at, at + 1000)]), pa.array([bytes(10_000)] * 1000, pa.binary())], ["path", "data"])

    out = list(sources.made_of(batches(), lambda r: r["data"] + r["path"].encode(), "path"))
    assert [p for b in out for p in b.column("path").to_pylist()] == [str(i) for i in range(3000)]
    assert all(b.column("content").to_pylist()[0][10_000:].decode() == b.column("path")[0].as_py() for b in out)
    assert max(b.nbytes for b in out) < sources.PIECE + 50_000  # it was a batch of all files of an input batch


def test_rows_of_small_files_leave_together_and_refused_files_leave_nothing():
    def parse(content):
        for i in range(len(content)):
            sources.need(i < 25_000, "long")
            yield (i,)

    sizes = [3, 0, 25_000, 25_001, 12_000, 4, 5]
    given = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(7)]), pa.array([bytes(n) for n in sizes], pa.binary())], ["path", "content"])
    out = list(sources.parsed(iter([given]), parse, pa.schema([("n", pa.int64())])))
    found = pa.Table.from_batches(out).group_by("path").aggregate([("n", "count"), ("n", "max")]).sort_by("path").to_pylist()
    assert [(x["path"], x["n_count"], x["n_max"]) for x in found] == [(str(i), n, n - 1) for i, n in enumerate(sizes) if 0 < n <= 25_000]
    assert len(out) == 4 and max(b.num_rows for b in out) <= 2 * sources.ROWS
    wide = list(sources.parsed(iter([given]), lambda content: iter([(content * 300,)]), pa.schema([("data", pa.binary())])))
    assert sum(b.num_rows for b in wide) == 7 and len(wide) == 3


def test_block_indexes_of_many_files_are_few_batches():
    texts = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(300)]), pa.array([b"block %d" % i * 200 for i in range(300)], pa.binary())], ["path", "data"])
    made = sources.made_of(iter([texts]), lambda r: block_file.compressed(r["data"], 1024), "path")
    out = list(sources.parsed(made, block_file.parse_blocks, pa.schema([("idx", pa.int64()), ("comp_size", pa.int64()), ("block_offset", pa.int64())])))
    assert len(out) == 1  # it was a batch a file
    assert out[0].num_rows == sum(-(-len(b"block %d" % i * 200) // 1024) for i in range(300))


def test_workers_give_memory_back_while_their_task_goes_on(spark):
    def run(batches):
        now = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
        used, kept = [now()], []
        for _ in batches:
            for _ in range(3):
                held = [b"x" * 60_000 for _ in range(2000)]
                kept.append(held[-1])  # above all that is freed
                del held
                yield pa.RecordBatch.from_arrays([pa.array([0])], ["mb"])
                used.append(now())
        yield pa.RecordBatch.from_arrays([pa.array([max(used) - used[0]])], ["mb"])

    found = [r.mb for r in sources._mapped(spark.range(0, 1, 1, 1), run, "mb long").collect()]
    assert len(found) == 4 and max(found) < 60  # it was 120 MB, given back at the end only


def test_joins_and_lookups_take_more_tasks_as_their_tables_grow(spark, sf_dir, monkeypatch):
    names = ["lookup_pieces", "lookup_as_of", "interval_intersect", "interval_fully_data"]
    usual = {n: registry.QUERIES[n](spark, sf_dir).count() for n in names}
    monkeypatch.setattr(spread, "TASK_BYTES", 2000)
    for n in names[:3]:
        df = registry.QUERIES[n](spark, sf_dir)
        assert df.rdd.getNumPartitions() >= 50 and df.count() == usual[n]
    view, ranges = registry.states(spark, sf_dir), inputs.requests(spark, sf_dir).selectExpr("device", "start_sector AS offset", "nr_sectors AS length")
    plan = intervals.fully_data(view, ranges)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [device" in plan and intervals.fully_data(view, ranges).count() == usual[names[3]]
