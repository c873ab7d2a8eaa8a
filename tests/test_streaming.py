"""Live operators against their batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from stratalake.operators import admission, trace
from stratalake.streaming import live

READS = "device long, ordinal long, layer_index long, offset long, count long"


def streamed(spark, tmp_path, rows, schema, query, mode, parts=3):
    """The rows of all micro-batches of a query over `rows` in so many files."""
    for i in range(parts):
        spark.createDataFrame(rows[i * len(rows) // parts : (i + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    found = []
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run = query(source).writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, n: found.append([tuple(r) for r in df.collect()])).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert not run.isActive and run.exception() is None
    return found


def test_live_recording_keeps_what_the_batch_form_keeps(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.randrange(2), i, r.randrange(2), (i // 4) * 1000 + (i % 4) * 100, 100) for i in range(120)]
    out = [x for batch in streamed(spark, tmp_path, rows, READS, lambda s: live.recorded(s, cap=300), "append") for x in batch]
    whole = {d: [tuple(x) for x in trace.record(spark.createDataFrame(rows, READS), cap=300).filter(F.col("device") == d).orderBy("ordinal").select("layer_index", "offset", "count").collect()] for d in (0, 1)}
    for d in (0, 1):
        assert [x[1:4] for x in out if x[0] == d] == whole[d][:-1]  # the last may still grow


def test_live_admission_ends_as_the_batch_form(spark, tmp_path):
    r = random.Random(9)
    rows = [(r.randrange(3), i, r.choice([500_000, 1_200_000, 4_000_000, 9_000_000])) for i in range(150)]
    kind = "device long, ordinal long, nanos long"
    last = {}
    for batch in streamed(spark, tmp_path, rows, kind, live.admission_window, "update"):
        last |= {x[0]: x for x in batch}
    assert sorted(last.values()) == sorted(tuple(x) for x in admission.window_fold(spark.createDataFrame(rows, kind)).collect())


def test_live_generations_drop_stale_events(spark, tmp_path):
    rows = [(1, 0, 0), (1, 1, 1), (1, 2, 0), (1, 3, 1), (2, 4, 5), (1, 5, 2), (1, 6, 1), (2, 7, 4), (1, 8, 2)]
    out = [x for batch in streamed(spark, tmp_path, rows, "device long, seq long, generation long", live.current, "append") for x in batch]
    assert sorted(x[1] for x in out) == [0, 1, 3, 4, 5, 8]


@pytest.mark.parametrize("form", ["rates", "flights"])
def test_live_windows_and_flights(spark, tmp_path, form):
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(1, at(0.1), 5), (1, at(0.9), 6), (2, at(0.5), 7), (1, at(1.5), 1), (1, at(100), 1), (1, at(200), 1)]
    if form == "rates":
        out = [x for batch in streamed(spark, tmp_path, rows, "device long, ts timestamp, count long", live.rates, "append") for x in batch]
        assert (1, at(0), 11) in out and (2, at(0), 7) in out and (1, at(1), 1) in out
    else:
        out = [x for batch in streamed(spark, tmp_path, rows, "key long, ts timestamp, count long", live.first_flights, "append", 1) for x in batch]
        assert sorted(x[0] for x in out) == [1, 2]
