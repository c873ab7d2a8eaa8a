"""Coverage pages: what each sector of a device is, in two bits, PAGE sectors a page.

State 0 is inherited from below, 1 is data, 2 is zero; 3 is invalid.  The first sector of a byte has its lowest bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals
from ..operators.spread import spread

PAGE = 16384


def pages(states: DataFrame) -> DataFrame:
    """(device, page, payload) of runs (device, offset, length, zeroed): only pages with an owned sector.

    Runs are cut at pages; a page's runs, at most PAGE, meet in one task and become its 4096 bytes.
    """
    end = F.col("offset") + F.col("length")
    one = states.filter("length > 0").withColumn("page", F.explode(F.sequence(F.shiftright("offset", 14), F.shiftright(end - 1, 14))))
    base = F.shiftleft("page", 14)
    cut = one.select("device", "page", (F.greatest("offset", base) - base).cast("int").alias("low"), (F.least(end, base + PAGE) - base).cast("int").alias("high"), F.when(F.col("zeroed"), 2).otherwise(1).alias("state"))

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            device, page = table.column(0).to_numpy(), table.column(1).to_numpy()
            start = int(np.argmax((device == device[-1]) & (page == page[-1])))
            yield _packed(table.slice(0, start))
            held = table.slice(start)
        if held is not None:
            yield _packed(held)

    return spread(cut, "device", "page").sortWithinPartitions("device", "page").mapInArrow(run, "device long, page long, payload binary")


def _packed(rows: pa.Table) -> pa.RecordBatch:
    device, page, low, high, state = (rows.column(i).to_numpy() for i in range(5))
    cuts = [0, *(np.flatnonzero((np.diff(device) != 0) | (np.diff(page) != 0)) + 1).tolist(), len(device)] if len(device) else [0]
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        bits = np.zeros(PAGE, np.uint8)
        for i in range(a, b):
            bits[low[i] : high[i]] = state[i]
        four = bits.reshape(-1, 4)
        out.append((four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes())
    first = cuts[:-1]
    return pa.RecordBatch.from_arrays([pa.array(device[first], pa.int64()), pa.array(page[first], pa.int64()), pa.array(out, pa.binary())], ["device", "page", "payload"])


def invalid(pages_: DataFrame) -> DataFrame:
    """Pages whose payload has another size than a page's or a sector in the invalid state."""

    def run(batches):
        for batch in batches:
            bad = [p is None or len(p) != PAGE // 4 or bool((np.frombuffer(p, np.uint8) & (np.frombuffer(p, np.uint8) >> 1) & 0x55).any()) for p in batch.column(2).to_pylist()]
            yield batch.filter(pa.array(bad, pa.bool_()))

    return pages_.select("device", "page", "payload").mapInArrow(run, "device long, page long, payload binary")


def runs(pages_: DataFrame) -> DataFrame:
    """(device, offset, length, state) of maximal runs of owned sectors, joined across pages."""

    def run(batches):
        for batch in batches:
            device, offset, length, state = [], [], [], []
            for d, p, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = np.frombuffer(payload, np.uint8)
                bits = np.column_stack([raw & 3, raw >> 2 & 3, raw >> 4 & 3, raw >> 6]).ravel()
                begin = np.concatenate([[0], np.flatnonzero(np.diff(bits.astype(np.int16))) + 1])
                size = np.diff(np.concatenate([begin, [len(bits)]]))
                own = bits[begin] > 0
                device += [d] * int(own.sum())
                offset += (begin[own] + p * PAGE).tolist()
                length += size[own].tolist()
                state += bits[begin[own]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(device, pa.int64()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(state, pa.int32())], ["device", "offset", "length", "state"])

    return intervals.coalesce(pages_.select("device", "page", "payload").mapInArrow(run, "device long, offset long, length long, state int"), same=("state",), physical=False)
