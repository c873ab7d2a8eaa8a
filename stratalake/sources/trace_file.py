"""Trace files: a header of 24 bytes with the records' size and raw CRC-32C, and records of 24 bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import checksums
from ..operators import trace
from . import errors, need, rows_of

#: Fixed values of the format.
MAGIC = 0xC2EF1820
HEADER = struct.Struct("<IxxxxQIxxxx")
RECORD = np.dtype([("op", "S1"), ("pad", "V3"), ("layer_index", "<u4"), ("count", "<u8"), ("offset", "<i8")])


def packed(layer_index: np.ndarray, count: np.ndarray, offset: np.ndarray) -> bytes:
    """A trace file of reads."""
    rows = np.zeros(len(count), RECORD)
    rows["op"], rows["layer_index"], rows["count"], rows["offset"] = b"R", layer_index, count, offset
    body = rows.tobytes()
    return HEADER.pack(MAGIC, len(body), checksums.crc32c(body)) + body


def parse(content: bytes) -> Iterator[tuple]:
    """(ordinal, op, layer_index, count, offset) of a file's records; what is left behind whole records is ignored."""
    need(len(content) >= HEADER.size, "truncated")
    magic, size, checksum = HEADER.unpack_from(content)
    need(magic == MAGIC, "magic")
    need(size == len(content) - HEADER.size, "size")
    body = content[HEADER.size : HEADER.size + size // RECORD.itemsize * RECORD.itemsize]
    need(checksums.crc32c(body) == checksum, "checksum")
    rows = np.frombuffer(body, RECORD)
    need(not len(rows) or int(rows["count"].max()) < 1 << 63, "count above 63 bits")
    yield from zip(range(len(rows)), (c.decode("latin-1") for c in rows["op"].tolist()), *(rows[k].astype(np.int64).tolist() for k in ("layer_index", "count", "offset")), strict=True)


def scan(files: DataFrame) -> DataFrame:
    """(path, ordinal, op, layer_index, count, offset) of all sound trace files."""
    schema = pa.schema([("ordinal", pa.int64()), ("op", pa.string()), ("layer_index", pa.int64()), ("count", pa.int64()), ("offset", pa.int64())])
    return rows_of(files, parse, schema, "ordinal long, op string, layer_index long, count long, offset long")


def broken(files: DataFrame) -> DataFrame:
    """(path, error) of files that are no sound traces."""
    return errors(files, parse)


def written(records: DataFrame) -> DataFrame:
    """(device, records, content): a file of each device's conforming records, in order; a recording has a bounded number of them."""

    def run(batches):
        device: int | None = None
        held: list[tuple[int, int, int]] = []
        for batch in batches:
            for d, *row in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if d != device and held:
                    yield _file(device, held)
                    held = []
                device = d
                held.append(tuple(row))
        if held:
            yield _file(device, held)

    kept = trace.conforming(records).select("device", "ordinal", "layer_index", "count", "offset")
    return kept.repartition("device").sortWithinPartitions("device", "ordinal").mapInArrow(run, "device long, records long, content binary")


def _file(device: int | None, rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    content = packed(*(np.array(c) for c in zip(*rows, strict=True)))
    return pa.RecordBatch.from_arrays([pa.array([device], pa.int64()), pa.array([len(rows)], pa.int64()), pa.array([content], pa.binary())], ["device", "records", "content"])
