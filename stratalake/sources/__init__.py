"""Binary and text formats as DataFrame sources and sinks, over rows of (path, content) as `binaryFile` reads them.

Readers refuse a broken file as a whole: it gives no rows, and `errors` of the same module tells why.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Most rows, and bytes of texts and contents, of a batch from or to Python; a single larger file is a batch of its own.
ROWS, PIECE = 10_000, 4 << 20


class FormatError(ValueError):
    """A file that its format's rules refuse."""


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files under a path that Spark can read; a file has at most 2 GB."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _mapped(df: DataFrame, run: Callable, ddl: str) -> DataFrame:
    """mapInArrow with input batches of PIECE bytes, where the session has no bound of its own; by default they hold 10,000 whole files.

    Workers give memory back after each batch and at the end of a task, as they stay for their executor's next one.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PIECE))

    return df.mapInArrow(lambda batches: tidied(run(batches)), ddl)


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; free memory goes back to the system after each, as allocators keep more of it the longer a task lasts."""
    try:
        for batch in batches:
            yield batch
            del batch
            _give_back()
    finally:
        _give_back()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def _weight(row: tuple) -> int:
    return sum(len(x) for x in row if isinstance(x, (bytes, str)))


def parsed(batches: Iterator[pa.RecordBatch], parse: Callable[[bytes], Iterator[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of `rows_of`: rows of several small files together, those of a large one apart."""
    names, kinds = ["path", *schema.names], [pa.string(), *schema.types]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    held, size = [], 0
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            whole, some, n = [], [], 0
            try:
                for row in parse(content.as_py() or b""):
                    some.append((path.as_py(), *row))
                    n += _weight(row)
                    if len(some) >= ROWS or n >= PIECE:
                        whole.append(made(some))
                        some, n = [], 0
            except FormatError:
                continue
            yield from whole
            held += some
            size += n
            if len(held) >= ROWS or size >= PIECE:
                yield made(held)
                held, size = [], 0
    if held:
        yield made(held)


def rows_of(files_: DataFrame, parse: Callable[[bytes], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """(path, ...) of what `parse` yields of each file; a refused file gives nothing.  One file at a time is in memory beside the batch."""
    return _mapped(files_.select("path", "content"), lambda batches: parsed(batches, parse, schema), f"path string, {ddl}")


def errors(files_: DataFrame, parse: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """(path, error) of the files that `parse` refuses."""

    def run(batches):
        for batch in batches:
            bad = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    for _ in parse(content.as_py() or b""):
                        pass
                except FormatError as e:
                    bad.append((path, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([b[i] for b in bad], pa.string()) for i in (0, 1)], ["path", "error"])

    return _mapped(files_.select("path", "content"), run, "path string, error string")


def made_of(batches: Iterator[pa.RecordBatch], write: Callable[[dict], bytes], key: str) -> Iterator[pa.RecordBatch]:
    """Batches of `written_by`: one row is in Python beside a batch of files."""
    for batch in batches:
        paths, content, size = [], [], 0
        for path, *row in zip(batch.column(key).cast(pa.string()), *batch.columns, strict=True):
            paths.append(path.as_py())
            content.append(write({name: x.as_py() for name, x in zip(batch.schema.names, row, strict=True)}))
            size += len(content[-1])
            if size >= PIECE:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(content, pa.binary())], ["path", "content"])
                paths, content, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(content, pa.binary())], ["path", "content"])


def written_by(rows: DataFrame, write: Callable[[dict], bytes], key: str = "path") -> DataFrame:
    """(path, content): one file of each row, made by `write` from its columns."""
    return _mapped(rows, lambda batches: made_of(batches, write, key), "path string, content binary")


def need(good: bool, why: str) -> None:
    if not good:
        raise FormatError(why)
