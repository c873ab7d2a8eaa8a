"""What the operators share about their input tables and about places for intermediate tables."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes of an Arrow batch on its way to Python; the defaults hold 10,000 whole texts at once, in the JVM and in Python.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches where the session has no setting of its own."""
    for key, bound in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, bound)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed and cast: pick(df, doc_id="long", text="string").

    Other columns of the input, whatever their names, never reach an operator's own columns.
    A column that the table lacks is null.
    """
    have = set(df.columns)
    return df.select(*[(df[f"`{name}`"] if name in have else F.lit(None)).cast(kind).alias(name) for name, kind in columns.items()])


def _give_back() -> None:
    """Memory that this worker holds but doesn't use goes back to the system, as an idle worker stays for its executor's next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, run: Callable, kind) -> DataFrame:
    """mapInArrow whose workers give memory back at the end of each task."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(tidy, kind)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; a local session (tests) without one takes a folder of its own."""
    bound_batches(spark)
    context = spark.sparkContext
    if not context.getCheckpointDir():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            place = os.path.join(tempfile.gettempdir(), f"stratalake-{os.getpid()}")
        context.setCheckpointDir(place)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder and read from there: a short lineage that survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared checkpoint folder; for loops, as a checkpoint keeps its origin's constraints and statistics."""
    place = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    out = df.sparkSession.read.schema(df.schema).parquet(place)
    out.written_at = place
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables of `written` that nothing will read again, not even after a lost executor."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
