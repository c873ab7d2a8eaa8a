"""Places for intermediate tables that all executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the session's checkpoint folder and read from there; a folder of this process only where none is set (tests)."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), f"stratalake-{os.getpid()}"))
    return df.checkpoint(eager=True)
