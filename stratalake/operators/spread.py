"""Shuffles whose tasks stay as small as they are, however large the input is."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of stored input a task, and the most tasks; a table of unknown size counts as nothing.
TASK_BYTES, MOST_TASKS, UNKNOWN = 4 << 20, 20_000, 1 << 60


def tasks_for(*frames: DataFrame) -> int:
    """How many tasks a shuffle of these frames needs together, by the bytes of the tables that they are read from.

    Those grow with the input, while an estimate behind joins is a product of sizes.  A small input takes no more tasks
    than there are cores.
    """
    known = 0
    for df in frames:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        known += sum(x for x in sizes if x < UNKNOWN)
    session = frames[0].sparkSession
    least = min(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return max(1, least, min(-(-known // TASK_BYTES), MOST_TASKS))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` with all rows of a key in one task, of as many tasks as its input needs; windows and aggregations by these keys and more shuffle no further."""
    return df.repartition(tasks_for(df), *keys)


def spread_together(a: DataFrame, b: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by these keys, in as many tasks as both inputs need."""
    n = tasks_for(a, b)
    return a.repartition(n, *keys), b.repartition(n, *keys)
