"""The book of registered queries, and inputs whose columns are stated once for Spark and SQL alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Given:
    """Rows derived from one of the driver's tables by expressions that both dialects read alike."""

    def __init__(self, table: str, **columns: str):
        self.table, self.columns = table, columns

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return inputs.table(spark, sf_dir, self.table).selectExpr(*(f"{e} AS `{n}`" for n, e in self.columns.items()))

    @property
    def sql(self) -> str:
        """A table expression for FROM."""
        return "(SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in self.columns.items()) + f" FROM {self.table})"


def cases(key: str, *texts: str) -> str:
    """One of the expressions by `key` modulo their number."""
    return f"CASE {key} % {len(texts)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"


def registered(sql: str | None = None, plain: bool = False) -> Callable[[Query], Query]:
    """Adds a query and its SQL, which begins with the inputs' expressions unless it is plain."""

    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLE[query.__name__] = sql if plain else inputs.SQL + sql
        return query

    return add
