"""Registered queries and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks a core that :func:`spread` makes of a table, the fewest of all, and the rows above which a task is another one.
TASKS_A_CORE, FEWEST_TASKS, ROWS_A_TASK = 4, 32, 200_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows over all cores, by the hash of their key, however few files and row groups hold them.

    For narrow rows of which each becomes a document: a document costs about a millisecond, and a table of one row group is one task's.
    What a task sorts or joins doesn't grow with the table: the rows are counted (by the files' footers) and there are tasks for all.
    """
    return rows.repartition(max(FEWEST_TASKS, TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK)), key)
