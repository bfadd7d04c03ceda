"""The shared folder that all executors see, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode alone, a new temporary folder where it is unset."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_ledgerloom_dir", None)
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
        context._ledgerloom_dir = found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_tables = threading.local()


def _written() -> list[str]:
    """Addresses of the tables that this thread has stored and not deleted."""
    if not hasattr(_tables, "paths"):
        _tables.paths = []
    return _tables.paths


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder, read again: recomputing never goes further back."""
    path = new_path(df.sparkSession, name)
    _written().append(path)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._ledgerloom_path = path
    return out


def stored_so_far() -> int:
    return len(_written())


def discard(spark: SparkSession, after: int, keep: list[DataFrame]) -> None:
    """Deletes what this thread has stored since :func:`stored_so_far` gave ``after``, but for the tables to keep.

    Call it once nothing unwritten reads the others any more.
    """
    kept = [df._ledgerloom_path for df in keep if hasattr(df, "_ledgerloom_path")]
    for path in _written()[after:]:
        if path not in kept:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _written()[after:] = [path for path in _written()[after:] if path in kept]
