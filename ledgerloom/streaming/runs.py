"""Run traces over a file stream (extension of SURVEY W1)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.traces import any_of, kind_counts


def run_counts(events: DataFrame, run: str, kind: str, kinds: list[str]) -> DataFrame:
    """E1 on a stream: the same counts, updated as events arrive."""
    return kind_counts(events, run, kind, kinds)


def windowed_errors(events: DataFrame, time: str, kind: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and failures by window of event time; what comes later than ``late`` is left out."""
    window = F.window(time, width)
    return events.withWatermark(time, late).groupBy(window.alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col(kind) == "error").alias("errors"), any_of(F.col(kind) == "error").alias("failed")).select("w.start", "w.end", "events", "errors", "failed")


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


class _Completeness(StatefulProcessor):
    """Per run: the next number that is due, the numbers that came ahead of it, and the count that the run states."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "due bigint, expected bigint, timer bigint, told boolean")
        self.ahead = handle.getMapState("ahead", "sequence bigint", "there boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due, expected, timer, told = self.progress.get() if self.progress.exists() else (1, None, None, False)
        last = 0
        for frame in rows:
            for sequence, count, at in zip(frame["sequence"], frame["event_count"], frame["at_ms"], strict=True):
                last = max(last, int(at))
                if not pd.isna(count):
                    expected = max(int(count), expected or 0)
                if pd.isna(sequence) or sequence < due:
                    continue  # told before
                if sequence > due:
                    self.ahead.updateValue((int(sequence),), (True,))
                    continue
                due += 1
                while self.ahead.containsKey((due,)):
                    self.ahead.removeKey((due,))
                    due += 1
        if expected is not None and due == expected + 1 and not told and not any(True for _ in self.ahead.keys()):
            told = True
            yield _told(key[0], expected, due - 1, None)
        if timer is None or last + self.wait_ms > timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = last + self.wait_ms
            self.handle.registerTimer(timer)
        self.progress.update((due, expected, timer, told))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due, expected, _, told = self.progress.get()
        ahead = sum(1 for _ in self.ahead.keys())
        self.progress.clear()
        self.ahead.clear()
        if not told:
            yield _told(key[0], expected, due - 1 + ahead, due)

    def close(self) -> None:
        pass


def _told(run, expected, seen, missing) -> pd.DataFrame:
    return pd.DataFrame({"run": [str(run)], "expected": pd.array([expected], "Int64"), "seen": pd.array([seen], "Int64"), "first_missing": pd.array([missing], "Int64")})


def run_completeness(events: DataFrame, run: str, sequence: str, event_count: str, time: str, late: str = "10 minutes", wait_seconds: int = 3600) -> DataFrame:
    """Each run once: when its events 1 to ``event_count`` are all there, in whatever order they came, or when no more came for so long.

    run, expected (the greatest count that its events state; null if none did), seen (distinct numbers), first_missing (null: complete).  A run of
    which nothing came for ``wait_seconds`` of event time behind the watermark is told as incomplete and forgotten.  Numbers that come twice
    count once.  State is what a run lacks: one number, and those ahead of it; the same columns as :func:`..operators.traces.completeness`.

    The session needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = events.withWatermark(time, late).select(F.col(run).cast("string").alias("run"), F.col(sequence).cast("long").alias("sequence"), F.col(event_count).cast("long").alias("event_count"), F.unix_millis(time).alias("at_ms"), F.col(time).alias("__time"))
    return rows.groupBy("run").transformWithStateInPandas(_Completeness(wait_seconds * 1000), "run string, expected bigint, seen bigint, first_missing bigint", "Append", "EventTime")
