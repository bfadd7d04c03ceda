r"""Periodic runs of words and texts without their repetitions (operator 11).

A *run* is a stretch of consecutive words with smallest period q (words q apart are identical),
at least ``max(LEAST_WORDS, LEAST_EXPONENT * q)`` words long, that no neighbouring word extends.

All-lag scan: the word-id array is compared with itself shifted by every lag up to
``n / LEAST_EXPONENT``, and the true stretches are run-length coded.  A stretch that is long enough
for its lag holds ``ANCHORS`` or more equally spaced comparisons in a row, so each shift is first
compared at those places alone, and in full only around such rows of anchors: nothing is missed,
and a lag costs about ``ANCHORS * n / lag``.  The documents of a slice are scanned together, longest
first, as one array in which no two documents share an id; lag q reads only the documents that are
long enough for it.

A stretch of lag q whose smallest period is less than q has a period that divides q, and is
then the whole run of that period too (both lengths are at least twice their lag), so of equal
stretches the one with the smallest lag is the run.

A document with more than ``LAGS_PER_TASK`` lags (as its length in bytes bounds them) is dealt as
(document, lag range) rows to different tasks; the runs of all ranges meet by (document, start,
length).  No task gets more than one document and one range of it, and a document has fewer runs than words.

Words are ``[^\x20\x09-\x0D]+``.  Null and empty texts, and texts without words, have no runs and
collapse to an empty text.  Repeated rows are judged one by one; an empty table gives no rows.
Extra columns are left alone, whatever their names.  Texts of any length are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .words import slices

LEAST_WORDS = 12
LEAST_EXPONENT = 2
#: Comparisons in a row, equally spaced, that a stretch must hold before a shift is compared in full there.
ANCHORS = 8
#: Lags of one document that a task scans; a longer document is dealt in ranges of lags.
LAGS_PER_TASK = 1 << 14
#: Runs of so many words are remembered, so that multiples of their periods needn't be compared in full.
LONG_RUN = 4096
#: Lags scanned first in every range of a long document, for the runs to be remembered.
FIRST_LAGS = 64

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_ids(documents: list[list[bytes]]) -> np.ndarray:
    """Ids of all words, one document after the other; equal only for equal words of one document."""
    out, base = [], 0
    for words in documents:
        known: dict[bytes, int] = {}
        out.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + base)
        base += len(known)
    ids = np.concatenate(out) if out else np.zeros(0, np.int64)
    return ids.astype(np.int32) if base < 1 << 31 else ids


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the true stretches begin and end."""
    edges = np.flatnonzero(np.diff(equal.view(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def lag_runs(ids: np.ndarray, sizes: np.ndarray, low: int, high: int, least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (start, length, lag) of the true stretches of the lags ``low`` to ``high - 1``.

    ``ids`` holds documents of ``sizes`` words, which must not increase.
    """
    upto = np.concatenate([[0], np.cumsum(sizes)])
    shortest = -sizes
    remembered: list[tuple[int, int, int]] = []
    if low > FIRST_LAGS and len(sizes):
        remembered = [tuple(r) for r in lag_runs(ids, sizes, 1, FIRST_LAGS, least, exponent).tolist() if r[1] >= LONG_RUN]
    found: list[np.ndarray] = []
    for lag in range(low, high):
        words = int(upto[np.searchsorted(shortest, -max(least, exponent * lag), "right")])
        if not words:
            break
        need = max(least - lag, (exponent - 1) * lag, 1)
        step = max(1, need // ANCHORS)
        row = need // step
        equal = ids[: words - lag : step] == ids[lag:words:step]
        some = equal
        for shift in (1, 2, 4):
            if 2 * shift <= row:
                some = some[:-shift] & some[shift:]
        if not some.any():
            continue
        first, last = _stretches(equal)
        far = last - first >= row
        first, last = first[far], last[far]
        if step == 1:
            found.append(np.stack([first, last - first + lag, np.full(len(first), lag)], axis=1))
            remembered += [tuple(r) for r in found[-1].tolist() if r[1] >= LONG_RUN]
            continue
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            at, to = max(0, (a - 1) * step + 1), min(words - lag, b * step)
            if any(lag % period == 0 and start <= a * step and (b - 1) * step + lag < start + length for start, length, period in remembered):
                continue
            start, end = _stretches(ids[at:to] == ids[at + lag : to + lag])
            far = end - start >= need
            rows = np.stack([start[far] + at, (end - start)[far] + lag, np.full(int(far.sum()), lag)], axis=1)
            found.append(rows)
            remembered += [tuple(r) for r in rows.tolist() if r[1] >= LONG_RUN]
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def smallest_periods(rows: np.ndarray) -> np.ndarray:
    """Of stretches with equal start and length, the one with the smallest lag; by start, then period."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of(documents: list[list[bytes]], least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT) -> list[np.ndarray]:
    """The runs (start, length, period) of each document."""
    sizes = np.array([len(w) for w in documents], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    first = np.concatenate([[0], np.cumsum(sizes)])
    highest = int(sizes[0]) // exponent if len(sizes) else 0
    rows = smallest_periods(lag_runs(word_ids([documents[k] for k in order]), sizes, 1, highest + 1, least, exponent))
    owner = np.searchsorted(first, rows[:, 0], "right") - 1
    rows[:, 0] -= first[owner]
    cut = np.searchsorted(owner, np.arange(len(sizes) + 1))
    out: list[np.ndarray] = [rows[:0]] * len(documents)
    for k, original in enumerate(order.tolist()):
        out[original] = rows[cut[k] : cut[k + 1]]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words, without those that any run contains after its first period, joined by one space."""
    if len(runs):
        depth = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
        np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()]
    return b" ".join(words).decode()


def _words(texts: pa.Array) -> list[list[bytes]]:
    # bytes.split() parts at 0x20 and 0x09-0x0D alone
    return [(t or "").encode().split() for t in texts.to_pylist()]


def _columns(documents: list[list[bytes]], runs: list[np.ndarray]) -> list[pa.Array]:
    all_runs = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
    ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(all_runs[:, k])) for k in range(3)], fields=list(_ARROW_RUNS.value_type))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts, type=_ARROW_RUNS)
    return [pa.array([len(w) for w in documents], pa.int64()), lists, pa.array([collapsed(w, r) for w, r in zip(documents, runs, strict=True)], pa.string())]


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT, lags_per_task: int = LAGS_PER_TASK) -> DataFrame:
    """``keep`` columns, n_words, runs (start, length, period; by start, then period) and collapsed text of every document."""
    if exponent < 2:
        raise ValueError("a run repeats its period at least twice")
    kept = [f"__keep{i}" for i in range(len(keep))]
    named = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)), F.col("text").alias("__text"))
    # n words take 2 * n - 1 bytes or more
    ranges = F.ceil((F.octet_length("__text") + 1) / (2 * exponent * lags_per_task)).cast("int")
    is_long = F.coalesce(ranges > 1, F.lit(False))
    n = len(kept)
    types = "".join(f"`{c}` {t}, " for c, t in named.select(*kept).dtypes)
    schema = f"{types}n_words bigint, runs {RUNS}, collapsed string"
    names = [*kept, "n_words", "runs", "collapsed"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                documents = _words(part.column(n))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *_columns(documents, runs_of(documents, least, exponent))], names=names)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row, at = batch.column(0)[k].as_py(), batch.column(1)[k].as_py() * lags_per_task + 1
                words = _words(batch.column(2).slice(k, 1))[0]
                found = lag_runs(word_ids([words]), np.array([len(words)]), at, min(at + lags_per_task, len(words) // exponent + 1), least, exponent)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(3))], names=["__row", "start", "length", "period"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                words = _words(one.column(n))[0]
                runs = np.array([(r["start"], r["length"], r["period"]) for r in one.column(n + 1)[0].as_py() or ()], dtype=np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([*one.columns[:n], *_columns([words], [smallest_periods(runs)])], names=names)

    short = named.where(~is_long).mapInArrow(whole, schema)
    long = stored(named.where(is_long).select(F.monotonically_increasing_id().alias("__row"), "*"), "long-documents", "zstd")
    dealt = long.select("__row", F.explode(F.sequence(F.lit(0), ranges - 1)).alias("__range"), "__text").repartition("__row", "__range")
    runs = dealt.mapInArrow(ranged, "__row bigint, start bigint, length bigint, period bigint").groupBy("__row", "start", "length").agg(F.min("period").alias("period"))
    by_document = runs.groupBy("__row").agg(F.collect_list(F.struct("start", "length", "period")).alias("__runs"))
    scanned = long.join(by_document, "__row", "left").select(*kept, "__text", "__runs").mapInArrow(joined, schema)
    out = short.unionByName(scanned)
    return out.select(*(F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)), "n_words", "runs", F.col("collapsed").alias("text"))
