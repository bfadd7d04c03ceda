"""Best-fit packing of documents into sequences, planned on the length histogram (operator 12).

A document is its token ids and the end id; one longer than the capacity is cut into pieces of the
capacity, the last of which may be shorter.  Nothing else is cut, and nothing is dropped or padded.

Lengths go up to the capacity, so the histogram of all pieces has at most as many rows, however
many documents there are.  Best-fit decreasing runs over its *counts*: sequences with the same
content are one entry of the plan with a count, and all pieces of one length are placed together.
The plan says which *slots* there are: the pieces with ranks ``first .. first + n - 1`` among those
of a length stand ``each`` a sequence from ``sequence`` on, at ``offset`` and after.

Pieces take slots by their rank within their length.  Each task numbers the pieces of a length as it
encodes them; a prefix sum over (length, task) counts, not over pieces, gives where its numbers
begin.  So no window or sort holds pieces, and a length that a third of all pieces share is no heavier
than others.  The slot table is a function of the histogram alone and is broadcast: an entry has
fewer than ``sqrt(2 * capacity)`` different lengths (they add up to the capacity), and a length
parts at most two entries in two, so there are at most ``3 * capacity`` entries.

Null and empty texts hold the end id alone.  Repeated rows and rows of equal or null doc_id are
documents of their own.  Texts of any length are encoded whole; an empty table gives no rows.  Extra
columns are left alone, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, stored, stored_so_far
from .token_files import encoder
from .words import slices

CAPACITY = 4096
PIECES = "piece int, start bigint, length int, ids_crc32 bigint, task int, rank bigint"
SLOTS = "length int, first bigint, n bigint, each int, sequence bigint, offset bigint"


# -- the plan ---------------------------------------------------------------------------


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Entries (sequences, content) of best-fit decreasing; the content is (length, times) in the order of placing.

    A piece goes to the fullest open sequence that it fits in, else to a new one.  As pieces come in
    the order of their lengths, a sequence that takes one takes as many of that length as fit.
    """
    open_by_room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit {capacity}")
        left = histogram[length]
        closed: list[tuple[int, tuple[int, list[tuple[int, int]]]]] = []
        for room in sorted(r for r in open_by_room if r >= length):
            times = room // length
            entries = open_by_room[room]
            while left and entries:
                count, content = entries.pop()
                full = min(count, left // times)
                if full:
                    closed.append((room - times * length, (full, [*content, (length, times)])))
                    left -= full * times
                    count -= full
                if count and 0 < left < times:  # the last pieces share one sequence
                    closed.append((room - left * length, (1, [*content, (length, left)])))
                    left, count = 0, count - 1
                if count:
                    entries.append((count, content))
            if not left:
                break
        times = capacity // length
        if left >= times:
            closed.append((capacity - times * length, (left // times, [(length, times)])))
        if left % times:
            closed.append((capacity - left % times * length, (1, [(length, left % times)])))
        for room, entry in closed:
            open_by_room.setdefault(room, []).append(entry)
        open_by_room = {r: e for r, e in open_by_room.items() if e}
    return [entry for room in sorted(open_by_room) for entry in open_by_room[room]]


def slots(entries: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of ``SLOTS``: for each length of each entry, which ranks stand where."""
    out, taken, sequence = [], {}, 0
    for count, content in entries:
        offset = 0
        for length, times in content:
            first = taken.get(length, 0)
            out.append((length, first, count * times, times, sequence, offset))
            taken[length] = first + count * times
            offset += length * times
        sequence += count
    return out


# -- Spark ------------------------------------------------------------------------------


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """``keep`` columns, piece, start, length, ids_crc32, task, rank (and ids) of every piece, as a stored table.

    ``rank`` counts the pieces of the same length that the task has seen before.
    """
    kept = [f"__keep{i}" for i in range(len(keep))]
    named = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)), F.col("text").alias("__text"))
    n = len(kept)
    schema = "".join(f"`{c}` {t}, " for c, t in named.select(*kept).dtypes) + PIECES + (", ids array<int>" if with_ids else "")
    names = [*kept, *(x.split()[0] for x in PIECES.split(", ")), *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, code = TaskContext.get().partitionId(), encoder(tokenizer)
        seen = [0] * (capacity + 1)
        for batch in batches:
            for part in slices(batch, "__text"):
                of, number, start, length, crc, rank, held = [], [], [], [], [], [], []
                for row, raw in enumerate(code.encode([t or "" for t in part.column(n).to_pylist()])):
                    ids = np.append(np.frombuffer(raw, code.kind).astype("<u4"), np.uint32(end_id))
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        own = ids[at : at + capacity]
                        of.append(row)
                        number.append(k)
                        start.append(at)
                        length.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
                        rank.append(seen[len(own)])
                        seen[len(own)] += 1
                        if with_ids:
                            held.append(own.astype(np.int32))
                columns = [pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array([task] * len(of), pa.int32()), pa.array(rank, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(of, pa.int32())) for c in part.columns[:n]), *columns, *([pa.array(held, pa.list_(pa.int32()))] if with_ids else [])], names=names)

    return stored(named.mapInArrow(run, schema), "pieces", "zstd")


def slot_table(spark: SparkSession, counted: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The plan for pieces counted by (length, task): the histogram's at most ``capacity`` rows are all that the driver reads."""
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = slots(plan(histogram, capacity))
    columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=[x.split()[0] for x in SLOTS.split(", ")]))


def placed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset instead of task and rank; ``cut`` is what :func:`pieces` stored."""
    counted = stored(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "length-counts")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a length has at most a row a task here
    bases = counted.select(F.col("length").alias("__length"), F.col("task").alias("__task"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    ranked = cut.join(bases, (F.col("length") == F.col("__length")) & (F.col("task") == F.col("__task"))).withColumn("__rank", F.col("rank") + F.col("__base"))
    table = slot_table(cut.sparkSession, counted, capacity).withColumnsRenamed({"length": "__of", "offset": "__offset"})
    inside = (F.col("length") == F.col("__of")) & (F.col("__rank") >= F.col("first")) & (F.col("__rank") < F.col("first") + F.col("n"))
    at = F.col("__rank") - F.col("first")
    sequence = F.col("sequence") + F.floor(at / F.col("each"))
    offset = F.col("__offset") + F.pmod(at, F.col("each")) * F.col("length")
    others = [c for c in cut.columns if c not in ("task", "rank")]
    return ranked.join(F.broadcast(table), inside).select(*others, sequence.cast("bigint").alias("sequence_id"), offset.cast("bigint").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """``keep`` columns, piece, start, length, ids_crc32, (ids,) sequence_id and offset of every piece."""
    before = stored_so_far()
    cut = pieces(docs, tokenizer, end_id, capacity, keep, with_ids)
    out = stored(placed(cut, capacity), "packed", "zstd")
    discard(docs.sparkSession, before, keep=[out])
    kept = [f"__keep{i}" for i in range(len(keep))]
    return out.select(*(F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)), "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_pieces, ids and starts (where each piece begins) of every sequence, from what :func:`pack` gave with ids.

    A sequence holds at most the capacity's tokens, so no group grows with the input.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.size("parts").alias("n_pieces"), F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("starts"))
