"""Files as tables.

Listings are the driver's, as in any scan of files, and read no content; headers and records of large files are read by range in the tasks, so no
file is ever a cell of a row.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import product
from ..operators.rules import json_code
from .scratch import is_local, opened, read_once

MOST_BYTES = 24 << 20
#: Bytes of an element of each type that a tensor file may hold.
ELEMENT_BYTES = {"F64": 8, "I64": 8, "F32": 4, "I32": 4, "F16": 2, "BF16": 2, "I16": 2, "I8": 1, "U8": 1, "BOOL": 1}
MOST_HEADER = 100 << 20


def listing(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """path and length of every file below the folder, empty ones too (which the engine's own file sources leave out)."""
    files, place = opened(folder)
    scheme = "file://" if is_local(folder) else folder[: folder.index("://") + 3]
    found = [(scheme + f.path, f.size) for f in files.get_file_info(pafs.FileSelector(place, recursive=True)) if f.type == pafs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern or "*")]
    return spark.createDataFrame(found, "path string, length long")


def receipts(spark: SparkSession, folder: str, pattern: str | None = None, label: str = "upstream_image_%03d") -> DataFrame:
    """Path, bytes, sha256, and place (from 1 on, with its label) in case-folded order of every file below the folder.

    The order is of the listing alone, one row a file; digests are made where the files are read, in pieces.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            digests = []
            for path in frame["path"]:
                files, place = opened(path)
                state = hashlib.sha256()
                with files.open_input_stream(place) as f:
                    while piece := f.read(1 << 20):
                        state.update(piece)
                digests.append(state.hexdigest())
            yield frame.assign(sha256=digests)

    found = listing(spark, folder, pattern)
    place = F.row_number().over(Window.orderBy(F.lower("path"), "path"))
    spread = found.withColumn("place", place).repartition(spark.sparkContext.defaultParallelism)
    hashed = spread.mapInPandas(run, "path string, length long, place int, sha256 string")
    return hashed.select("path", F.col("length").alias("bytes"), "sha256", "place", F.format_string(label, "place").alias("label"))


def json_documents(spark: SparkSession, folder: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A1-A3: path, text and code of every document: unsafe, empty, too large, changed while read, no UTF-8, no strict JSON; null if sound."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path in frame["path"]:
                data, code = read_once(path, most_bytes)
                text = None
                if code is None:
                    try:
                        text = data.decode("utf-8")
                        code = json_code(text)
                    except UnicodeDecodeError:
                        code = "MALFORMED_JSON"
                rows.append((path, text, code))
            yield pd.DataFrame(rows, columns=["path", "text", "code"])

    return listing(spark, folder).select("path").mapInPandas(run, "path string, text string, code string")


#: A fixture file's size and records.
MOST_FIXTURE_BYTES, MOST_RECORDS = 1 << 20, 1000


def array_records(spark: SparkSession, folder: str, most_bytes: int = MOST_FIXTURE_BYTES, most_records: int = MOST_RECORDS) -> DataFrame:
    """A4: path, place, raw of every record of the files that hold one JSON array each; a file that is none has one row, with its code.

    UNSAFE_FIXTURE (no regular file of its own), FIXTURE_TOO_LARGE, MALFORMED_JSON, INVALID_FIXTURE_ROOT (no array, or
    an empty one), TOO_MANY_RECORDS.  The last value of a repeated key counts.  A file is at most ``most_bytes``, so it is one row's work.
    """
    renamed = {"INPUT_TOO_LARGE": "FIXTURE_TOO_LARGE", "EMPTY_JSON": "MALFORMED_JSON"}

    def records_of(path: str) -> tuple[list[str], str | None]:
        data, code = read_once(path, most_bytes)
        if code is not None:
            return [], renamed.get(code, "UNSAFE_FIXTURE")
        try:
            value = json.loads(data.decode("utf-8"))
        except (ValueError, RecursionError):
            return [], "MALFORMED_JSON"
        if not isinstance(value, list) or not value:
            return [], "INVALID_FIXTURE_ROOT"
        return ([], "TOO_MANY_RECORDS") if len(value) > most_records else ([json.dumps(x, ensure_ascii=False) for x in value], None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                found, code = records_of(path)
                rows = [(path, k, x, None) for k, x in enumerate(found)] or [(path, None, None, code)]
                yield pd.DataFrame(rows, columns=["path", "place", "raw", "code"]).astype({"place": "Int64"})

    return listing(spark, folder).select("path").mapInPandas(run, "path string, place long, raw string, code string")


def safetensors_headers(spark: SparkSession, folder: str) -> DataFrame:
    """One row a tensor: path, name, dtype, shape, start, size, and where the file's data end; only headers are read.

    A file whose header can't be read has one row, with its code as the name.
    """

    def header(path: str, length: int) -> list[tuple]:
        files, place = opened(path)
        with files.open_input_file(place) as f:
            (n,) = struct.unpack("<Q", f.read(8)) if length >= 8 else (length,)
            if n + 8 > length or n > MOST_HEADER:
                return [(path, "MALFORMED_HEADER", None, None, None, None, length)]
            try:
                found = json.loads(f.read(n))
                return [(path, name, d["dtype"], [int(x) for x in d["shape"]], d["data_offsets"][0], d["data_offsets"][1] - d["data_offsets"][0], length - 8 - n) for name, d in found.items() if name != "__metadata__"]
            except (ValueError, KeyError, TypeError, IndexError):
                return [(path, "MALFORMED_HEADER", None, None, None, None, length)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # a frame a file: the tensors of a whole batch of files would be held at once
            for path, length in zip(frame["path"], frame["length"], strict=True):
                yield pd.DataFrame(header(path, int(length)), columns=["path", "name", "dtype", "shape", "start", "size", "data_bytes"])

    return listing(spark, folder).mapInPandas(run, "path string, name string, dtype string, shape array<long>, start long, size long, data_bytes long")


def safetensors_issues(headers: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Path, name and issue: malformed, unknown type, size not of the shape, a gap or overlap, data left over, a name that is missing."""
    before = Window.partitionBy("path").orderBy("start", "size")  # a file's tensors are its header's list
    width = F.element_at(F.create_map(*(F.lit(x) for pair in ELEMENT_BYTES.items() for x in pair)), F.col("dtype"))
    placed = headers.withColumns({"__expected": F.coalesce(F.lag(F.col("start") + F.col("size")).over(before), F.lit(0)), "__after": F.lead("start").over(before), "__width": width})
    issue = (
        F.when(F.col("name") == "MALFORMED_HEADER", "MALFORMED_HEADER").when(F.col("__width").isNull(), "UNKNOWN_DTYPE").when(product(F.col("shape")) * F.col("__width") != F.col("size"), "SHAPE_MISMATCH")
        .when(F.col("start") != F.col("__expected"), "NOT_CONTIGUOUS").when(F.col("__after").isNull() & (F.col("start") + F.col("size") != F.col("data_bytes")), "NOT_EXHAUSTIVE")
    )
    found = placed.select("path", "name", issue.alias("issue")).where("issue is not null")
    if not required:
        return found
    names = headers.groupBy("path").agg(F.explode(F.array_except(F.array(*map(F.lit, required)), F.collect_set(F.when(F.col("name").isin(*required), F.col("name"))))).alias("name"))
    return found.unionByName(names.withColumn("issue", F.lit("MISSING_TENSOR")))


def tensor_records(spark: SparkSession, file: str | None, records: DataFrame) -> DataFrame:
    """Each record (tensor_id, byte_offset, byte_length) of a flat float32 archive, read by range.

    Without ``file`` the records name theirs in a column ``path``, and those of one archive are read together.

    raw, canonical (with 0.0 for -0.0) and bound digest (offset and length in eight bytes, then the raw one), alignment, finiteness, elements.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, own in frame.groupby("path", sort=False):
                files, place = opened(path)
                rows = []
                with files.open_input_file(place) as f:
                    for key, at, n in zip(own["tensor_id"], own["byte_offset"].astype(int), own["byte_length"].astype(int), strict=True):
                        f.seek(at)
                        raw = f.read(n)
                        whole, aligned = len(raw) == n, at % 4 == 0 and n % 4 == 0
                        values = np.frombuffer(raw, "<f4") if whole and aligned else np.zeros(0, "<f4")
                        bound = hashlib.sha256(struct.pack(">QQ", at, n) + hashlib.sha256(raw).digest()).hexdigest()
                        rows.append((key, at, n, hashlib.sha256(raw).hexdigest(), hashlib.sha256((values + np.float32(0)).tobytes()).hexdigest(), bound, aligned, whole, bool(np.isfinite(values).all()), len(values)))
                yield pd.DataFrame(rows, columns=["tensor_id", "byte_offset", "byte_length", "sha256", "canonical_sha256", "bound_sha256", "aligned", "whole", "finite", "elements"])

    chosen = records.select(F.col("tensor_id").cast("string").alias("tensor_id"), F.col("byte_offset").cast("long").alias("byte_offset"), F.col("byte_length").cast("long").alias("byte_length"), F.lit(file).alias("path") if file is not None else F.col("path"))
    if file is None:
        chosen = chosen.repartition("path").sortWithinPartitions("path", "byte_offset")
    return chosen.mapInPandas(run, "tensor_id string, byte_offset long, byte_length long, sha256 string, canonical_sha256 string, bound_sha256 string, aligned boolean, whole boolean, finite boolean, elements long")


def archive_issues(records: DataFrame, total_bytes: int, unique: list[str]) -> DataFrame:
    """Records (tensor_id, byte_offset, byte_length, ``unique`` columns) with a gap or overlap before them, data left over, or a key that occurs again.

    Each record is joined with the one that ends where it begins, so no window holds the archive.
    """
    ends = records.select((F.col("byte_offset") + F.col("byte_length")).alias("byte_offset")).distinct().withColumn("__joins", F.lit(True))
    last = records.agg(F.max(F.col("byte_offset") + F.col("byte_length")).alias("__end"))
    again = records.groupBy(*unique).agg(F.count("*").alias("__n"), F.min("tensor_id").alias("__first"))
    starts = records.groupBy("byte_offset").agg(F.count("*").alias("__starts"))
    joined = records.join(ends, "byte_offset", "left").join(starts, "byte_offset").join(again, unique).crossJoin(F.broadcast(last))  # one row
    end = F.col("byte_offset") + F.col("byte_length")
    issue = F.when((F.col("byte_offset") > 0) & F.col("__joins").isNull() | (F.col("__starts") > 1), "NOT_CONTIGUOUS").when((end == F.col("__end")) & (end != total_bytes), "NOT_EXHAUSTIVE").when((F.col("__n") > 1) & (F.col("tensor_id") != F.col("__first")), "DUPLICATE_KEY")
    return joined.select("tensor_id", issue.alias("issue")).where("issue is not null")


def lfs_pointer(text: Column) -> Column:
    """Oid and size of a large-file pointer, or null."""
    good = text.rlike(r"^version \S+\noid sha256:[0-9a-f]{64}\nsize [0-9]+\n?$")
    return F.when(good, F.struct(F.regexp_extract(text, r"oid sha256:([0-9a-f]{64})", 1).alias("oid"), F.regexp_extract(text, r"size ([0-9]+)", 1).cast("long").alias("size")))
