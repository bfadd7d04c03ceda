"""Writers: canonical lines, reports, exclusive folders, single files and images."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.identity import canonical_struct
from .scratch import opened


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_exclusive(df: DataFrame, path: str, source: str = "parquet", **options: str) -> None:
    """All of it or nothing: written beside the place, then renamed to it; fails if the place exists, and leaves nothing behind."""
    spark = df.sparkSession
    files, target = _file_system(spark, path)
    if files.exists(target):
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    _, stage = _file_system(spark, staged)
    try:
        df.write.format(source).options(**options).save(staged)
        if files.exists(target) or not files.rename(stage, target):
            raise FileExistsError(path)
    finally:
        files.delete(stage, True)


def canonical_line(df: DataFrame) -> Column:
    """Keys sorted, nulls written, no blanks."""
    return canonical_struct(**{c: F.col(c) for c in df.columns})


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """B1: canonical lines in a fixed order over the files' names; fails if the folder exists."""
    write_exclusive(df.orderBy(*order).select(canonical_line(df).alias("value")), path, "text")


def error_line(code: Column, location: Column) -> Column:
    """B1: the canonical object that stands for a refused document."""
    return canonical_struct(error=F.struct(code.alias("code"), location.alias("location")))


def write_report(df: DataFrame, path: str, pretty: bool = False) -> None:
    """A report of one row as one JSON text, canonical or indented, in a folder of its own."""
    whole = F.struct(*sorted(df.columns))
    text = F.to_json(whole, {"ignoreNullFields": "false", "pretty": "true"}) if pretty else canonical_line(df)
    write_exclusive(df.select(text.alias("value")).coalesce(1), path, "text")  # one row by contract


def write_files(df: DataFrame, folder: str) -> DataFrame:
    """Each row (name, content binary) as a file of its own; gives name and bytes.  A repeated task writes the same file again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, place = opened(folder)
        files.create_dir(place, recursive=True)
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                with files.open_output_stream(f"{place}/{name}") as f:
                    f.write(content)
            yield pd.DataFrame({"name": frame["name"], "bytes": frame["content"].map(len)})

    return df.select("name", "content").mapInPandas(run, "name string, bytes long")


@F.pandas_udf(BinaryType())
def png(width: pd.Series, height: pd.Series, background: pd.Series, boxes: pd.Series) -> pd.Series:
    """A deterministic RGB image: boxes (x1, y1, x2, y2, colour 0xRRGGBB, stroke) over a background; stroke 0 fills, and what lies outside is cut."""

    def colour(value: int) -> np.ndarray:
        return np.array([value >> 16 & 255, value >> 8 & 255, value & 255], dtype=np.uint8)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    def one(w: int, h: int, back: int, found) -> bytes:
        image = np.tile(colour(int(back)), (h, w, 1))
        for b in found:
            x1, y1, x2, y2 = (max(0, int(b[k])) for k in ("x1", "y1", "x2", "y2"))
            s, c = int(b["stroke"]), colour(int(b["colour"]))
            for part in [(y1, y2, x1, x2)] if not s else [(y1, y1 + s, x1, x2), (max(y1, y2 - s), y2, x1, x2), (y1, y2, x1, x1 + s), (y1, y2, max(x1, x2 - s), x2)]:
                image[part[0] : part[1], part[2] : part[3]] = c
        lines = b"".join(b"\0" + row.tobytes() for row in image)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 9)) + chunk(b"IEND", b"")

    return pd.Series([one(int(w), int(h), b, x) for w, h, b, x in zip(width, height, background, boxes, strict=True)])
