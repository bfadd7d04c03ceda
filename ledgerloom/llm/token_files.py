"""Token-ID files (operator 1): independent zstandard frames with a trailing seek table.

A *shard* is one file::

    data frame 0 .. data frame n-1     whole documents, about FRAME_BYTES of ids each,
                                       zstandard frames with a content checksum
    skippable frame, document index    doc_id, tokens of each document, null flags
    skippable frame, seek table        the public "seekable format": sizes of every frame
                                       and the low half of the XXH64 of its content

so any zstandard decoder reads the ids of a whole shard, and :class:`ShardReader`
reads the seek table and decompresses only the frames of the requested documents.
Ids are little-endian unsigned 16-bit integers if the vocabulary fits, else 32-bit.

Documents are dealt by ranges of doc_id, the text's first ``PREFIX`` characters, its hash and the
row, so rows that share an id (or have none) needn't meet in one task; each task writes its
shard under a temporary name and renames it, so a repeated task leaves the same file.  Shard k
holds no greater ids than shard k+1.  Null and empty texts hold the end id alone.  Null ids come
first; rows with equal ids stand in the order of those prefixes, then of the hashes.  Texts of any length are encoded
whole; an empty table has no shards and gives no rows; extra columns are left alone.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import new_path, stored
from .words import slices

FRAME_BYTES = 256 << 10
SKIPPABLE_INDEX, SKIPPABLE_SEEK = 0x184D2A50, 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
MEMO_ENTRIES = 500_000
#: Characters of a text that rows with equal ids are ordered by.
PREFIX = 32


# -- encoding ---------------------------------------------------------------------------


class _Ids:
    """Encoded bytes by chunk, in two generations: what is still in use survives the older one."""

    def __init__(self, tokenizer, kind: str, separator: tuple[str, int] | None):
        self.tokenizer, self.kind, self.separator = tokenizer, kind, separator
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, chunks: set[str]) -> None:
        """Puts all of the chunks into ``young``."""
        if len(self.young) > MEMO_ENTRIES:
            self.young, self.old = {}, self.young
        unknown = []
        for chunk in chunks - self.young.keys():
            if (known := self.old.get(chunk)) is not None:
                self.young[chunk] = known
            else:
                unknown.append(chunk)
        if self.separator is None:
            plain = unknown
        else:
            # many chunks a call, told apart by a special token, which stands for itself
            mark, mark_id = self.separator
            plain = [c for c in unknown if mark in c]
            joined = [c for c in unknown if mark not in c]
            groups = [joined[k : k + 200] for k in range(0, len(joined), 200)]
            for group, found in zip(groups, self.tokenizer.encode_batch_fast([f" {mark} ".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(found.ids, dtype=self.kind)
                raw, size, at = ids.tobytes(), ids.itemsize, 0
                ends = [*np.flatnonzero(ids == mark_id).tolist(), len(ids)]
                for chunk, end in zip(group, ends, strict=True):
                    self.young[chunk] = raw[at * size : end * size]
                    at = end + 1
        for chunk, found in zip(plain, self.tokenizer.encode_batch_fast(plain, add_special_tokens=False), strict=True):
            self.young[chunk] = np.array(found.ids, dtype=self.kind).tobytes()


class Encoder:
    """Ids of whole texts as the library gives them.

    If the vocabulary's pre-tokens never hold white space (its splitting pattern matches
    none, and white space is only ever collapsed), a text is the sequence of its chunks
    between blanks, and each distinct chunk is encoded by the library once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        first = ((config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        pattern = (first.get("pattern") or {}).get("Regex", " ")
        plain = not any(t[k] for t in config["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.by_chunk = plain and config["model"].get("end_of_word_suffix") == "</w>" and first.get("behavior") == "Removed" and first.get("invert") and not any(x in pattern for x in (" ", ".", r"\s*", r"\s+", r"\s|")) and not any(any(c.isspace() for c in t["content"]) for t in config["added_tokens"])
        special = next(((t["content"], t["id"]) for t in config["added_tokens"] if t["special"]), None)
        self.memo = _Ids(self.tokenizer, self.kind, special)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return [np.array(x.ids, dtype=self.kind).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        self.memo.learn(set().union(*cut))
        at = self.memo.young.__getitem__
        return [b"".join(map(at, chunks)) for chunks in cut]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# -- the file format --------------------------------------------------------------------


class ShardWriter:
    def __init__(self, out, kind: str):
        self.out, self.kind = out, kind
        self.compressor = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.frame_docs: list[int] = []
        self.held: list[bytes] = []
        self.size = self.docs = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // int(self.kind[-1]))
        self.held.append(ids)
        self.size += len(ids)
        self.docs += 1
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.docs:
            raw = b"".join(self.held)
            self._frame(self.compressor.compress(raw), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
            self.frame_docs.append(self.docs)
            self.held, self.size, self.docs = [], 0, 0

    def _frame(self, packed: bytes, size: int, check: int) -> None:
        self.out.write(packed)
        self.frames.append((len(packed), size, check))

    def close(self) -> None:
        self.flush()
        nulls = np.array([x is None for x in self.ids], dtype=np.uint8)
        index = struct.pack("<4sIQ", self.kind[1:].encode().ljust(4), len(self.frame_docs), len(self.ids)) + np.array(self.frame_docs, "<u8").tobytes() + np.array([x or 0 for x in self.ids], "<i8").tobytes() + np.array(self.counts, "<u8").tobytes() + nulls.tobytes()
        self._frame(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index, 0, 0)
        table = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class ShardReader:
    """Reads the seek table and document index of a shard, then frames on request."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("no seek table at the end of the shard")
        table = np.frombuffer(self._at(end - 9 - 12 * n, 12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.places = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.sizes, self.checks = table[:-1, 1], table[:-1, 2]
        index = self._at(self.places[n - 1] + 8, table[-1, 0] - 8)
        kind, frames, docs = struct.unpack_from("<4sIQ", index)
        self.kind = "<" + kind.decode().strip()
        self.frame_docs = np.frombuffer(index, "<u8", frames, 16).astype(np.int64)
        at = 16 + 8 * frames
        self.doc_ids = np.frombuffer(index, "<i8", docs, at)
        self.counts = np.frombuffer(index, "<u8", docs, at + 8 * docs).astype(np.int64)
        self.nulls = np.frombuffer(index, "u1", docs, at + 16 * docs).astype(bool)
        self.first_doc = np.concatenate([[0], np.cumsum(self.frame_docs)])
        self.decompressor = zstandard.ZstdDecompressor()

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(int(place))
        return self.source.read(int(size))

    def frame(self, k: int) -> np.ndarray:
        raw = self.decompressor.decompress(self._at(self.places[k], self.places[k + 1] - self.places[k]))
        if len(raw) != self.sizes[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[k]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return np.frombuffer(raw, dtype=self.kind)

    def frames(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        """The first document of each data frame, with the ids of its documents."""
        for k in range(len(self.frame_docs)):
            a, b = self.first_doc[k], self.first_doc[k + 1]
            yield int(a), np.split(self.frame(k), np.cumsum(self.counts[a:b])[:-1])

    def documents(self, wanted: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """Ids of the wanted documents that are here; only their frames are decompressed."""
        rows = np.flatnonzero(np.isin(self.doc_ids, np.array(wanted, dtype=np.int64)) & ~self.nulls)
        held, ids = -1, None
        for row in rows:
            k = int(np.searchsorted(self.first_doc, row, "right")) - 1
            if k != held:
                a, b = self.first_doc[k], self.first_doc[k + 1]
                held, ids = k, np.split(self.frame(k), np.cumsum(self.counts[a:b])[:-1])
            yield int(self.doc_ids[row]), ids[row - self.first_doc[held]]


# -- Spark ------------------------------------------------------------------------------

MANIFEST = "shard int, path string, n_docs long, n_tokens long, first_id long, last_id long"


def _files(path: str):
    """The file system and its own path: any store that pyarrow knows, local folders included."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_token_files(df: DataFrame, folder: str, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes the shards below ``folder`` and returns their manifest (one row a shard), as a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer, partial = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for part in slices(batch, "text"):
                if writer is None:
                    files, place = _files(folder)
                    files.create_dir(place, recursive=True)
                    final = f"{place}/shard-{shard:06d}.ids.zst"
                    partial = f"{final}.{uuid.uuid4().hex}"
                    code = encoder(tokenizer)
                    stream = files.open_output_stream(partial)
                    writer = ShardWriter(stream, code.kind)
                    end = np.array([end_id], dtype=code.kind).tobytes()
                encoded = code.encode([t or "" for t in part.column(1).to_pylist()])
                for key, ids in zip(part.column(0).to_pylist(), encoded, strict=True):
                    writer.add(key, ids + end)
        if writer is not None:
            writer.close()
            stream.close()
            files.move(partial, final)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{final.rpartition('/')[2]}"], "n_docs": [len(writer.ids)], "n_tokens": [sum(writer.counts)], **{name: pa.array([end_of(x for x in writer.ids if x is not None)], pa.int64()) for name, end_of in (("first_id", lambda ids: min(ids, default=None)), ("last_id", lambda ids: max(ids, default=None)))}})

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.select("*", F.left("text", F.lit(PREFIX)).alias("__prefix"), F.xxhash64("text").alias("__hash"), F.monotonically_increasing_id().alias("__row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("__prefix").asc_nulls_first(), F.col("__hash"), F.col("__row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return stored(dealt.mapInArrow(run, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32, shard.

    ``start`` counts the ids of all documents before it: a prefix sum over the manifest's
    few rows gives where each shard begins, and the shard's own index the rest.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")), T.StructField("shard", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, place = _files(row["path"])
                with files.open_input_file(place) as source:
                    reader = ShardReader(source)
                    starts = row["base"] + np.concatenate([[0], np.cumsum(reader.counts)])
                    for first, ids in reader.frames():
                        to = first + len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids[first:to], mask=reader.nulls[first:to]), pa.array(starts[first:to]), pa.array(reader.counts[first:to]), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([row["shard"]] * len(ids), pa.int32())], names=schema.names)

    return bases.repartition(max(1, manifest.count())).mapInArrow(run, schema)


def read_documents(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, ids of the wanted documents (column doc_id; null ones aren't found), as often as the files hold them; only their frames are decompressed.

    Where each shard's ids begin and end is known from the manifest (16 bytes a shard), so a wanted id goes to the
    shards that can hold it (one, but for an id that many rows share); those of one shard are read together, in order, as they come.
    """
    known = manifest.where("first_id is not null").select("shard", "path", "first_id", "last_id").orderBy("shard").toArrow()
    firsts, lasts = (np.asarray(known.column(c).to_numpy()) for c in ("first_id", "last_id"))
    paths = known.column("path").to_pylist()
    sent = manifest.sparkSession.sparkContext.broadcast((firsts, lasts, paths))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts, _ = sent.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            low, high = np.searchsorted(lasts, ids, "left"), np.searchsorted(firsts, ids, "right")
            many = np.maximum(high - low, 0)
            at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(np.repeat(ids, many))], names=["place", "doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, held, source, reader = sent.value[2], -1, None, None
        for batch in batches:
            places, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in np.unique(places).tolist():
                if at != held:
                    if source is not None:
                        source.close()
                    files, where = _files(paths[at])
                    source = files.open_input_file(where)
                    held, reader = at, ShardReader(source)
                found = list(reader.documents(ids[places == at].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x.astype(np.int64) for _, x in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])
        if source is not None:
            source.close()

    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().mapInArrow(place, "place long, doc_id long")
    return asked.repartition("place").sortWithinPartitions("place", "doc_id").mapInArrow(run, "doc_id long, ids array<long>")


def token_files(spark: SparkSession, df: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Writes the token files of ``df`` and returns what they hold, read back."""
    return read_token_files(write_token_files(df, folder or new_path(spark, "token-files"), tokenizer, end_id))
